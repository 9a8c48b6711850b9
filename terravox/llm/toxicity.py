"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on the windows of ordinary text, one
on toxic text. Most of a toxic document reads like any other, so what ordinary
texts hold too, and what stands in it once only, is taken out first: a toxic
sample is a run of bytes whose every `NOVEL` neighbours stand in no ordinary
text of the fit and recur in the toxic ones (see `novel_runs`). Both dictionaries are used as zstandard trained them. A window is compressed
with the ordinary dictionary, and with the ordinary and the toxic one together,
so that both know ordinary prose equally well; the saved bytes over a document's
windows give the score: a logistic curve of their largest, mean and summed
saving, with the threshold 0.7 calibrated on rows that the compared dictionaries
have not seen (cross-fitting).

The model is fitted on at most `most` labelled documents of each class (those of
the smallest hash), from their whole texts; it is some hundred kilobytes. Every
document is scored whole, in place: no shuffle.

Defined results: a null text is empty and gets the score of saving nothing;
repeated rows each give a row; without labels of both classes every score is 0;
where there is too little text to train on, the samples themselves are the
dictionary.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, in_chunks, text_or_empty, tidied, utf8_list
from .quality_ratio import bounded_sample

#: Bytes of a window; of the windows that the ordinary dictionary is trained on; of a dictionary; neighbours that must be new in a toxic sample.
WINDOW, SAMPLE, ORDINARY, TOXIC, NOVEL = 128, 256, 112 << 10, 2 << 10, 6
FOLDS, BETA = 5, 1.5


@dataclass
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    weights: tuple[float, ...] = ()
    means: tuple[float, ...] = ()
    scales: tuple[float, ...] = ()
    shift: float = 0.0
    level: int = 19


def windows(text: bytes, size: int) -> list[bytes]:
    """Pieces of at most `size` bytes, cut at white space where there is any; all of the text is in one."""
    out, at = [], 0
    while at < len(text):
        to = at + size
        if to < len(text):
            space = max(text.rfind(b" ", at + 1, to), text.rfind(b"\n", at + 1, to))
            to = space if space > at else to
        out.append(text[at:to])
        at = to
    return out or [b""]


class Scorer:
    def __init__(self, model: Model):
        import zstandard

        self.model = model

        def compress(content: bytes):
            d = zstandard.ZstdCompressionDict(content)
            d.precompute_compress(level=model.level)
            return zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress

        self.ordinary, self.both = compress(model.ordinary), compress(model.ordinary + model.toxic)

    def savings(self, text: bytes) -> np.ndarray:
        """What the toxic dictionary saves in each window, in bytes."""
        return np.array([len(self.ordinary(w)) - len(self.both(w)) for w in windows(text.lower(), WINDOW)])

    def features(self, text: bytes) -> tuple[float, ...]:
        saved = self.savings(text)
        over = np.maximum(0, saved - 1)
        return (np.sort(saved)[-3:].mean(), over.mean(), over.sum() / math.sqrt(len(saved)), math.log(len(saved)))

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not self.model.weights:
            return np.zeros(len(texts))
        x = (np.array([self.features(t) for t in texts]).reshape(len(texts), -1) - self.model.means) / self.model.scales
        return np.round(1 / (1 + np.exp(-np.clip(x @ np.array(self.model.weights) + self.model.shift, -30, 30))), 6)


def neighbours(text: bytes) -> np.ndarray:
    """A number for each run of NOVEL bytes; different runs have different numbers."""
    a = np.frombuffer(text, np.uint8).astype(np.uint64)
    n = max(0, len(a) - NOVEL + 1)
    out = np.zeros(n, np.uint64)
    for k in range(NOVEL):
        out = out * np.uint64(257) + a[k : k + n]
    return out


def _cut(buf: bytes, keep: np.ndarray) -> list[bytes]:
    """The runs of buf whose every NOVEL neighbours are kept."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], keep, [False])).view(np.int8)))
    return [buf[a : b + NOVEL - 1] for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True)]


def novel_runs(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """The runs of bytes of toxic texts whose every NOVEL neighbours stand in no ordinary text, but in other surroundings of a toxic one too.

    Copies of a text have the same surroundings, so they count once.
    """
    seen = [np.unique(neighbours(b"\n".join(ordinary[lo:hi]))) for lo, hi in in_chunks(ordinary)]
    known = np.unique(np.concatenate([*seen, np.zeros(1, np.uint64)]))
    new = lambda h: known[np.minimum(np.searchsorted(known, h), len(known) - 1)] != h
    runs: dict[bytes, None] = {}
    for lo, hi in in_chunks(toxic):
        buf = b"\n".join(toxic[lo:hi])
        runs.update(dict.fromkeys(_cut(buf, new(neighbours(buf)))))
    buf = b"\n".join(runs)
    h = neighbours(buf)
    _, of, n = np.unique(h, return_inverse=True, return_counts=True)
    ends = np.concatenate(([0], np.cumsum(np.frombuffer(buf, np.uint8) == 10)))
    whole = ends[NOVEL : len(h) + NOVEL] == ends[: len(h)]
    return _cut(buf, new(h) & whole & (n[of] >= 2))


def trained(samples: list[bytes], size: int, k: int) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, k=k, d=6).as_bytes()
    except zstandard.ZstdError:  # too little text to train on
        return b"".join(samples)[-size:]


def dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """The dictionaries of ordinary and of toxic text."""
    plain = dict.fromkeys(w for t in ordinary for w in windows(t, SAMPLE))
    return trained(list(plain), ORDINARY, 32), trained(novel_runs(toxic, ordinary), TOXIC, 12)


def fit(rows: list[tuple[bytes, int]]) -> Model:
    """Dictionaries from all rows (text, label); weights and threshold from each row's features under dictionaries of the other folds."""
    rows = [(t.lower(), y) for t, y in rows]
    if len({y for _, y in rows}) < 2:
        return Model()
    fold = [zlib.crc32(t) % FOLDS for t, _ in rows]

    def made(of) -> Model:
        return Model(*dictionaries(*([t for (t, y), f in zip(rows, fold, strict=True) if y == label and of(f)] for label in (1, 0))))

    x, y = [], []
    for k in range(FOLDS):
        scorer = Scorer(made(lambda f, k=k: f != k))
        own = [r for r, f in zip(rows, fold, strict=True) if f == k]
        x += [scorer.features(t) for t, _ in own]
        y += [label for _, label in own]
    model = made(lambda f: True)
    x, y = np.array(x), np.array(y, float)
    means, scales = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack(((x - means) / scales, np.ones(len(x))))
    share = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    w = np.zeros(z.shape[1])
    for _ in range(50):  # Newton steps of a ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        ridge = np.append(w[:-1], 0)
        hess = (z * (share * p * (1 - p))[:, None]).T @ z + np.eye(len(w))
        step = np.linalg.solve(hess, z.T @ (share * (y - p)) - ridge)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    # The cut with the best F on these rows, recall weighing BETA times as much as precision, becomes the score 0.7.
    raw = z @ w
    order = np.argsort(-raw, kind="stable")
    hits = np.cumsum(y[order])
    f = (1 + BETA**2) * hits / (np.arange(1, len(y) + 1) + BETA**2 * y.sum())
    ends = np.append(raw[order][1:] < raw[order][:-1], True)
    best = int(np.argmax(np.where(ends, f, -1)))
    cut = (raw[order][best] + raw[order][min(best + 1, len(y) - 1)]) / 2
    return Model(model.ordinary, model.toxic, tuple(map(float, w[:-1])), tuple(map(float, means)), tuple(map(float, scales)), float(w[-1] - cut + math.log(0.7 / 0.3)))


def held_out():
    """Whether a row's label must not be learnt from."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def train(docs: DataFrame, labels: DataFrame, most: int = 2000) -> Model:
    """Fits on at most `most` labelled rows of docs of each class, from their whole texts."""
    known = labels.filter("doc_id is not null and toxic in (0, 1)").filter(~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = [r.doc_id for y in (0, 1) for r in bounded_sample(known.filter(F.col("toxic") == y), most).collect()]
    ids = docs.sparkSession.createDataFrame([(i,) for i in picked], "doc_id long")  # at most 2 * most ids
    toxic = known.join(F.broadcast(ids), "doc_id", "left_semi").collect()
    marks = docs.sparkSession.createDataFrame(toxic, "doc_id long, toxic int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(F.broadcast(marks), "doc_id")
    texts = texts.dropDuplicates(["doc_id"]).select("text", "toxic", F.xxhash64("doc_id").alias("h"))
    return fit([(t.encode(), y) for t, y, _ in sorted(texts.collect(), key=lambda r: (r.h, r.text))])


_scorers: dict[bytes, Scorer] = {}


def scorer(model: Model) -> Scorer:
    name = repr(model).encode()
    if name not in _scorers:
        _scorers.clear()
        _scorers[name] = Scorer(model)
    return _scorers[name]


_SCORES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType())])


def toxicity_scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""

    def run(batches):
        s = scorer(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s.score(utf8_list(batch.column(2))))], names=[f.name for f in _SCORES])

    scored = bounded_batches(docs).select(F.col("doc_id").cast("long"), held_out().alias("held_out"), text_or_empty().alias("text")).mapInArrow(tidied(run), _SCORES)
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def without_toxic(docs: DataFrame, model: Model, cut: float = 0.7) -> DataFrame:
    """The rows of docs whose score is under the cut, with all their columns."""
    at = docs.columns.index("text")

    def run(batches):
        s = scorer(model)
        for batch in batches:
            yield batch.filter(pa.array(s.score(utf8_list(batch.column(at))) < cut))

    return bounded_batches(docs).mapInArrow(tidied(run), docs.schema)
