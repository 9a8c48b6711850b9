"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

A text is two counts of terms: hashed runs of one to three bytes, and shapes of
words (length, whether a word repeats the one before it, kinds of its first and
last byte). Terms weigh log(1 + count), or the root of their share, times the
inverse document frequency over all documents; each field has length one. A
truncated singular value decomposition of a bounded labelled sample gives the
latent space. The sample's latent vectors are broadcast (at most 2 * `most` rows of
`dims` doubles: 1.6 MB), and every document takes the exact cosine products with
all of them, a block of documents at a time. Its `near` nearest vectors (and all
that tie with the last) vote with their cosine to the power `power`, each class
weighing the same in total; the vote is stretched so that the best cut of the
labelled rows' own votes, each without itself and its copies, becomes 0.7.

Defined results: a null text is empty; a text without a positive cosine (an empty
one) gets the share of label 1 among the rows that may be learnt from, as does
every text where one class has no row; repeated rows each give a row; a doc_id of
several texts is learnt from its least, one of several labels from its greatest;
nulls in other columns and columns of other names play no part; an empty table
gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, hashed_words, in_chunks, text_or_empty, tidied, utf8_list
from .quality_ratio import bounded_sample

#: Terms of either field.
RUNS, SHAPES = 1 << 12, 1 << 7
TERMS = RUNS + SHAPES

#: Kinds of bytes: letters, capitals, other signs, digits.
_kind = np.full(256, 2)
_kind[97:123] = _kind[128:] = 0
_kind[65:91], _kind[48:58] = 1, 3


def term_counts(texts: list[bytes]) -> np.ndarray:
    """A row of counts for each text: RUNS, then SHAPES."""
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.concatenate(([0], np.cumsum(sizes)))
    buf = np.frombuffer(b"".join(texts), np.uint8)
    doc = np.repeat(np.arange(len(texts)), sizes)
    out = np.zeros(len(texts) * RUNS, np.int64)
    code = np.zeros(len(buf), np.uint32)
    for n in (1, 2, 3):
        if len(buf) < n:
            break
        code = code[: len(buf) - n + 1] * np.uint32(256) + buf[n - 1 :]
        here = doc[: len(code)] == doc[n - 1 :]
        term = ((code + np.uint32(n << 24)) * np.uint32(2654435761)) >> np.uint32(32 - 12)
        out += np.bincount((doc[: len(code)] * RUNS + term)[here], minlength=len(out))
    h, start, end, first = hashed_words(texts)
    words = np.repeat(np.arange(len(texts)), np.diff(first))
    again = np.concatenate((np.zeros(1, bool), (h[1:] == h[:-1]) & (words[1:] == words[:-1])))[: len(h)]
    size = np.minimum(3, np.log2(np.maximum(1, end - start)).astype(np.int64))
    at = begins[words]
    shape = ((size * 2 + again) * 4 + _kind[buf[at + start]]) * 4 + _kind[buf[at + end - 1]] if len(h) else np.zeros(0, np.int64)
    shapes = np.bincount(words * SHAPES + shape, minlength=len(texts) * SHAPES)
    return np.hstack((out.reshape(-1, RUNS), shapes.reshape(-1, SHAPES)))


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 1e-12)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    shapes = counts[:, RUNS:] / np.maximum(1, counts[:, RUNS:].sum(1, keepdims=True))
    return np.hstack((_unit(np.log1p(counts[:, :RUNS]) * idf[:RUNS]), _unit(np.sqrt(shapes) * idf[RUNS:])))


@dataclass
class Model:
    prior: float = 0.5
    near: int = 15
    power: float = 8.0
    cut: float = 0.5
    idf: np.ndarray | None = None
    axes: np.ndarray | None = None  # terms x dims
    vectors: np.ndarray | None = None  # labelled rows x dims, of length one
    labels: np.ndarray | None = None

    def latent(self, counts: np.ndarray) -> np.ndarray:
        return _unit(weighted(counts, self.idf) @ self.axes)

    def votes(self, vectors: np.ndarray, copies: bool = True) -> np.ndarray:
        """The share of label 1 among the nearest labelled vectors; without copies, equal vectors have no vote."""
        cosine = np.round(vectors @ self.vectors.T, 9)
        if not copies:
            cosine[cosine >= 1 - 1e-8] = 0
        k = min(self.near, cosine.shape[1])
        least = np.partition(cosine, -k, axis=1)[:, -k, None]
        w = np.where(cosine >= least, np.maximum(cosine, 0), 0) ** self.power
        ones = w @ (self.labels / self.labels.sum())
        zeros = w @ ((1 - self.labels) / (1 - self.labels).sum())
        both = ones + zeros
        return np.divide(ones, both, out=np.full(len(both), self.prior), where=both > 0)

    def stretched(self, v: np.ndarray) -> np.ndarray:
        """The vote with `cut` moved to 0.7."""
        return np.where(v < self.cut, 0.7 * v / self.cut, 0.7 + 0.3 * (v - self.cut) / (1 - self.cut))

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.vectors is None:
            return np.full(len(texts), round(self.prior, 6))
        z = self.latent(term_counts(texts))
        v = self.votes(z)
        return np.round(np.where(z.any(1), self.stretched(v), self.prior), 6)


def held_out():
    """Whether a row's label must not be learnt from."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def document_frequency(docs: DataFrame) -> tuple[int, np.ndarray]:
    """The number of rows of docs and, for each term, of those that hold it: one row a term and task."""

    def run(batches):
        n, holds = 0, np.zeros(TERMS, np.int64)
        for batch in batches:
            texts = utf8_list(batch.column(0))
            n += len(texts)
            for lo, hi in in_chunks(texts):
                holds += (term_counts(texts[lo:hi]) > 0).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, TERMS)), pa.array(np.concatenate(([n], holds)))], names=["term", "n"])

    rows = bounded_batches(docs).select(text_or_empty().alias("text")).mapInArrow(tidied(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(TERMS + 1, np.int64)
    for r in rows:
        found[r.term] = r.n  # -1, the number of rows, comes last
    return int(found[-1]), found[:-1]


def _sampled(docs: DataFrame, picked: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts and labels of the picked (doc_id, label), in their order; counts come from the tasks as pairs of two and four bytes."""
    spark = docs.sparkSession
    marks = spark.createDataFrame([(i, k) for k, (i, _) in enumerate(picked)], "doc_id long, place int")  # at most 2 * most rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(F.broadcast(marks), "doc_id").groupBy("place").agg(F.min("text").alias("text"))

    def run(batches):
        for batch in batches:
            places, terms, counts = [], [], []
            t = utf8_list(batch.column(1))
            for lo, hi in in_chunks(t):
                for p, row in zip(batch.column(0).to_pylist()[lo:hi], term_counts(t[lo:hi]), strict=True):
                    at = np.flatnonzero(row)
                    places.append(p)
                    terms.append(at.astype("<u2").tobytes())
                    counts.append(row[at].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())], names=["place", "terms", "counts"])

    out, seen = np.zeros((len(picked), TERMS), np.float32), np.zeros(len(picked), bool)
    for r in bounded_batches(texts).mapInArrow(tidied(run), "place int, terms binary, counts binary").toLocalIterator():
        out[r.place, np.frombuffer(r.terms, "<u2")] = np.frombuffer(r.counts, "<u4")
        seen[r.place] = True
    return out[seen], np.array([y for _, y in picked], float)[seen]


def principal_axes(x: np.ndarray, dims: int) -> np.ndarray:
    """The right singular vectors of x's largest `dims` singular values, by subspace iteration from a fixed start."""
    q = np.random.default_rng(0).standard_normal((x.shape[1], dims + 10))
    for _ in range(5):
        left, _ = np.linalg.qr(x @ q)
        q, _ = np.linalg.qr(x.T @ left)
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ vt.T)[:, : min(dims, *x.shape)]


def best_cut(votes: np.ndarray, labels: np.ndarray) -> float:
    """The cut with the best balanced accuracy on the labelled rows; of equally good ones the nearest to a half."""
    grid = np.arange(1, 20) / 20
    right = [(votes[labels == 1] >= c).mean() + (votes[labels == 0] < c).mean() for c in grid]
    return float(min(zip(np.round(right, 9), grid, strict=True), key=lambda x: (-x[0], abs(x[1] - 0.5), x[1]))[1])


def train(docs: DataFrame, labels: DataFrame, most: int = 2000, dims: int = 48, near: int = 15, power: float = 8.0) -> Model:
    """Fits on at most `most` labelled rows of each class (those of the smallest hash), from whole texts; document frequencies are those of all docs."""
    known = labels.filter("doc_id is not null and quality in (0, 1)").filter(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    n = {r.quality: r.n for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    prior = n.get(1, 0) / sum(n.values()) if n else 0.5
    if len(n) < 2:
        return Model(prior=prior)
    picked = [(r.doc_id, y) for y in (0, 1) for r in bounded_sample(known.filter(F.col("quality") == y), most).collect()]
    counts, y = _sampled(docs, picked)
    if len(set(y.tolist())) < 2:
        return Model(prior=prior)
    rows, holds = document_frequency(docs)
    model = Model(prior=prior, near=near, power=power, idf=np.log((1 + rows) / (1 + holds)) + 1, labels=y)
    x = weighted(counts, model.idf.astype(np.float32))
    model.axes = principal_axes(x, dims).astype(np.float64)
    model.vectors = _unit(x.astype(np.float64) @ model.axes)
    model.cut = best_cut(np.concatenate([model.votes(model.vectors[i : i + 256], copies=False) for i in range(0, len(y), 256)]), y)
    return model


_SCORES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType())])


def quality_scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some four megabytes, whatever the input

    def run(batches):
        m = shared.value
        for batch in batches:
            texts = utf8_list(batch.column(2))
            scores = [m.score(texts[i : min(i + 256, hi)]) for lo, hi in in_chunks(texts) for i in range(lo, hi, 256)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=[f.name for f in _SCORES])

    scored = bounded_batches(docs).select(F.col("doc_id").cast("long"), held_out().alias("held_out"), text_or_empty().alias("text")).mapInArrow(tidied(run), _SCORES)
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
