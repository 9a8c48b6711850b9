"""Quality rules: base statistics and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed word uni- and bigrams are counted: the raw corpus
(every document) and the trusted target (documents labelled quality 1, all of
them but a fifth). A document's score is the mean over its n-grams of
log(target / raw); every document is kept or not by one threshold, taken from the
scores of the trusted fifth that was not counted.

The model grows with the corpus: it has about 32 * sqrt(bytes of text) buckets, as
the number of different words grows about as the root of a text's length. Each
task's counts are packed block by block (some two bytes a bucket), shuffled by block and
added up as they come; each task gets the weights as four bytes a bucket (4 MB on
0.5 GB, 34 MB on 30 GB, 2 GB on 100 TB).

Defined results: a null text has no words; a text without words has score 0 and
fails the base rules; repeated rows count each time; an empty table gives no rows;
without trusted rows the ratio is 0 and only the base rules decide; where no trusted
row was held back, the counted ones give the threshold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, few, hashed_words, in_chunks, shingle_hashes, stored, tidied, utf8_list

SYMBOLS = "#*$%&|<>"


def ngram_buckets(h: np.ndarray, first: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all uni- and bigrams and the number of the text each belongs to."""
    counts = np.diff(first)
    doc = np.repeat(np.arange(len(counts)), counts)
    pair = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
    same = doc[:-1] == doc[1:]
    pair = (pair ^ (pair >> np.uint64(29)))[same]
    return np.concatenate((h % np.uint64(buckets), pair % np.uint64(buckets))).astype(np.int64), np.concatenate((doc, doc[:-1][same]))


def repeated_words(h: np.ndarray, first: np.ndarray, width: int = 5) -> np.ndarray:
    """For each text the words that stand in runs of `width` words which the text holds twice or more."""
    counts = np.diff(first)
    runs, at = shingle_hashes(h, first, width)
    enough = counts >= width
    n = np.where(enough, np.diff(at), 0)
    of = np.repeat(np.arange(len(counts)), np.diff(at))
    keep = enough[of] if len(of) else np.zeros(0, bool)
    runs, of = runs[keep], of[keep]
    order = np.lexsort((runs, of))
    r, o = runs[order], of[order]
    equal = (r[1:] == r[:-1]) & (o[1:] == o[:-1])
    twice = np.zeros(len(r), bool)
    twice[1:] |= equal
    twice[:-1] |= equal
    flagged = np.zeros(len(r), bool)
    flagged[order] = twice
    begin = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(len(flagged)) if len(flagged) else np.zeros(0, np.int64)
    step = np.zeros(len(h) + 1, np.int64)
    np.add.at(step, begin[flagged], 1)
    np.add.at(step, begin[flagged] + width, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(step[:-1]) > 0)))
    return covered[first[1:]] - covered[first[:-1]]


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


_symbol = np.zeros(256, np.int64)
_symbol[list(SYMBOLS.encode())] = 1


#: Buckets whose counts are packed together.
BLOCK = 1 << 12


def packed_counts(keys: np.ndarray, n: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Counts n of the sorted keys (2 * bucket + whether trusted), block by block: places in the block as steps, then counts, byte planes compressed together."""
    import zstandard

    z = zstandard.ZstdCompressor(level=1)
    blocks, starts = np.unique(keys // (2 * BLOCK), return_index=True)
    out = []
    for k, m in zip(np.split(keys, starts[1:]), np.split(n, starts[1:]), strict=True):
        planes = np.concatenate((np.diff(k, prepend=k[0] // (2 * BLOCK) * 2 * BLOCK).astype("<u2").view(np.uint8).reshape(-1, 2).T.ravel(), m.astype("<u8").view(np.uint8).reshape(-1, 8).T.ravel()))
        out.append(z.compress(planes.tobytes()))
    return blocks.tolist(), out


def unpacked_counts(block: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(10, -1)
    steps = np.ascontiguousarray(planes[:2].T).view("<u2").ravel().astype(np.int64)
    return block * 2 * BLOCK + np.cumsum(steps), np.ascontiguousarray(planes[2:].T).view("<i8").ravel()


def count_ngrams(docs: DataFrame, trusted: DataFrame, buckets: int, at_once: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the raw corpus and of the trusted rows (doc_id, a written table), by bucket.

    A task's counts are shuffled block by block, packed: some two bytes a bucket. The
    task of a block adds them up as they come, with its own blocks in memory alone.
    """
    marked = few(bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text"), trusted.select("doc_id", F.lit(True).alias("__t")), ["doc_id"], "left")

    def counted(parts):
        blocks, data = packed_counts(*np.unique(np.concatenate(parts), return_counts=True))
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(data, pa.binary())], names=["block", "counts"])

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            texts, flag = utf8_list(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi in in_chunks(texts):
                h, _, _, first = hashed_words(texts[lo:hi])
                b, doc = ngram_buckets(h, first, buckets)
                parts.append(b * 2 + flag[lo:hi][doc])
                size += len(b)
                if size >= at_once:
                    yield counted(parts)
                    parts, size = [], 0
        if size:
            yield counted(parts)

    def summed(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, n = unpacked_counts(block, data)
                np.add.at(sums.setdefault(block, np.zeros(2 * BLOCK, np.int64)), keys - block * 2 * BLOCK, n)
        for block, total in sums.items():
            at = np.flatnonzero(total)
            blocks, data = packed_counts(at + block * 2 * BLOCK, total[at])
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(data, pa.binary())], names=["block", "counts"])

    sums = marked.select("text", F.coalesce("__t", F.lit(False))).mapInArrow(tidied(run), "block long, counts binary").repartition("block").mapInArrow(tidied(summed), "block long, counts binary")
    both = np.zeros((buckets, 2), np.int64)
    for r in sums.toLocalIterator():  # packed blocks of at most `buckets` counts
        keys, n = unpacked_counts(r.block, r.counts)
        both.reshape(-1)[keys] = n
    return both.sum(1).astype(float), both[:, 1].astype(float)


def log_ratio(raw: np.ndarray, target: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    if not target.sum():
        return np.zeros(len(raw))
    n = len(raw)
    return np.log((target + smoothing) / (target.sum() + smoothing * n)) - np.log((raw + smoothing) / (raw.sum() + smoothing * n))


_SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType())]
)


def score_documents(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """Base statistics and mean log ratio of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # bounded: see model_size()
    buckets = len(weights)

    def run(batches):
        w = shared.value
        for batch in batches:
            texts = utf8_list(batch.column(1))
            for lo, hi in in_chunks(texts):
                part = texts[lo:hi]
                h, start, end, first = hashed_words(part)
                n = np.diff(first)
                b, doc = ngram_buckets(h, first, buckets)
                grams = np.maximum(np.bincount(doc, minlength=len(part)), 1)
                score = np.round(np.bincount(doc, w[b], minlength=len(part)) / grams, 9)
                buf = np.frombuffer(b"".join(part), np.uint8)
                at = np.concatenate(([0], np.cumsum([len(t) for t in part])))
                spaces = (buf == 32) | ((buf >= 9) & (buf <= 13))
                points = np.concatenate(([0], np.cumsum(((buf & 0xC0) != 0x80) & ~spaces)))
                symbols = np.concatenate(([0], np.cumsum(_symbol[buf])))
                repeat = repeated_words(h, first)
                failed = (n < 10) | (100 * repeat > 20 * n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(points[at[1:]] - points[at[:-1]], pa.int64()), pa.array(symbols[at[1:]] - symbols[at[:-1]], pa.int64()), pa.array([duplicate_lines(t) for t in part], pa.int64()), pa.array(repeat, pa.int64()), pa.array(failed), pa.array(score)],
                    names=[f.name for f in _SCHEMA],
                )

    return bounded_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(tidied(run), _SCHEMA)


def bounded_sample(ids: DataFrame, most: int) -> DataFrame:
    """At most `most` of the ids, those with the smallest hash, whatever the partitions."""
    return ids.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def model_size(docs: DataFrame) -> int:
    """Buckets of the model of docs: the power of two from 32 * sqrt(bytes of text) on, 2**14 at least."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    return max(1 << 14, 1 << int(np.ceil(np.log2(32 * np.sqrt(size) + 1))))


def held_back(doc_id):
    """Whether a trusted row gives the threshold rather than counts."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def quality_verdicts(docs: DataFrame, labels: DataFrame, buckets: int | None = None, lost: float = 0.002) -> DataFrame:
    """The statistics, score and verdict of every row of docs.

    The threshold is the `lost` quantile of the held-back trusted rows' scores, less
    a margin of their spread: a document is dropped when it is less like the target
    than nearly every trusted one.
    """
    ids = F.col("doc_id").cast("long").alias("doc_id")
    trusted = stored(labels.filter("quality = 1 and doc_id is not null").select(ids).distinct(), "trusted")
    weights = log_ratio(*count_ngrams(docs, stored(trusted.filter(~held_back(F.col("doc_id"))), "counted"), buckets or model_size(docs)))
    scored = stored(score_documents(docs, weights), "scored")
    # Scores in thousandths: few values, so the percentiles' state stays small.
    known = few(scored.filter("not base_failed").select("doc_id", F.round("score", 3).alias("score")), trusted, ["doc_id"], "left_semi")
    at = [F.percentile("score", F.lit(x)) for x in (lost, 0.5)]
    low = known.groupBy(held_back(F.col("doc_id")).alias("back")).agg(*(c.alias(n) for c, n in zip(at, "qm", strict=True))).orderBy(F.desc("back")).first()
    threshold = float("-inf") if low is None else low.q - 0.25 * (low.m - low.q)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(threshold)))
