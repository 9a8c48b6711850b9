"""What the training-data operators share: tables, scratch tables and hashed words.

Scratch tables go to the folder the cluster names in ``spark.checkpoint.dir``;
a folder of our own is made only where that setting is absent (tests, a laptop).
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}

#: The six ASCII white-space bytes.
SPACES = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; on one machine that names none, a folder of this application's own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no shared folder")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _own_dirs[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/terravox-{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes df to a scratch table and reads it back: lineage ends here and its size is known to the planner."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def reopened(df: DataFrame, spark: SparkSession) -> DataFrame:
    """A table of stored() in another session."""
    return spark.read.schema(df.schema).parquet(*{f.rsplit("/", 1)[0] for f in df.inputFiles()})


def drop_scratch(df: DataFrame) -> None:
    """Deletes the files behind a table of stored(), once nothing will read it again."""
    jvm = df.sparkSession._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


#: What a table that is broadcast may take in an executor's memory, and what a row of a narrow key takes in a hash table there.
BROADCAST_BYTES, ROW_BYTES = 64 << 20, 128


def few(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Joins with a written table of narrow rows: broadcast if its counted rows fit in BROADCAST_BYTES, else shuffled."""
    return left.join(F.broadcast(right) if right.count() * ROW_BYTES <= BROADCAST_BYTES else right, on, how)


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches hold at most 1,000 rows and 8 MB: texts are long, and a Python worker keeps the most it ever used."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        now = str(conf.get(key)).rstrip("bB")
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))
    return df


def tidied(run):
    """A mapInArrow function that gives memory back when its partition is done: workers live on, and an executor's memory is shared by all that ever ran."""

    def whole(batches):
        yield from run(batches)
        import ctypes

        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return whole


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def text_key(column: str = "text"):
    """128 bits that stand for a text; null counts as empty."""
    return F.unhex(F.md5(text_or_empty(column)))


# ---------------------------------------------------------------- hashed words

_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _BASE_INV, np.uint64)
        up[0] = down[0] = 1
        _powers = np.cumprod(up), np.cumprod(down)
    return _powers


_is_space = np.zeros(256, bool)
_is_space[list(SPACES)] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def hashed_words(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts, parted at ASCII white space.

    Returns the words' 64-bit hashes, their first and end byte (each within its
    own text) and, for each text, the number of its first word (one more at the end).
    """
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    begins = np.concatenate(([0], np.cumsum(sizes)))
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    if lower:
        buf = _lower[buf]
    inside = ~_is_space[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    up, down = _power_tables(len(buf) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)])))
    h = mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _MULT)
    first = np.searchsorted(start, begins)
    owner = np.repeat(begins[:-1], np.diff(first))
    return h, start - owner, end - owner, first


def shingle_hashes(h: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of `width` words, in order, and each text's first run.

    A text of fewer words, but not none, has one run: all its words.
    """
    counts = np.diff(first)
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    at = np.concatenate(([0], np.cumsum(n)))
    total = int(at[-1])
    begin = np.repeat(first[:-1] - at[:-1], n) + np.arange(total)
    left = np.repeat(first[1:], n) - begin
    out = np.zeros(total, np.uint64)
    padded = np.concatenate((h, np.zeros(width, np.uint64)))
    for k in range(width):
        out = out * _MULT + np.where(left > k, padded[begin + k], np.uint64(0)) + np.uint64(1)
    return mix64(out), at


def in_chunks(texts: list[bytes], max_bytes: int = 1 << 20):
    """Ranges of texts of about max_bytes together; a longer text stands alone."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > max_bytes:
            yield begin, i
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def utf8_list(column) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
