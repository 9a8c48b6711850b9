"""Byte-level BPE by overlapping chunks.

A long text is cut into chunks that overlap; the chunks are rows of their own,
so Spark spreads them. Each chunk is pre-tokenised alone. Its first boundaries
may be wrong, since it begins anywhere, but pre-tokenising has no memory: from
the first boundary that the chunk before also found, both agree (`stitch`). There
the texts are cut, and the pieces between the cuts are encoded apart. Where two
chunks share no boundary in their overlap, the chunk joins the piece before it,
and the next chunk stitches again: on a boundary that every pre-tokenising has
wherever it begins (`SURE`), since what came before is not known. So a piece is
long only where no such boundary stands in the overlaps, as in one unbroken run
of letters, which is one pre-token and cannot be cut. A text of one chunk is
encoded as it is. Decoding joins the ids' raw bytes.

Defined results: a null text is empty (no ids, empty bytes); special tokens'
strings are ordinary text; repeated rows each give a row.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, text_or_empty, tidied


class ChunkCodec:
    def __init__(self, ranks_path: str, pattern: str):
        import regex
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.sure = regex.compile(SURE)

    def boundaries(self, text: str, begin: int = 0, end: int | None = None) -> list[int]:
        """Where pre-tokens begin within [begin, end) when text is split from its start."""
        return [m.start() for m in self.pattern.finditer(text) if m.start() >= begin and (end is None or m.start() < end)]

    def encode(self, text: str, limit: int) -> np.ndarray:
        if len(text) <= limit:
            return np.array(self.encoding.encode_ordinary(text), "<u4")
        ids: list[int] = []
        for m in self.pattern.finditer(text):
            ids += self.encoding._encode_single_piece(m.group().encode())
        return np.array(ids, "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return self.encoding.decode_bytes(ids.tolist())


#: Between a letter or a number and what is neither, nor a mark or an apostrophe: a pre-token of the public patterns ends here whatever stands before it.
SURE = r"(?<=[\p{L}\p{N}])(?=[^\p{L}\p{N}\p{M}'\u2019])"


def cuttable(text: str, at: int) -> bool:
    """Whether a boundary at `at` may be a cut: not after white space, whose pre-tokens look ahead."""
    return 0 < at < len(text) and not text[at - 1].isspace()


def stitch(tail: list[int], head: list[int]) -> int | None:
    """The first boundary on which the chunk before (`tail`) and this chunk (`head`) agree."""
    both = set(tail).intersection(head)
    return min(both) if both else None


_codecs: dict[tuple[str, str], ChunkCodec] = {}


def codec(ranks_path: str, pattern: str) -> ChunkCodec:
    if (ranks_path, pattern) not in _codecs:
        _codecs[ranks_path, pattern] = ChunkCodec(ranks_path, pattern)
    return _codecs[ranks_path, pattern]


_PIECE = "struct<ids:binary,decoded:binary>"


def _encoded(ranks_path: str, pattern: str, limit: int):
    @F.arrow_udf(_PIECE)
    def encoded(texts: pa.Array) -> pa.Array:
        c = codec(ranks_path, pattern)
        ids = [c.encode(t, limit) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([i.tobytes() for i in ids], pa.binary()), pa.array([c.decode(i) for i in ids], pa.binary())], names=["ids", "decoded"])

    return encoded


def _digests(ranks_path: str, pattern: str, limit: int, schema: T.StructType, with_ids: bool):
    """Short texts, one row each: digests of ids and decoded bytes, and the ids if wanted."""

    def run(batches):
        c = codec(ranks_path, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                ids = [c.encode(t, limit) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(i) for i in ids], pa.int64()),
                        pa.array([hashlib.sha256(i.tobytes()).hexdigest() for i in ids], pa.string()),
                        pa.array([hashlib.sha256(c.decode(i)).hexdigest() for i in ids], pa.string()),
                        *([pa.array([i.tobytes() for i in ids], pa.binary())] if with_ids else []),
                    ],
                    names=[f.name for f in schema],
                )

    return run


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, chunk: int = 1 << 15, overlap: int = 1 << 11, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, <u4 bytes, if wanted) of every row of docs."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())] + ([T.StructField("ids", T.BinaryType())] if with_ids else []))
    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    whole = chunk + overlap
    short = rows.filter(F.length("text") <= whole).mapInArrow(tidied(_digests(ranks_path, pattern, whole, schema, with_ids)), schema)
    return short.unionByName(_long_texts(rows.filter(F.length("text") > whole), ranks_path, pattern, chunk, overlap, with_ids))


def cut_pieces(rows: DataFrame, ranks_path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """doc_id, row, k, piece: the pieces of rows (doc_id, text), in the order of k, which may be pre-tokenised apart."""
    # A row number of its own tells repeated rows apart; it is drawn before the shuffle and travels with the row.
    rows = rows.select("doc_id", "text", F.struct(F.coalesce("doc_id", F.lit(0)), F.md5("text"), F.monotonically_increasing_id()).alias("row"))
    chunks = rows.select(
        "doc_id", "row", F.length("text").alias("length"), "text", F.explode(F.sequence(F.lit(0), F.expr(f"int((length(text) - {overlap} - 1) / {chunk})"))).alias("k")
    ).select("doc_id", "row", "length", "k", F.expr(f"substring(text, k * {chunk} + 1, {chunk + overlap})").alias("text"))

    @F.arrow_udf("struct<head:array<int>,tail:array<int>,sure:int>")
    def edges(texts: pa.Array, ks: pa.Array) -> pa.Array:
        c, heads, tails, sures = codec(ranks_path, pattern), [], [], []
        for t, k in zip(texts.to_pylist(), ks.to_pylist(), strict=True):
            at = [b for b in c.boundaries(t) if cuttable(t, b)]
            k0 = int(k) * chunk
            heads.append([k0 + b for b in at if b < overlap] if k else [])
            # What stands last may go on behind the chunk's end.
            tails.append([k0 + b for b in at[:-1] if b >= chunk])
            sure = c.sure.search(t, 1) if k else None
            sures.append(k0 + sure.start() if sure and sure.start() < overlap and sure.start() < len(t) else None)
        lists = pa.list_(pa.int32())
        return pa.StructArray.from_arrays([pa.array(heads, lists), pa.array(tails, lists), pa.array(sures, pa.int32())], names=["head", "tail", "sure"])

    @F.arrow_udf("int")
    def agreed(tails: pa.Array, heads: pa.Array) -> pa.Array:
        return pa.array([stitch(t or [], h) for t, h in zip(tails.to_pylist(), heads.to_pylist(), strict=True)], pa.int32())

    by_row = Window.partitionBy("row").orderBy("k")
    # The chunks of one text are dealt over all tasks, by row and number.
    found = chunks.repartition(F.col("row"), F.col("k")).withColumn("e", edges("text", F.col("k")))
    joined = found.select("doc_id", "row", "k", "length", "text", "e.head", "e.sure", F.lag("e.tail").over(by_row).alias("before"))
    joined = joined.withColumn("agreed", F.when(F.col("k") == 0, F.lit(0)).otherwise(agreed("before", "head"))).drop("head", "before")
    # A chunk begins a piece if it agrees with one that does, or has a sure boundary of its own.
    joined = joined.withColumn("stretch", F.sum(F.col("agreed").isNull().cast("int")).over(by_row))
    joined = joined.withColumn("known", F.max((F.col("k") == 0) | F.col("sure").isNotNull()).over(Window.partitionBy("row", "stretch").orderBy("k")))
    cut = F.when(F.col("agreed").isNotNull() & ((F.col("k") == 0) | F.lag("known").over(by_row)), F.col("agreed")).when(F.col("known"), F.col("sure"))
    joined = joined.withColumn("cut", cut)
    # Chunks without a cut give what follows their overlap to the piece before.
    joined = joined.withColumn("piece", F.sum(F.col("cut").isNotNull().cast("int")).over(by_row))
    begin = F.coalesce("cut", F.col("k") * chunk + overlap)
    end = F.coalesce(F.lead("cut").over(by_row), F.least(F.col("length"), (F.col("k") + 1) * chunk + overlap))
    parts = joined.withColumn("begin", begin).withColumn("end", end).select("doc_id", "row", "piece", "k", F.expr(f"substring(text, begin - k * {chunk} + 1, end - begin)").alias("text"))
    pieces = parts.groupBy("row", "piece").agg(F.first("doc_id").alias("doc_id"), F.min("k").alias("k"), F.array_sort(F.collect_list(F.struct("k", "text"))).alias("parts"))
    pieces = pieces.select("doc_id", "row", "k", F.concat_ws("", "parts.text").alias("piece"))
    return pieces


def _long_texts(rows: DataFrame, ranks_path: str, pattern: str, chunk: int, overlap: int, with_ids: bool) -> DataFrame:
    pieces = cut_pieces(rows, ranks_path, pattern, chunk, overlap)
    done = pieces.repartition(F.col("row"), F.col("k")).withColumn("p", _encoded(ranks_path, pattern, 2 * chunk + overlap)("piece"))
    whole = done.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("k", "p"))).alias("ps"))
    ids = F.expr("aggregate(ps, cast('' as binary), (a, x) -> concat(a, x.p.ids))")
    decoded = F.expr("aggregate(ps, cast('' as binary), (a, x) -> concat(a, x.p.decoded))")
    out = whole.select("doc_id", ids.alias("ids"), decoded.alias("decoded")).select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids")
    return out if with_ids else out.drop("ids")
