"""Merkle manifest of a table of documents, climbed by a recursive query.

Every row is a leaf; a language's leaves, in order of doc_id, are hashed two by two
up to its subroot, and the subroots likewise to the root. Levels are built
`stride` at a time: the 2**stride nodes under one ancestor are one small group, and
each of them becomes a row that is linked to that ancestor and carries the
siblings on the way to it (with a stride of 1 that is the parent and the one
sibling). Rows of all strides are written tables. A recursive query starts at
the leaves, joins the row that each link names, appends its siblings to the proof
and folds them into the hash, until it comes to the root: about
log2(documents) / stride rounds, whose joins meet at most 2**-stride as many rows as
there are documents.

Places are counted without any window over a language: rows are dealt by ranges of
(lang, doc_id, leaf), numbered within a task, and shifted by the counts of the tasks before.

Defined results: null fields are hashed as `-`; rows with the same doc_id are leaves
in order of their hash, so equal rows change nothing; a null doc_id comes first and
is never tampered with; extra columns play no part; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sessions import own_session
from .common import BROADCAST_BYTES, few, reopened, stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A step of a proof: the sibling's side (- for none) and its digest.
STEP = 33


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def hex_text(column) -> Column:
    return F.lower(F.hex(column))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, lang, leaf, tampered (null where tampering changes nothing) of every row."""
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    fields = [field(F.col(c)) for c in FIELDS]
    changed = [field(F.col(c) + 1) if c == "n_chars" else field(F.col(c)) for c in FIELDS]
    return docs.select("doc_id", "lang", digest(*fields).alias("leaf"), F.when(hit & F.col("n_chars").isNotNull(), digest(*changed)).alias("tampered"))


def placed(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """rows with `idx`, their place from 0 within `by` (null is one group), whose groups may be of any size."""
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(1024))  # parts rows that are equal in all else
    dealt = rows.withColumn("spread", spread).repartitionByRange(by, *order, "spread").sortWithinPartitions(by, *order)
    at = stored(dealt.drop("spread").withColumn("at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("at", 33)
    runs = at.groupBy(by, part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.expr(f"sum(n) over (partition by {by} order by part rows between unbounded preceding and 1 preceding)"), F.lit(0))
    shifts = stored(runs.select(F.col(by).alias("of"), F.col("part").alias("in"), (before - F.col("first")).alias("shift")), "shifts")
    small = F.broadcast(shifts) if shifts.count() * 128 <= BROADCAST_BYTES else shifts
    return at.join(small, F.col(by).eqNullSafe(F.col("of")) & (part == F.col("in"))).withColumn("idx", F.col("at") + F.col("shift")).drop("at", "of", "in", "shift")


def _parents(below: list[bytes]) -> list[bytes]:
    return [hashlib.sha256(b"".join(x.hex().encode() for x in below[i : i + 2])).digest() for i in range(0, len(below), 2)]


def _climbed(stride: int, tail: pa.Schema):
    """Of one block of nodes: a row for each node with its proof up to their ancestor, and one for the ancestor."""

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("idx")
        level = [x or b"" for x in block["hash"].to_pylist()]
        grp, left, first = block["grp"][0].as_py(), block["left"][0].as_py(), block["idx"][0].as_py()
        proofs, at = [bytearray() for _ in level], list(range(len(level)))
        for _ in range(min(stride, left)):
            for proof, i in zip(proofs, at, strict=True):
                proof += (b"L" if i & 1 else b"R") + level[i ^ 1] if i ^ 1 < len(level) else b"-" + bytes(32)
            level, at = _parents(level), [i >> 1 for i in at]
        n = len(proofs)
        own = {"grp": [grp] * (n + 1), "idx": [*block["idx"].to_pylist(), first >> stride], "hash": [*block["hash"].to_pylist(), level[0]], "left": [left] * n + [max(0, left - stride)], "proof": [*map(bytes, proofs), None], "head": [False] * n + [True]}
        return pa.table([pa.array(own[f.name] if f.name in own else [*block[f.name].to_pylist(), None], f.type) for f in tail], schema=tail)

    return run


@dataclass
class Manifest:
    """leaves(doc_id, grp, leaf, tampered, proof, up_*), nodes(grp, stage, idx, proof, up_*), subroots(grp, hash) and the root; groups are languages, group 0 their subroots."""

    leaves: DataFrame | None
    nodes: DataFrame | None
    subroots: DataFrame | None
    root: bytes | None


def _up(grp, stage, idx) -> list[Column]:
    return [grp.cast("long").alias("up_grp"), stage.cast("int").alias("up_stage"), idx.cast("long").alias("up_idx")]


def _tree(foot: DataFrame, stride: int, top: bool, stage: int = 0) -> tuple[list[DataFrame], DataFrame]:
    """Rows of all stages of a table of trees (grp, idx, hash, left, ...), and the trees' last nodes."""
    made, done = [], []
    while True:
        schema = pa.schema([pa.field(n, t) for n, t in (("grp", pa.int64()), ("idx", pa.int64()), ("hash", pa.binary()), ("left", pa.int32()), ("proof", pa.binary()), ("head", pa.bool_()))] + ([pa.field("doc_id", pa.int64()), pa.field("tampered", pa.binary())] if not made and not top else []))
        spark_schema = ", ".join(f"`{f.name}` {dict(int64='long', binary='binary', int32='int', bool='boolean')[str(f.type)]}" for f in schema)
        block = F.shiftright("idx", stride).alias("block")
        both = stored(foot.groupBy("grp", block).applyInArrow(_climbed(stride, schema), spark_schema), "merkle")
        on = F.col("left") > stride
        end = (F.lit(None), F.lit(None), F.lit(None)) if top else (F.lit(0), F.lit(0), F.col("grp") - 1)
        ups = _up(*(F.when(on, a).otherwise(b) for a, b in zip((F.col("grp"), F.lit(stage + 1), F.shiftright("idx", stride)), end, strict=True)))
        made.append(both.filter("not head").select("*", F.lit(stage).alias("stage"), *ups).drop("head", "left"))
        heads = both.filter("head").select("grp", "idx", "hash", "left")
        done.append(heads.filter("left = 0").select("grp", "hash"))
        foot, stage = heads.filter("left > 0"), stage + 1
        if foot.isEmpty():
            ends = done[0]
            for d in done[1:]:
                ends = ends.unionByName(d)
            return made, ends


def build(docs: DataFrame, stride: int = 10) -> Manifest:
    """The manifest of docs, as written tables.

    Spark bounds a recursion's rows by a setting; it is lifted in a session of the manifest's own.
    """
    spark = own_session(docs.sparkSession, {"spark.sql.cteRecursionRowLimit": "-1", "spark.sql.cteRecursionLevelLimit": "-1"})
    ordered = placed(reopened(stored(leaves(docs), "leaves"), spark), "lang", ["doc_id", "leaf"])
    sizes = stored(ordered.groupBy("lang").agg(F.count("*").alias("n")), "sizes")
    if sizes.isEmpty():
        return Manifest(None, None, None, None)
    # Languages in bytewise order, null first; group 0 is the tree of their subroots.
    depth = lambda n: F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)
    langs = stored(placed(sizes.withColumn("all", F.lit(0)), "all", ["lang"]).select(F.col("lang").alias("of"), (F.col("idx") + 1).alias("grp"), depth(F.col("n")).alias("left")), "langs")
    count = langs.count()
    small = F.broadcast(langs) if count * 128 <= BROADCAST_BYTES else langs
    foot = ordered.join(small, F.col("lang").eqNullSafe(F.col("of"))).select("grp", "idx", F.col("leaf").alias("hash"), "left", F.col("doc_id").cast("long").alias("doc_id"), "tampered")
    made, ends = _tree(foot, stride, top=False)
    subroots = stored(ends, "subroots")
    over, root = _tree(subroots.select(F.lit(0).cast("long").alias("grp"), (F.col("grp") - 1).alias("idx"), "hash", F.lit(max(0, count - 1).bit_length()).alias("left")), stride, top=True)
    nodes = None
    for part in [*made[1:], *over]:
        part = part.select("grp", "stage", "idx", "proof", "up_grp", "up_stage", "up_idx")
        nodes = part if nodes is None else nodes.unionByName(part)
    return Manifest(made[0].withColumnRenamed("hash", "leaf"), stored(nodes, "nodes"), subroots, bytes(root.first().hash))


def folded(proof: str, start: str) -> str:
    """SQL that hashes `start` up along a proof."""
    sibling, own = f"lower(hex(substring({proof}, {STEP} * i + 2, 32)))", "lower(hex(acc))"
    h = lambda x: f"unhex(sha2(cast({x} as binary), 256))"
    step = f"case substring({proof}, {STEP} * i + 1, 1) when X'4C' then {h(f'concat({sibling}, {own})')} when X'52' then {h(f'concat({own}, {sibling})')} else {h(own)} end"
    return f"case when octet_length({proof}) = 0 then {start} else aggregate(sequence(0, cast(octet_length({proof}) div {STEP} as int) - 1), {start}, (acc, i) -> {step}) end"


def climb(manifest: Manifest) -> DataFrame:
    """doc_id, grp, leaf, proof, folded of every leaf, by a recursive query that ascends from link to link."""
    spark = manifest.leaves.sparkSession
    hint = "/*+ BROADCAST(n) */" if manifest.nodes.count() * 512 <= BROADCAST_BYTES else ""
    sql = f"""with recursive climb as (
 select doc_id, grp, leaf, proof, {folded("proof", "coalesce(tampered, leaf)")} as folded, up_grp, up_stage, up_idx from {{leaves}}
 union all
 select {hint} c.doc_id, c.grp, c.leaf, concat(c.proof, n.proof), {folded("n.proof", "c.folded")}, n.up_grp, n.up_stage, n.up_idx
 from climb c join {{nodes}} n on c.up_grp = n.grp and c.up_stage = n.stage and c.up_idx = n.idx)
select doc_id, grp, leaf, proof, folded from climb where up_grp is null"""
    return spark.sql(sql, leaves=manifest.leaves, nodes=manifest.nodes)


def merkle_proofs(docs: DataFrame, stride: int = 10) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of docs."""
    manifest = build(docs, stride)
    if manifest.root is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    up = climb(manifest)
    steps = f"sequence(0, cast(octet_length(proof) div {STEP} as int) - 1)"
    siblings = f"array_join(transform(filter({steps}, i -> substring(proof, {STEP} * i + 1, 1) <> X'2D'), i -> lower(hex(substring(proof, {STEP} * i + 2, 32)))), '')"
    text = f"case when octet_length(proof) = 0 then '' else {siblings} end"
    root = F.lit(manifest.root)
    return few(up, manifest.subroots.withColumnRenamed("hash", "subroot"), ["grp"]).select("doc_id", hex_text("leaf").alias("leaf"), hex_text("subroot").alias("subroot"), hex_text(root).alias("root"), F.sha2(F.expr(text).cast("binary"), 256).alias("proof_sha256"), hex_text("folded").alias("folded_root"), (F.col("folded") == root).alias("verified"))
