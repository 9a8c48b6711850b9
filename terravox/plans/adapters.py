"""The given tables as the engine's inputs, each beside the SQL that means the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_PTS = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_returnflag, l_quantity / 5e1 as x, l_extendedprice / 1.05e5 as y, l_discount * 1e1 + 0e0 as z"
PTS = f"pts as (select {_PTS} from lineitem)"
#: A whole order of the points.
PTS_ORDER = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point for each line item, in a box of one metre."""
    return table(spark, sf_dir, "lineitem").selectExpr(*_PTS.split(", "))


#: Rows of one task whose meshes are made by exploding.
MESHES_A_TASK = 20_000


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows, hashed by key over a task for every `MESHES_A_TASK`; a small file is one task, whatever its rows are exploded to."""
    return rows.repartition(1 + rows.count() // MESHES_A_TASK, key)


#: A cuboid's twelve outward faces; corner k lies at the signs of its three bits.
CUBE = ((0, 2, 1), (1, 2, 3), (4, 5, 6), (5, 7, 6), (0, 1, 4), (1, 5, 4), (2, 6, 3), (3, 6, 7), (0, 4, 2), (2, 4, 6), (1, 3, 5), (3, 7, 5))
_PARTS = "p_partkey as mesh_id, cast(p_partkey % 97 as double) as cx, p_size / 1e1 as cy, cast(p_partkey % 89 as double) as cz, 1e-1 + p_size / 2e2 as hx, 2e-1 + (p_partkey % 5) / 1e1 as hy, 2.5e-1 as hz"


def part_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A closed box for each part: its eight corners."""
    box = dealt(table(spark, sf_dir, "part").selectExpr(*_split(_PARTS)), "mesh_id").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return box.select("mesh_id", F.col("k").cast("long").alias("vid"), *((F.col("c" + c) + F.when(F.col("k").bitwiseAND(1 << b) > 0, F.col("h" + c)).otherwise(-F.col("h" + c))).alias(c) for b, c in enumerate("xyz")))


def part_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = F.array(*(F.struct(F.lit(i).cast("long").alias("fid"), *(F.lit(v).cast("long").alias(n) for n, v in zip("abc", f, strict=True))) for i, f in enumerate(CUBE)))
    return dealt(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("mesh_id")), "mesh_id").select("mesh_id", F.explode(faces).alias("f")).select("mesh_id", "f.*")


PART_V = f"""pv as (select mesh_id, k as vid, cx + case when (k & 1) > 0 then hx else -hx end as x, cy + case when (k & 2) > 0 then hy else -hy end as y,
 cz + case when (k & 4) > 0 then hz else -hz end as z from (select {_PARTS} from part) p, unnest(generate_series(0, 7)) t(k))"""
PART_F = "pf as (select p_partkey as mesh_id, fid, a, b, c from part, (values " + ", ".join(f"({i}, {a}, {b}, {c})" for i, (a, b, c) in enumerate(CUBE)) + ") f(fid, a, b, c))"
PART_T = "pt as (select f.*, " + ", ".join(f"{k}.{c} as {k}{c}" for k in ("va", "vb", "vc") for c in "xyz") + " from pf f join pv va on va.mesh_id = f.mesh_id and va.vid = f.a join pv vb on vb.mesh_id = f.mesh_id and vb.vid = f.b join pv vc on vc.mesh_id = f.mesh_id and vc.vid = f.c)"


def soup_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vertex for each embedding: its first three components times ten."""
    return table(spark, sf_dir, "embeddings").select(F.lit(0).cast("long").alias("mesh_id"), F.col("vec_id").alias("vid"), "label", *((F.col("embedding")[i].cast("double") * 10.0).alias(c) for i, c in enumerate("xyz")))


def soup_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A face for every three embeddings in order of id, where all three are there."""
    k = F.floor(F.col("vec_id") / 3).cast("long")
    return table(spark, sf_dir, "embeddings").groupBy(k.alias("fid")).agg(F.count("*").alias("n")).filter("n = 3").select(F.lit(0).cast("long").alias("mesh_id"), "fid", (F.col("fid") * 3).alias("a"), (F.col("fid") * 3 + 1).alias("b"), (F.col("fid") * 3 + 2).alias("c"))


SOUP_V = "sv as (select vec_id as vid, label, embedding[1]::double * 1e1 as x, embedding[2]::double * 1e1 as y, embedding[3]::double * 1e1 as z from embeddings)"
SOUP_T = "st as (select a.vid // 3 as fid, a.vid as a, b.vid as b, c.vid as c, " + ", ".join(f"{k}.{c} as {k}{c}" for k in "abc" for c in "xyz") + " from sv a join sv b on b.vid = a.vid + 1 join sv c on c.vid = a.vid + 2 where a.vid % 3 = 0)"

_FIXES = "user_id as burst_id, event_id as ord, ts, -33e0 + value / 1e3 as latitude, -70e0 + user_id / 1e3 as longitude, value * 1e1 as altitude, 1e0 + floor(value) % 20 as horizontal_accuracy, 2e0 + floor(value) % 7 as vertical_accuracy, value, event_type"
FIXES = f"fx as (select {_FIXES} from events)"


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A GPS fix for each event; a user's events are a burst."""
    return table(spark, sf_dir, "events").selectExpr(*_split(_FIXES)).withColumn("horizontal_accuracy", F.col("horizontal_accuracy").cast("double")).withColumn("vertical_accuracy", F.col("vertical_accuracy").cast("double"))


TRACK = "tk as (select burst_id, ord, ts, (ord % 101) / 1e1 as tx, 0e0 as ty, value / 1e1 as tz from fx where event_type in ('click', 'view'))"


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A camera place for each click or view."""
    return fixes(spark, sf_dir).filter("event_type in ('click', 'view')").selectExpr("burst_id", "ord", "ts", "(ord % 101) / 1e1 as tx", "0e0 as ty", "value / 1e1 as tz")


_BOXES = "cast(floor(s_suppkey / 1e1) as bigint) as scan, s_suppkey as id, cast(s_suppkey % 13 as double) / 4e0 as cx, s_nationkey / 5e0 as cy, cast(s_suppkey % 7 as double) / 4e0 as cz, 2.5e-1 as hx, 2e-1 as hy, 3e-1 as hz"
BOXES = f"bx as (select {_BOXES} from supplier)"


def specimen_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A specimen's box for each supplier, ten to a scan."""
    return table(spark, sf_dir, "supplier").selectExpr(*_split(_BOXES))


def _split(text: str) -> list[str]:
    """Parts between the commas that stand outside brackets."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(text[last:i].strip())
            last = i + 1
    return [*out, text[last:].strip()]


MARKS = "mk as (select p_size % 5 as profile_id, p_partkey as ord, 'b' || (p_size % 3) as boundary_id, p_retailprice / 1e3 as x, (p_size % 3) * 1.2e-1 + (p_partkey % 11) / 1e3 as y, cast(p_partkey % 17 as double) / 1e1 as z from part)"


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A boundary mark for each part: five profiles of three levels."""
    return table(spark, sf_dir, "part").selectExpr("p_size % 5 as profile_id", "p_partkey as ord", "concat('b', p_size % 3) as boundary_id", "p_retailprice / 1e3 as x", "(p_size % 3) * 1.2e-1 + (p_partkey % 11) / 1e3 as y", "cast(p_partkey % 17 as double) / 1e1 as z")
