"""Registered queries of the store, the streams and large files: each writes what the given tables hold and reads it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import custody, positioning
from ..operators.mesh import scratch_path
from ..sources import bundles, fixes, large, meshfiles
from . import adapters as A
from .registry import query

#: The texts of a supplier's finding, one scan in it, its measurements and two seals.
_TEXTS = {
    "finding": """'{"createdAt":"2026-01-01T00:00:00.000Z","findingID":"' || f || '","title":"' || s_name || '"}'""",
    "scan": """'{"scanID":"' || s || '"}'""",
    "measurements": """'[{"kind":"length","unit":"m","value":' || s_nationkey || '}]'""",
    "media": """'{"assetID":"m' || s_nationkey || '"}'""",
    "seal0": """'{"author":"' || s_name || '","index":0}'""",
    "seal1": """'{"author":"' || s_name || '","index":1}'""",
}
_BASE = "cast(s_suppkey as varchar) as f, 's' || s_suppkey as s, s_name, s_nationkey, s_suppkey"


def _items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The items of all suppliers but their seals, and these."""
    base = A.table(spark, sf_dir, "supplier").selectExpr(*(x.replace("varchar", "string") for x in _BASE.split(", ")))
    item = lambda kind, scan, name, text: F.struct(*((F.lit(None) if x is None else F.expr(x)).cast("string").alias(n) for x, n in ((scan, "scan_id"), (f"'{kind}'", "kind"), (name, "item_id"))), F.expr(text).cast("binary").alias("content"))
    rows = lambda *items: base.select(F.col("f").alias("finding_id"), F.explode(F.array(*items)).alias("i")).select("finding_id", "i.*")
    texts = rows(item("finding", None, None, _TEXTS["finding"]), item("scan", "s", None, _TEXTS["scan"]), item("measurements", "s", None, _TEXTS["measurements"]), item("media", "s", "'m' || s_nationkey", _TEXTS["media"]))
    return texts, rows(*(item("seal", None, f"'{i}'", _TEXTS[f"seal{i}"]) for i in (0, 1)))


def _stored(spark: SparkSession, sf_dir: str) -> str:
    """A store of all suppliers, written in two commits."""
    root = scratch_path(spark, "store")
    texts, seals = _items(spark, sf_dir)
    bundles.write_items(texts, root)
    bundles.write_items(seals, root)
    return root


_STORED = f"""b as (select {_BASE} from supplier), i as (
 select f, null as s, 'finding' as kind, null as item, 'finding.json' as p, {_TEXTS['finding']} as t from b
 union all select f, s, 'scan', null, 'scans/' || s || '/scan.json', {_TEXTS['scan']} from b
 union all select f, s, 'measurements', null, 'scans/' || s || '/measurements.json', {_TEXTS['measurements']} from b
 union all select f, s, 'media', 'm' || s_nationkey, 'scans/' || s || '/media/m' || s_nationkey || '.json', {_TEXTS['media']} from b
 union all select f, null, 'seal', null, 'seals/chain.jsonl', {_TEXTS['seal0']} || chr(10) || {_TEXTS['seal1']} || chr(10) from b)"""


@query(f"with {_STORED} select f as finding_id, s as scan_id, kind, item as item_id, strlen(t) as bytes, t as text from i")
def store_items(spark, sf_dir):
    return bundles.read_items(spark, _stored(spark, sf_dir)).withColumn("text", F.decode("content", "UTF-8")).drop("content")


@query(f"with {_STORED} select f as finding_id, s as scan_id, kind, item as item_id, strlen(t) as bytes, t as text from i where kind = 'media' and f in ('1', '3', '7')")
def store_items_of_some(spark, sf_dir):
    wanted = bundles.read_items(spark, _stored(spark, sf_dir)).filter("finding_id in ('1', '3', '7') and kind = 'media'")
    return wanted.withColumn("text", F.decode("content", "UTF-8")).drop("content")


@query(f"with {_STORED} select 'FND-' || f || '/' || p as relative_path, strlen(t) as bytes, sha256(t) as sha256 from i")
def custody_store_hashes(spark, sf_dir):
    return custody.files(spark, _stored(spark, sf_dir))


@query(f"with {A.BOXES} select id::varchar as finding_id, k::bigint as vid, (cx + case when k & 1 > 0 then hx else -hx end)::float::double as x, (cy + case when k & 2 > 0 then hy else -hy end)::float::double as y, (cz + case when k & 4 > 0 then hz else -hz end)::float::double as z from bx, unnest(generate_series(0, 7)) t(k)")
def store_meshes(spark, sf_dir):
    """Meshes are written by the tasks that make them and read back as vertices."""
    box = A.specimen_boxes(spark, sf_dir)
    corner = box.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7))))
    side = lambda b, c: F.col("c" + c) + F.when(F.col("k").bitwiseAND(1 << b) > 0, F.col("h" + c)).otherwise(-F.col("h" + c))
    v = corner.select(F.col("id").cast("long").alias("mesh_id"), F.col("k").cast("long").alias("vid"), *(side(b, c).alias(c) for b, c in enumerate("xyz")))
    f = box.select(F.col("id").cast("long").alias("mesh_id"), F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("fid"), *(F.lit(x).cast("long").alias(n) for n, x in zip("abc", t, strict=True))) for i, t in enumerate(A.CUBE)))).alias("f")).select("mesh_id", "f.*")
    root = scratch_path(spark, "store")
    name = F.col("mesh_id").cast("string")
    ply = meshfiles.encoded(v, f).select(name.alias("finding_id"), F.concat(F.lit("s"), name).alias("scan_id"), F.lit("mesh").alias("kind"), F.lit(None).cast("string").alias("item_id"), "content")
    own = _items(spark, sf_dir)[0].filter("kind in ('finding', 'scan')")
    bundles.write_items(own.unionByName(ply), root)
    found = bundles.read_items(spark, root).filter("kind = 'mesh'")
    return meshfiles.decoded_ply(found.select(F.col("finding_id").cast("long").alias("mesh_id"), "content"))[0].select(F.col("mesh_id").cast("string").alias("finding_id"), "vid", "x", "y", "z")


@query(f"with {A.FIXES} select burst_id::varchar as burst_id, ord::bigint as ord, ts::timestamp as ts, latitude, horizontal_accuracy, case when horizontal_accuracy > 10 then 'horizontal accuracy' end as reason, horizontal_accuracy <= 10 as accepted from fx")
def geo_fix_stream(spark, sf_dir):
    """Fixes are logged, streamed from the logs through the gate and read from the stream's table."""
    logs, out = scratch_path(spark, "logs"), scratch_path(spark, "fixes")
    rows = A.fixes(spark, sf_dir).select(F.col("burst_id").cast("string").alias("burst_id"), "ord", "latitude", "longitude", "altitude", "horizontal_accuracy", "vertical_accuracy", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("ts"))
    rows.select(F.to_json(F.struct("*")).alias("value")).write.text(logs)
    stream = positioning.gated(fixes.from_logs(spark, logs, ".txt"))
    stream.writeStream.format("parquet").option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).select("burst_id", "ord", "ts", "latitude", "horizontal_accuracy", "reason", "accepted")


_UTM = {"easting": 350000.0, "northing": 6300000.0, "height": 500.0, "epsg": 32719}


@query(f"with {A.PTS}, p as (select distinct x, y, z from pts) select trunc(round(x / 1e-3, 6))::bigint as gx, trunc(round(y / 1e-3, 6))::bigint as gy, trunc(round(z / 1e-3, 6))::bigint as gz, count(*) as n from p group by all")
def codec_large_las(spark, sf_dir):
    """All points as one cloud file, written and read by ranges: how many points each place of the grid has."""
    path = f"{scratch_path(spark, 'cloud')}.las"
    p = A.points(spark, sf_dir)
    large.write_las(p.withColumn("vid", F.struct(*A.PTS_ORDER)), _UTM, path)
    return large.read_las(spark, path).groupBy("gx", "gy", "gz").agg(F.count("*").alias("n"))


@query(f"with {A.SOUP_V}, s as (select *, row_number() over (order by vid) - 1 as i from sv) select i as vid, x::float::double as x, y::float::double as y, z::float::double as z from s")
def codec_large_ply(spark, sf_dir):
    return _soup_file(spark, sf_dir)[0]


@query(f"with {A.SOUP_V}, {A.SOUP_T}, s as (select vid, row_number() over (order by vid) - 1 as i from sv) select row_number() over (order by fid) - 1 as fid, a.i as a, b.i as b, c.i as c from st join s a on st.a = a.vid join s b on st.b = b.vid join s c on st.c = c.vid")
def codec_large_ply_faces(spark, sf_dir):
    return _soup_file(spark, sf_dir)[1]


def _soup_file(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    path = f"{scratch_path(spark, 'mesh')}.ply"
    large.write_ply(A.soup_vertices(spark, sf_dir), A.soup_faces(spark, sf_dir), path)
    return bundles.read_mesh(spark, path)
