"""Registered queries of exports, seals and composites that the catalog's tables give."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..errors import GeoError
from ..functions import canonical as C
from ..operators import custody, mesh, positioning, registration, segmentation, store, volume
from ..sources import records
from . import adapters as A
from .catalog import _AXES, _BOX
from .registry import query, r, rounded
from .stores import _stored


@query(f"""select 2 as section, '' as ord, '' as line union all select 2, '0', '{records.MEASUREMENT_COLUMNS}' union all
select 2, '1' || lpad(cast(s_suppkey as varchar), 19, '0'), s_suppkey || ',length,' || (s_suppkey / 4e0) || ',m,"tape, ' || s_name || '",' || (s_suppkey % 2 = 0) || ',' || case when s_suppkey % 3 = 0 then '' else ((s_nationkey + 5e-1)::varchar) end from supplier""")
def export_csv_measurements(spark, sf_dir):
    s = A.table(spark, sf_dir, "supplier")
    rows = s.select(F.col("s_suppkey").alias("measurement_id"), F.lit("length").alias("kind"), (F.col("s_suppkey") / 4.0).alias("value"), F.lit("m").alias("unit"), F.concat(F.lit("tape, "), F.col("s_name")).alias("method"), (F.col("s_suppkey") % 2 == 0).alias("is_inferred"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_nationkey") + 0.5).alias("uncertainty"))
    return records.measurement_lines(rows, "measurement_id")


@query("select event_id, ts::timestamp as instant from (select event_id, date_trunc('millisecond', ts) as ts from events) union all select -event_id - 1, null from events where event_id % 50 = 0")
def canonical_iso_parse(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").select("event_id", C.iso_ms(F.date_trunc("millisecond", F.col("ts"))).alias("t"))
    odd = e.filter("event_id % 50 = 0").select((-F.col("event_id") - 1).alias("event_id"), F.concat(F.lit("on "), F.col("t")).alias("t"))
    return e.unionByName(odd).select("event_id", C.parsed_iso(F.col("t")).alias("instant"))


_SUPPORT = _AXES.replace(A.SOUP_V, A.SOUP_V.replace("sv as (select", "s0 as (select") + ", sv as (select vid, 0 as label, x, y, z from s0 order by vid limit 300)")


@query(f"with {_SUPPORT} select {', '.join(r('m' + c, c) for c in 'xyz')}, {', '.join(r(f'w{c} * case when wy >= 0 then 1 else -1 end', 'n' + c) for c in 'xyz')} from ax")
def volume_support_plane(spark, sf_dir):
    p, n = volume.support_plane(A.soup_vertices(spark, sf_dir), "vid", 300)
    n = n if n[1] >= 0 else tuple(-c for c in n)
    return rounded(spark.createDataFrame([(*p, *n)], "x double, y double, z double, nx double, ny double, nz double"))


_KEY = b"terravox"
_PAD = {k: bytes(x ^ b for x in _KEY.ljust(64, b"\0")).hex() for k, b in (("in", 0x36), ("out", 0x5C))}
#: A keyed hash by its definition.
_HMAC = f"sha256(unhex('{_PAD['out']}') || unhex(sha256(unhex('{_PAD['in']}') || encode({{t}}))))"
_SEALED = "sha256(coalesce(text, '')) || '|' || (turn * 1000) || '|' || role"


def _seals(spark, sf_dir):
    c = A.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(F.coalesce("text", F.lit("")), 256).alias("root_hash"), (F.col("turn") * 1000).cast("long").alias("ms"), F.col("role").alias("author"))
    return custody.signatures(c.withColumn("text", custody.payload_text(F.col("root_hash"), F.col("ms"), F.col("author"))), custody.HmacSigner(_KEY))


@query(f"select conv_id, turn, {_HMAC.format(t=_SEALED)} as signature from conversations")
def custody_signatures(spark, sf_dir):
    return _seals(spark, sf_dir).select("conv_id", "turn", "signature")


@query("select conv_id, turn, turn % 4 <> 3 and turn % 5 <> 4 as genuine from conversations")
def custody_signature_checks(spark, sf_dir):
    """Some seals are signed for another text, some signatures are no hex."""
    s = _seals(spark, sf_dir)
    forged = F.when(F.col("turn") % 5 == 4, "not hex").otherwise(F.col("signature"))
    changed = s.withColumn("text", F.when(F.col("turn") % 4 == 3, F.concat("text", F.lit("x"))).otherwise(F.col("text"))).withColumn("signature", forged)
    return custody.signature_checks(changed, custody.HmacSigner(_KEY)).select("conv_id", "turn", "genuine")


@query("""select s_suppkey::varchar as "findingID", s_name as title, '2026-01-01T00:00:00.000Z' as "createdAt", 1::bigint as scan_count from supplier""")
def store_rebuilt_index(spark, sf_dir):
    return store.rebuilt_index(spark, _stored(spark, sf_dir))


@query()
def roi_split_welded(spark, sf_dir):
    pieces = mesh.clipped_faces(mesh.triangles(A.soup_vertices(spark, sf_dir), A.soup_faces(spark, sf_dir)), **_BOX)
    return rounded(mesh.welded(pieces)[0])


@query(f"with {A.SOUP_V} select label, count(*) as n from sv where x > 0 group by label having count(*) >= 3")
def segment_reboxed(spark, sf_dir):
    v = A.soup_vertices(spark, sf_dir)
    boxes = segmentation.reboxed(v.filter("x > 0").select(F.col("label").alias("segment"), "mesh_id", "vid"), v)
    return boxes.filter("n >= 3").select(F.col("segment").alias("label"), "n")


@query()
def geo_site_frame(spark, sf_dir):
    """The frame of the burst with the most track points among those that have one; the more users, the farther east the bursts, out of the supported zones."""
    t, f = A.track(spark, sf_dir), A.fixes(spark, sf_dir)
    most = positioning.framed(t, f).orderBy(F.desc("n"), "burst_id").first()
    if most is None:
        raise GeoError("no burst has a frame")
    burst = most.burst_id
    got = positioning.site_frame(t, f, burst)
    return rounded(spark.createDataFrame([(burst, float(got["yaw"]), float(got["sigma"]), float(got["utm"]["easting"]), float(got["utm"]["northing"]), got["quality"])], "burst_id long, yaw double, sigma double, easting double, northing double, quality string"), 4)


@query(f"with {A.SOUP_V}, g as (select cast(floor(x / 5e-1) as bigint) as i, cast(floor(z / 5e-1) as bigint) as j, max(y) as b, max(y + 3e-1) as c from sv group by 1, 2) select {r('coalesce(sum(case when c - b > 1.5e-1 then c - b end), 0) * 2.5e-1', 'gained', 4)}, {r('coalesce(sum(case when c - b < -1.5e-1 then b - c end), 0) * 2.5e-1', 'lost', 4)}, count(*) as cells from g")
def diff_pipeline(spark, sf_dir):
    """Gained and lost volume of a scan that has risen by 0.3 against the surface of the one before."""
    import numpy as np

    v = A.soup_vertices(spark, sf_dir)
    tri = mesh.triangles(v, A.soup_faces(spark, sf_dir))
    still = registration.Alignment(np.eye(4), 0.05, 0.05, 1, 1.0, 1.0, 1.0)
    got = registration.diff(v, tri, v.withColumn("y", F.col("y") + 0.3), still, 0.5)
    return rounded(got["volumes"], 4)
