"""Registered queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import canonical as C
from ..functions import geodesy as G
from ..functions import vectors as V
from ..operators import custody, fit, mesh, positioning, registration, segmentation, store, stratigraphy, volume
from ..sources import meshfiles, records
from . import adapters as A
from .registry import query, r, rounded

UP = ((0.0, 0.5, 0.0), (0.0, 1.0, 0.0))
#: i and j run along z and x for a level plane.
FIELD = "f as (select cast(floor(z / 5e-2) as bigint) as i, cast(floor(x / 5e-2) as bigint) as j, y - 5e-1 as h from pts)"
ENVELOPE = "e as (select i, j, max(case when h >= 0 then h end) as up, min(case when h < 0 then h end) as lo from f group by i, j)"

# ------------------------------------------------------------------- volumes


@query(f"with {A.PTS}, {FIELD}, {ENVELOPE} select {r('coalesce(sum(up), 0) * 2.5e-3', 'positive')}, {r('abs(coalesce(sum(lo), 0)) * 2.5e-3', 'negative')}, {r('count(*) * 2.5e-3', 'covered_area')}, {r('count(*) * 1e0 / ((max(i) - min(i) + 1) * (max(j) - min(j) + 1))', 'filled_ratio')}, count(*) as cells, {r('count(*) * 2.5e-2', 'uncertainty')}, {r('count(*) * 6.25e-5', 'uncertainty_m3')} from e")
def volume_heightfield_points(spark, sf_dir):
    return rounded(volume.field_volume(volume.envelope(volume.heights(A.points(spark, sf_dir), *UP, 0.05)), 0.05))


_RASTER = """g as (select *, cast(floor(least(az, bz, cz) / 5e-1) as bigint) as i0, cast(floor(greatest(az, bz, cz) / 5e-1) as bigint) as i1, cast(floor(least(ax, bx, cx) / 5e-1) as bigint) as j0, cast(floor(greatest(ax, bx, cx) / 5e-1) as bigint) as j1 from st),
c as (select g.*, ti.i, tj.j, (ti.i + 5e-1) * 5e-1 as u, (tj.j + 5e-1) * 5e-1 as v from g, unnest(generate_series(i0, i1)) ti(i), unnest(generate_series(j0, j1)) tj(j)),
s as (select *, (u - bz) * (ax - bx) - (az - bz) * (v - bx) as s1, (u - cz) * (bx - cx) - (bz - cz) * (v - cx) as s2, (u - az) * (cx - ax) - (cz - az) * (v - ax) as s3, (bz - az) * (cx - ax) - (cz - az) * (bx - ax) as d from c),
f as (select i, j, ay + ((u - az) * (cx - ax) - (cz - az) * (v - ax)) / d * ("by" - ay) + ((bz - az) * (v - ax) - (u - az) * (bx - ax)) / d * (cy - ay) as h from s where not ((s1 < 0 or s2 < 0 or s3 < 0) and (s1 > 0 or s2 > 0 or s3 > 0)) and abs(d) > 1e-12)"""


@query(f"with {A.SOUP_V}, {A.SOUP_T}, {_RASTER}, {ENVELOPE} select {r('coalesce(sum(up), 0) * 2.5e-1', 'positive')}, {r('abs(coalesce(sum(lo), 0)) * 2.5e-1', 'negative')}, {r('count(*) * 2.5e-1', 'covered_area')}, {r('count(*) * 1e0 / ((max(i) - min(i) + 1) * (max(j) - min(j) + 1))', 'filled_ratio')}, count(*) as cells, {r('count(*) * 2.5e-1', 'uncertainty')}, {r('count(*) * 6.25e-2', 'uncertainty_m3')} from e")
def volume_heightfield_raster(spark, sf_dir):
    tri = mesh.triangles(A.soup_vertices(spark, sf_dir), A.soup_faces(spark, sf_dir))
    field = volume.raster_heights(tri, (0.0, 0.0, 0.0), (0.0, 1.0, 0.0), 0.5)
    return rounded(volume.field_volume(volume.envelope(field), 0.5))


@query(f"with {A.PART_V}, {A.PART_F}, {A.PART_T} select mesh_id, {r('sum((vay * vbz - vaz * vby) * vcx + (vaz * vbx - vax * vbz) * vcy + (vax * vby - vay * vbx) * vcz) / 6', 'volume')} from pt group by mesh_id", dealt=True)
def volume_closed_mesh(spark, sf_dir):
    return rounded(volume_tri(spark, sf_dir))


def volume_tri(spark, sf_dir):
    return mesh.closed_volume(mesh.triangles(A.part_vertices(spark, sf_dir), A.part_faces(spark, sf_dir)))


_EDGES = "ed as (select mesh_id, least(u, v) as lo, greatest(u, v) as hi, count(*) as n from (select mesh_id, a as u, b as v from pf union all select mesh_id, b, c from pf union all select mesh_id, c, a from pf) group by all)"


@query(f"with {A.PART_F}, {_EDGES} select mesh_id, 8::bigint as n_vertices, 12::bigint as n_faces, count(*) as n_edges, sum((n <> 2)::int)::bigint as open_edges, 8 - count(*) + 12 as euler, sum((n <> 2)::int) = 0 as is_closed from ed group by mesh_id", dealt=True)
def mesh_watertightness(spark, sf_dir):
    return mesh.watertightness(A.part_vertices(spark, sf_dir), A.part_faces(spark, sf_dir))


@query(f"with {A.PART_F}, {_EDGES} select n as faces, count(*) as edges from ed group by n", dealt=True)
def edge_multiplicity(spark, sf_dir):
    return mesh.edge_counts(A.part_faces(spark, sf_dir)).groupBy(F.col("n").alias("faces")).agg(F.count("*").alias("edges"))


_N = "n as (select *, (by - ay) * (cz - az) - (bz - az) * (cy - ay) as fx, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) as fy, (bx - ax) * (cy - ay) - (by - ay) * (cx - ax) as fz from st), nl as (select *, sqrt(fx * fx + fy * fy + fz * fz) as fl from n)".replace("(by -", '("by" -')


@query(f"with {A.SOUP_V}, {A.SOUP_T}, {_N} select 0::bigint as mesh_id, fid, {r('fx / fl', 'nx')}, {r('fy / fl', 'ny')}, {r('fz / fl', 'nz')}, {r('fl / 2', 'area')} from nl")
def mesh_face_normals(spark, sf_dir):
    return rounded(mesh.face_normals(mesh.triangles(A.soup_vertices(spark, sf_dir), A.soup_faces(spark, sf_dir))))


_PN = """pn as (select *, (vby - vay) * (vcz - vaz) - (vbz - vaz) * (vcy - vay) as fx, (vbz - vaz) * (vcx - vax) - (vbx - vax) * (vcz - vaz) as fy, (vbx - vax) * (vcy - vay) - (vby - vay) * (vcx - vax) as fz from pt),
vn as (select mesh_id, vid, sum(fx) as fx, sum(fy) as fy, sum(fz) as fz from (select mesh_id, a as vid, fx, fy, fz from pn union all select mesh_id, b, fx, fy, fz from pn union all select mesh_id, c, fx, fy, fz from pn) group by all), vl as (select *, sqrt(fx * fx + fy * fy + fz * fz) as fl from vn)"""


@query(f"with {A.PART_V}, {A.PART_F}, {A.PART_T}, {_PN} select mesh_id, vid, {r('fx / fl', 'nx')}, {r('fy / fl', 'ny')}, {r('fz / fl', 'nz')} from vl", dealt=True)
def mesh_vertex_normals(spark, sf_dir):
    v = A.part_vertices(spark, sf_dir)
    return rounded(mesh.vertex_normals(v, mesh.triangles(v, A.part_faces(spark, sf_dir))))


_TWO = "pts_a as (select * from pts where l_returnflag = 'R'), pts_b as (select * from pts where l_returnflag <> 'R')"


def _env(src: str, name: str) -> str:
    return f"{name} as (select i, j, max(case when h >= 0 then h end) as up, min(case when h < 0 then h end) as lo from (select cast(floor(z / 5e-2) as bigint) as i, cast(floor(x / 5e-2) as bigint) as j, y - 5e-1 as h from {src}) group by i, j)"


def _two(spark, sf_dir):
    p = A.points(spark, sf_dir)
    return (volume.envelope(volume.heights(p.filter(c), *UP, 0.05)) for c in ("l_returnflag = 'R'", "l_returnflag <> 'R'"))


@query(f"""with {A.PTS}, {_TWO}, {_env('pts_a', 'p')}, {_env('pts_b', 'd')}, x as (select p.up - coalesce(d.up, d.lo, 0e0) as x from p left join d using (i, j) where p.up is not null
union all select -lo from d where lo is not null and not exists (select 1 from p where p.i = d.i and p.j = d.j and p.up is not null))
select {r('coalesce(sum(case when x > 0 then x end), 0) * 2.5e-3', 'positive')}, {r('coalesce(sum(case when x < 0 then -x end), 0) * 2.5e-3', 'negative')}, count(*) as cells, false as is_inferred from x""")
def volume_cavity_prior(spark, sf_dir):
    return rounded(volume.cavity_prior(*_two(spark, sf_dir), 0.05))


@query(f"with {A.PTS}, {_TWO}, {_env('pts_b', 'd')} select {r('coalesce(sum(-lo), 0) * 2.5e-3', 'positive')}, {r('coalesce(sum(up), 0) * 2.5e-3', 'negative')}, count(*) as cells, 2.5e-2 as uncertainty, true as is_inferred from d")
def volume_cavity_plane(spark, sf_dir):
    return rounded(volume.cavity_plane(list(_two(spark, sf_dir))[1], 0.05))


@query(f"with {A.PTS}, q as (select cast(floor(z / 5e-2) as bigint) as i, cast(floor(x / 5e-2) as bigint) as j, min(y - (1e-1 * z * z + 2e-1 * x * x + 5e-2 * z * x + 1e-1 * z + 2e-1 * x + 3e-1)) as d from pts group by 1, 2) select {r('coalesce(sum(case when d < 0 then -d end), 0) * 2.5e-3', 'positive')}, count(*) as cells, 2.5e-2 as uncertainty, true as is_inferred from q")
def volume_cavity_quadric(spark, sf_dir):
    return rounded(volume.cavity_quadric(A.points(spark, sf_dir), (0.1, 0.2, 0.05, 0.1, 0.2, 0.3), 0.05))


@query(f"""with {A.PTS}, m as (select z, 1.01e0 - x as x, y, l_returnflag from pts), h as (select cast(floor(z / 5e-2) as bigint) as i, cast(floor(x / 5e-2) as bigint) as j, y - 5e-1 as h from m where l_returnflag = 'R'),
he as (select i, j, coalesce(max(case when h >= 0 then h end), min(case when h < 0 then h end)) as h from h group by i, j), {_TWO}, {_env('pts_b', 'd')}
select {r('coalesce(sum(greatest(he.h - coalesce(d.up, d.lo, 0e0), 0e0)), 0) * 2.5e-3', 'positive')}, count(*) as cells, true as is_inferred from he left join d using (i, j)""")
def volume_cavity_mirror(spark, sf_dir):
    p = A.points(spark, sf_dir)
    healthy = p.filter("l_returnflag = 'R'").withColumn("x", 1.01 - F.col("x"))
    return rounded(volume.cavity_mirror(volume.envelope(volume.heights(healthy, *UP, 0.05)), list(_two(spark, sf_dir))[1], 0.05))


_PURPOSE = "element_at(array('baseline', 'postIntervention', 'monitoring', 'damageAssessment', 'rescueDocumentation', 'specimenInventory', 'stratigraphicProfile'), cast(o_orderkey % 7 + 1 as int))"


@query("select case o_orderkey % 7 when 0 then 'height_field' when 1 then 'height_field' when 2 then 'height_field' when 3 then 'cavity' else 'closed_mesh' end as integrator, count(*) as n from orders group by 1")
def volume_route(spark, sf_dir):
    return volume.route(A.table(spark, sf_dir, "orders").select(F.expr(_PURPOSE).alias("purpose"))).groupBy("integrator").agg(F.count("*").alias("n"))


# -------------------------------------------------------------------- voxels

_ORDER = ", ".join(A.PTS_ORDER)


@query(f"with {A.PTS} select cast(floor(x / 1e-1) as bigint) as kx, cast(floor(y / 1e-1) as bigint) as ky, cast(floor(z / 1e-1) as bigint) as kz, {r(f'min_by(x, row({_ORDER}))', 'x')}, {r(f'min_by(y, row({_ORDER}))', 'y')}, {r(f'min_by(z, row({_ORDER}))', 'z')}, count(*) as n from pts group by 1, 2, 3")
def voxel_subsample_first(spark, sf_dir):
    return rounded(mesh.voxel_firsts(A.points(spark, sf_dir), 0.1, F.struct(*A.PTS_ORDER)))


@query(f"with {A.PTS} select cast(round(x / 1e-1) as bigint) as kx, cast(round(y / 1e-1) as bigint) as ky, cast(round(z / 1e-1) as bigint) as kz, {r('avg(x)', 'x')}, {r('avg(y)', 'y')}, {r('avg(z)', 'z')}, count(*) as n from pts group by 1, 2, 3")
def voxel_mean(spark, sf_dir):
    return rounded(mesh.voxel_means(A.points(spark, sf_dir), 0.1, ()))


@query(f"with {A.PTS} select count(*) as points, count(distinct (x, y, z)) as places from pts")
def points_distinct(spark, sf_dir):
    p = A.points(spark, sf_dir)
    return p.agg(F.count("*").alias("points"), F.count_distinct("x", "y", "z").alias("places"))


def _key(size: str) -> str:
    return f"cast(round(x / {size}) as bigint) as kx, cast(round(y / {size}) as bigint) as ky, cast(round(z / {size}) as bigint) as kz"


@query(f"with {A.PART_V}, {A.PART_F}, k as (select mesh_id, vid, {_key('1e0')} from pv), t as (select f.mesh_id, fid, (a.kx, a.ky, a.kz) as ka, (b.kx, b.ky, b.kz) as kb, (c.kx, c.ky, c.kz) as kc from pf f join k a on a.mesh_id = f.mesh_id and a.vid = f.a join k b on b.mesh_id = f.mesh_id and b.vid = f.b join k c on c.mesh_id = f.mesh_id and c.vid = f.c), v as (select mesh_id, count(distinct (kx, ky, kz)) as vertices from k group by 1), d as (select mesh_id, count(distinct list_sort([ka, kb, kc])) as faces from t where ka <> kb and kb <> kc and ka <> kc group by 1) select mesh_id, vertices, coalesce(faces, 0) as faces from v left join d using (mesh_id)", dealt=True)
def mesh_decimate_faces(spark, sf_dir):
    v, f = mesh.decimated(A.part_vertices(spark, sf_dir), A.part_faces(spark, sf_dir), 1.0)
    return v.groupBy("mesh_id").agg(F.count("*").alias("vertices")).join(f.groupBy("mesh_id").agg(F.count("*").alias("faces")), "mesh_id", "left").fillna(0, ["faces"])


@query(f"with {A.PART_V}, s as (select mesh_id % 50 as mesh_id, mesh_id as part_id, vid, {_key('5e-1')} from pv) select mesh_id, count(distinct (kx, ky, kz)) as vertices, count(*) * 12 // 8 as faces from s group by mesh_id")
def mesh_merge_dedup(spark, sf_dir):
    part = lambda df: df.withColumn("part_id", F.col("mesh_id")).withColumn("mesh_id", F.col("mesh_id") % 50)
    v, f = mesh.merged(part(A.part_vertices(spark, sf_dir)), part(A.part_faces(spark, sf_dir)), 0.5)
    return v.groupBy("mesh_id").agg(F.count("*").alias("vertices")).join(f.groupBy("mesh_id").agg(F.count("*").alias("faces")), "mesh_id")


_TURNS4 = ((1, 0, 0, 1), (0, 1, -1, 0), (-1, 0, 0, -1), (0, -1, 1, 0))
#: Parts of five boxes each, turned by quarters about the second axis and moved apart by whole cells, so that corners meet.
_PLACED = f"""{A.PART_V}, {A.PART_F}, q as (select *, mesh_id % 4 as t, (mesh_id % 6) / 4e0 as move from pv), w as (select mesh_id // 5 as mesh, mesh_id as part, vid,
 case t {' '.join(f'when {i} then {a}e0 * x + {b}e0 * z' for i, (a, b, _, _) in enumerate(_TURNS4))} end + move as x, y, case t {' '.join(f'when {i} then {c}e0 * x + {d}e0 * z' for i, (_, _, c, d) in enumerate(_TURNS4))} end - move as z from q),
ky as (select *, round(x / 5e-1)::bigint as kx, round(y / 5e-1)::bigint as ky, round(z / 5e-1)::bigint as kz from w),
fi as (select *, row_number() over (partition by mesh, kx, ky, kz order by part, vid) as o from ky),
nw as (select *, row_number() over (partition by mesh order by part, vid) - 1 as nid from fi where o = 1),
nm as (select fi.mesh, fi.part, fi.vid, nw.nid from fi join nw using (mesh, kx, ky, kz))"""


def _placed_parts(spark, sf_dir):
    part = lambda df: df.withColumn("part_id", F.col("mesh_id")).withColumn("mesh_id", F.floor(F.col("mesh_id") / 5).cast("long"))
    v, f = part(A.part_vertices(spark, sf_dir)), part(A.part_faces(spark, sf_dir))
    turn = [F.when(F.col("part_id") % 4 == i, F.array(*(F.lit(float(k)) for k in t))) for i, t in enumerate(_TURNS4)]
    t, move = F.coalesce(*turn), (F.col("part_id") % 6) / 4.0
    at = lambda i: F.element_at(t, i + 1)
    zero, one = F.lit(0.0), F.lit(1.0)
    m = F.array(at(0), zero, at(1), move, zero, one, zero, zero, at(2), zero, at(3), -move, zero, zero, zero, one)
    return mesh.merged(v, f, 0.5, v.select("mesh_id", "part_id").distinct().withColumn("m", m))


@query(f"with {_PLACED} select mesh as mesh_id, nid as vid, {r('x', 'x')}, {r('y', 'y')}, {r('z', 'z')} from nw", dealt=True)
def mesh_merge_world(spark, sf_dir):
    return rounded(_placed_parts(spark, sf_dir)[0])


@query(f"with {_PLACED} select a.mesh as mesh_id, f.mesh_id as part_id, f.fid::bigint as fid, a.nid as a, b.nid as b, c.nid as c from pf f join nm a on a.part = f.mesh_id and a.vid = f.a join nm b on b.part = f.mesh_id and b.vid = f.b join nm c on c.part = f.mesh_id and c.vid = f.c", dealt=True)
def mesh_merge_world_faces(spark, sf_dir):
    return _placed_parts(spark, sf_dir)[1]


# ---------------------------------------------------------- regions and planes

_TURN = np.radians(30)
_BOX = {"centre": (0.2, 0.1, 0.0), "axes": ((float(np.cos(_TURN)), 0.0, float(-np.sin(_TURN))), (0.0, 1.0, 0.0), (float(np.sin(_TURN)), 0.0, float(np.cos(_TURN)))), "half": (1.5, 1.0, 1.2)}


def _in_box(p: str = "") -> str:
    d = [f'("{p}{c}" - {float(m)!r}::double)' for c, m in zip("xyz", _BOX["centre"], strict=True)]
    return " and ".join("abs(" + " + ".join(f"{d[k]} * {a[k]!r}::double" for k in range(3)) + f") <= {h + 1e-3!r}::double" for a, h in zip(_BOX["axes"], _BOX["half"], strict=True))


@query(f"with {A.SOUP_V} select vid, label from sv where {_in_box()}")
def roi_points_in_obb(spark, sf_dir):
    return A.soup_vertices(spark, sf_dir).filter(V.in_box(V.p(), **_BOX)).select("vid", "label")


@query(f"with {A.SOUP_V}, {A.SOUP_T} select 0::bigint as mesh_id, fid, a, b, c from st where {_in_box('a')} and {_in_box('b')} and {_in_box('c')}")
def roi_faces_inside(spark, sf_dir):
    return mesh.roi(A.soup_vertices(spark, sf_dir), A.soup_faces(spark, sf_dir), V.in_box(V.p(), **_BOX))[1]


@query()
def roi_split_faces(spark, sf_dir):
    return rounded(mesh.clipped_faces(mesh.triangles(A.soup_vertices(spark, sf_dir), A.soup_faces(spark, sf_dir)), **_BOX))


@query(f"with {A.SOUP_V} select vid, case when x * 6e-1 + y * 8e-1 >= 0 then 'A' else 'B' end as side from sv")
def plane_split(spark, sf_dir):
    return mesh.split_by_plane(A.soup_vertices(spark, sf_dir), (0, 0, 0), (0.6, 0.8, 0.0)).select("vid", "side")


@query(f"with {A.PART_V}, {A.PART_F}, o as (select *, abs(y - 1e0) > 2e-1 as up from pv), s as (select mesh_id, bool_or(up) and not bool_and(up) as cut from o group by 1), k as (select mesh_id, vid from o join s using (mesh_id) where not cut or up), g as (select f.mesh_id, count(*) as faces from pf f where (select count(*) from k where k.mesh_id = f.mesh_id and k.vid in (f.a, f.b, f.c)) = 3 group by 1), v as (select mesh_id, count(*) as vertices from k group by 1) select mesh_id, vertices, coalesce(faces, 0) as faces from v left join g using (mesh_id)", dealt=True)
def plane_removal(spark, sf_dir):
    v, f = mesh.without_plane(A.part_vertices(spark, sf_dir), A.part_faces(spark, sf_dir), (0.0, 1.0, 0.0), (0.0, 1.0, 0.0), 0.2)
    return v.groupBy("mesh_id").agg(F.count("*").alias("vertices")).join(f.groupBy("mesh_id").agg(F.count("*").alias("faces")), "mesh_id", "left").fillna(0, ["faces"])


@query(f"with {A.SOUP_V} select vid, {r('x - 2 * (x * 6e-1 + y * 8e-1) * 6e-1', 'x')}, {r('y - 2 * (x * 6e-1 + y * 8e-1) * 8e-1', 'y')}, {r('z', 'z')} from sv")
def mirror_points(spark, sf_dir):
    return rounded(mesh.mirrored(A.soup_vertices(spark, sf_dir), (0, 0, 0), (0.6, 0.8, 0.0)).select("vid", "x", "y", "z"))


@query(f"with {A.SOUP_V} select vid, {r('2 * x + 5e-1 * y + 1e0', 'x')}, {r('y - 2.5e-1 * z', 'y')}, {r('3 * z - 1e0', 'z')} from sv")
def affine_points(spark, sf_dir):
    m = np.array([[2, 0.5, 0, 1], [0, 1, -0.25, 0], [0, 0, 3, -1], [0, 0, 0, 1]])
    return rounded(mesh.transformed(A.soup_vertices(spark, sf_dir), m, rigid=False).select("vid", "x", "y", "z"))


@query(f"with {A.SOUP_V} select vid, {r('6e-1 * x - 8e-1 * z + 1e0', 'x')}, {r('y', 'y')}, {r('8e-1 * x + 6e-1 * z', 'z')} from sv")
def rigid_points(spark, sf_dir):
    m = np.array([[1.2, 0, -1.6, 1], [0, 3, 0, 0], [1.6, 0, 1.2, 0], [0, 0, 0, 1]])
    return rounded(mesh.transformed(A.soup_vertices(spark, sf_dir), m).select("vid", "x", "y", "z"))


# ----------------------------------------------------------------------- fits


@query(f"with {A.PTS}, b as (select min(x) as x0, min(z) as z0, max(x) as x1, max(z) as z1 from pts), q as (select cast(least(floor((z - z0) * 2e1), greatest(0, ceil((z1 - z0) * 2e1) - 1)) as bigint) as col, cast(least(floor((x - x0) * 2e1), greatest(0, ceil((x1 - x0) * 2e1) - 1)) as bigint) as row, y - 5e-1 as h from pts, b) select col, row, {r('max(h)', 'height')}, count(*) as n from q group by 1, 2")
def ortho_raster(spark, sf_dir):
    return rounded(fit.ortho_raster(A.points(spark, sf_dir), *UP, 20.0, V.seeded_basis))


@query(f"with {A.PTS}, q as (select distinct cast(least(floor(z * 2e1), 19) as bigint) as col, cast(least(floor(x * 2e1), 19) as bigint) as row from pts), m as (select p_partkey as ord, p_partkey % 25 as col, p_size % 25 as row from part) select ord, {r('(row + 5e-1) / 2e1', 'x')}, {r('5e-1', 'y')}, {r('(col + 5e-1) / 2e1', 'z')} from m where exists (select 1 from q where q.col = m.col and q.row = m.row)")
def pixel_backproject(spark, sf_dir):
    image = A.points(spark, sf_dir).select(F.least(F.floor(F.col("z") * 20), F.lit(19)).cast("long").alias("col"), F.least(F.floor(F.col("x") * 20), F.lit(19)).cast("long").alias("row")).distinct()
    marks = A.table(spark, sf_dir, "part").selectExpr("p_partkey as ord", "p_partkey % 25 as col", "cast(p_size % 25 as bigint) as row")
    return rounded(fit.back_projected(marks, image, 20.0, (0.0, 0.0), *UP, V.seeded_basis).select("ord", "x", "y", "z"))


@query(f"with {A.SOUP_V} select label, count(*) as n, {', '.join(r(f'avg({c})', 'm' + c) for c in 'xyz')}, {', '.join(r(f'covar_pop({a}, {b})', 'c' + a + b) for a, b in ('xx', 'xy', 'xz', 'yy', 'yz', 'zz'))} from sv group by label")
def fit_covariance(spark, sf_dir):
    return rounded(fit.moments(A.soup_vertices(spark, sf_dir), "label"))


@query(f"with {A.SOUP_V}, v as (select label, count(*) as n, var_pop(x) as vx, var_pop(y) as vy, var_pop(z) as vz from sv group by label) select label, n, {r('vx', 'vx')}, {r('vy', 'vy')}, {r('vz', 'vz')}, case when vx <= vy and vx <= vz then 'x' when vy <= vz then 'y' else 'z' end as axis from v")
def fit_axis_least_variance(spark, sf_dir):
    return rounded(fit.least_varying_axis(A.soup_vertices(spark, sf_dir), "label"))


def _unit_eigenvector(l: str, k: str) -> str:
    """SQL of a symmetric matrix's unit eigenvector to the eigenvalue l: the longest cross product of two rows of the matrix less l."""
    rows = [(f"(cxx - {l})", "cxy", "cxz"), ("cxy", f"(cyy - {l})", "cyz"), ("cxz", "cyz", f"(czz - {l})")]
    cross = lambda u, v: (f"{u[1]} * {v[2]} - {u[2]} * {v[1]}", f"{u[2]} * {v[0]} - {u[0]} * {v[2]}", f"{u[0]} * {v[1]} - {u[1]} * {v[0]}")
    named = [(c, *cross(rows[i], rows[j])) for c, i, j in (("p", 0, 1), ("q", 0, 2), ("r", 1, 2))]
    first = ", ".join(f"{e} as {k}{c}{n}" for c, *es in named for e, n in zip(es, "xyz", strict=True))
    size = {c: f"({k}{c}x * {k}{c}x + {k}{c}y * {k}{c}y + {k}{c}z * {k}{c}z)" for c in "pqr"}
    pick = ", ".join(f"case greatest({', '.join(size.values())}) when {size['p']} then {k}p{n} when {size['q']} then {k}q{n} else {k}r{n} end / sqrt(greatest({', '.join(size.values())})) as {k}{n}" for n in "xyz")
    return first, pick


_E1, _E3 = _unit_eigenvector("l1", "u"), _unit_eigenvector("l3", "w")
#: Eigenvalues of the covariance by the cubic's closed form; u, v and w are the axes by falling variance.
_AXES = f"""{A.SOUP_V}, mo as (select label, count(*) as n, {', '.join(f'avg({c}) as m{c}' for c in 'xyz')}, {', '.join(f'covar_pop({i}, {k}) as c{i}{k}' for i, k in ('xx', 'xy', 'xz', 'yy', 'yz', 'zz'))} from sv group by label),
m1 as (select *, (cxx + cyy + czz) / 3 as tr from mo), m2 as (select *, sqrt(((cxx - tr) ** 2 + (cyy - tr) ** 2 + (czz - tr) ** 2 + 2 * (cxy ** 2 + cxz ** 2 + cyz ** 2)) / 6) as sp from m1),
m3 as (select *, acos(greatest(-1e0, least(1e0, ((cxx - tr) * ((cyy - tr) * (czz - tr) - cyz * cyz) - cxy * (cxy * (czz - tr) - cyz * cxz) + cxz * (cxy * cyz - (cyy - tr) * cxz)) / (2 * sp ** 3)))) / 3 as phi from m2),
m4 as (select *, tr + 2 * sp * cos(phi) as l1, tr + 2 * sp * cos(phi + 2 * pi() / 3) as l3 from m3), m5 as (select *, {_E1[0]}, {_E3[0]} from m4), m6 as (select *, {_E1[1]}, {_E3[1]} from m5),
ax as (select label, n, mx, my, mz, l3, ux, uy, uz, wy * uz - wz * uy as vx, wz * ux - wx * uz as vy, wx * uy - wy * ux as vz, wx, wy, wz from m6)"""


@query(f"with {_AXES} select label, n, {', '.join(r(f'w{c} * case when wy >= 0 then 1 else -1 end', 'n' + c) for c in 'xyz')}, {r('sqrt(greatest(l3, 0e0))', 'rms')} from ax")
def fit_plane_ls(spark, sf_dir):
    return rounded(fit.planes(A.soup_vertices(spark, sf_dir), "label"))


_SPAN = ", ".join(f"{f}(sv.x * {k}x + sv.y * {k}y + sv.z * {k}z) as {n}{k}" for k in "uvw" for f, n in (("min", "lo"), ("max", "hi")))


@query(f"with {_AXES}, sp as (select label, ax.n, ux, uy, uz, vx, vy, vz, wx, wy, wz, {_SPAN} from sv join ax using (label) group by all) select label, n, {', '.join(r(' + '.join(f'(lo{k} + hi{k}) / 2 * {k}{c}' for k in 'uvw'), 'c' + c) for c in 'xyz')}, {', '.join(r(f'(hi{k} - lo{k}) / 2', 'h' + c) for k, c in zip('uvw', 'xyz'))} from sp")
def fit_obb_pca(spark, sf_dir):
    return rounded(fit.boxes(A.soup_vertices(spark, sf_dir), "label").drop("axes"))


@query(f"with {_AXES} select label, {', '.join(r('any_value(m' + c + ')', 'c' + c) for c in 'xyz')}, count(*) as n, {', '.join(r(f'case when count(*) < 3 then 5e-3 else greatest(max(abs((sv.x - mx) * {k}x + (sv.y - my) * {k}y + (sv.z - mz) * {k}z)), 1e-3) end', 'h' + c) for k, c in zip('uvw', 'xyz'))} from sv join ax using (label) group by label")
def segment_obb(spark, sf_dir):
    return rounded(fit.segment_boxes(A.soup_vertices(spark, sf_dir), "label").drop("axes"))


def _mix(z: str, shift: int, by: int | None = None) -> str:
    """A step of the SplitMix64 finaliser in 128-bit SQL."""
    x = f"xor({z}, {z} >> {shift})"
    return f"({x} * {by}::uhugeint) % 18446744073709551616::uhugeint" if by else x


#: Draws, planes and scores of 100 seeded hypotheses, gone through in order until the stop count.
_RANSAC = f"""{A.PTS}, k as (select x, y, z, concat_ws(',', l_orderkey, l_partkey, l_suppkey, l_linenumber) as id from pts),
pool as (select x, y, z, row_number() over (order by md5('42:' || id), id) - 1 as i from k qualify i < 300), m as (select count(*) as m from pool),
d0 as (select j, ((42::uhugeint + (j + 1)::uhugeint * 11400714819323198485::uhugeint) % 18446744073709551616::uhugeint) as s from generate_series(0, 299) t(j)),
d1 as (select j, {_mix('s', 30, 13787848793156543929)} as s from d0), d2 as (select j, {_mix('s', 27, 10723151780598845931)} as s from d1), d3 as (select j, ({_mix('s', 31)} % m::uhugeint)::bigint as i from d2, m),
tr as (select a.j // 3 as hid, pa.x as ax, pa.y as ay, pa.z as az, pb.x - pa.x as bx, pb.y - pa.y as b_y, pb.z - pa.z as bz, pc.x - pa.x as cx, pc.y - pa.y as cy, pc.z - pa.z as cz
 from d3 a join d3 b on b.j = a.j + 1 join d3 c on c.j = a.j + 2 join pool pa on pa.i = a.i join pool pb on pb.i = b.i join pool pc on pc.i = c.i where a.j % 3 = 0 and a.i <> b.i and b.i <> c.i and a.i <> c.i),
nn as (select *, b_y * cz - bz * cy as ux, bz * cx - bx * cz as uy, bx * cy - b_y * cx as uz from tr), hy as (select hid, ax, ay, az, ux / l as nx, uy / l as ny, uz / l as nz from (select *, sqrt(ux * ux + uy * uy + uz * uz) as l from nn) where l > 1e-6),
sc as (select hid, count(*) filter (d <= 5e-2) as inliers, sum(least(d * d, 5e-2 ** 2)) as msac, count(*) as n from (select hid, abs((k.x - ax) * nx + (k.y - ay) * ny + (k.z - az) * nz) as d from hy, k) group by hid),
rn as (select *, (min(row(msac, hid)) over w) = row(msac, hid) as better from sc window w as (order by hid rows unbounded preceding)),
sh as (select *, greatest(least(0.999, 50e0 / n), coalesce(max(case when better then inliers * 1e0 / n end) over w, 0)) as share from rn window w as (order by hid rows unbounded preceding)),
un as (select *, least(100, greatest(1, trunc(ln(1 - 0.99) / ln(1 - share ** 3))))::bigint as until from sh),
gone as (select *, max((hid >= before)::int) over (order by hid rows unbounded preceding) as past from (select *, coalesce(lag(until) over (order by hid), 100) as before from un)),
won as (select *, max_by(until, hid) over () as stop from gone where past = 0 qualify row_number() over (order by msac, hid) = 1)"""


@query(f"with {_RANSAC} select hid, inliers, stop as iterations, {r('msac', 'msac')}, {r('nx', 'nx')}, {r('ny', 'ny')}, {r('nz', 'nz')} from won join hy using (hid)")
def fit_ransac_winner(spark, sf_dir):
    """The winning hypothesis, before its refinement, and how many were to be drawn."""
    p = A.points(spark, sf_dir).withColumn("id", F.concat_ws(",", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    got = fit.ransac_plane(p, "id", iterations=100, threshold=0.05, confidence=0.99)
    row = (int(got["hid"]), int(got["inliers"]), int(got["iterations"]), float(got["msac"]), *map(float, got["raw"][3:]))
    return rounded(spark.createDataFrame([row], "hid long, inliers long, iterations long, msac double, nx double, ny double, nz double"))


@query()
def fit_plane_ransac(spark, sf_dir):
    p = A.points(spark, sf_dir).withColumn("id", F.struct(*A.PTS_ORDER))
    got = fit.ransac_plane(p, "id", iterations=100, threshold=0.05)
    row = (*map(float, got["normal"]), float(got["rms"]), int(got["inliers"]))
    return rounded(spark.createDataFrame([row], "nx double, ny double, nz double, rms double, inliers long"))


_HYPOTHESES = [(k, 0.0, 0.1 * k, 0.0, 0.0, 1.0, 0.0) for k in range(8)]
_SCORE = f"with {A.PTS}, h as (select k as hid, abs(y - 1e-1 * k) as d from pts, unnest(generate_series(0, 7)) t(k))"


@query(f"{_SCORE} select hid, {r('sum(least(d * d, 2.5e-3))', 'msac', 5)} from h group by hid")
def ransac_score_msac(spark, sf_dir):
    return rounded(fit.scored(A.points(spark, sf_dir), _HYPOTHESES, 0.05).select("hid", "msac"), 5)


@query(f"{_SCORE} select hid, sum((d <= 5e-2)::int)::bigint as inliers from h group by hid")
def ransac_score_inliers(spark, sf_dir):
    return fit.scored(A.points(spark, sf_dir), _HYPOTHESES, 0.05).select("hid", "inliers")


# --------------------------------------------------------------- stratigraphy

_GROUPS = "gr as (select profile_id, boundary_id, avg(y) as t, count(*) as n from mk group by 1, 2 having count(*) > 1), pr as (select profile_id, boundary_id as lower, lead(boundary_id) over w as upper, lead(t) over w - t as d from gr window w as (partition by profile_id order by t, boundary_id))"


@query(f"with {A.MARKS}, {_GROUPS} select profile_id, lower, upper, {r('abs(d)', 'true_thickness')}, {r('abs(d)', 'apparent_thickness')} from pr where upper is not null")
def thickness_pairs(spark, sf_dir):
    return rounded(stratigraphy.thickness(stratigraphy.boundary_groups(A.marks(spark, sf_dir)), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)))


@query(f"with {A.MARKS}, o as (select profile_id, y - avg(y) over (partition by profile_id, boundary_id) as e from mk) select profile_id, {r('sqrt(avg(e * e))', 'sigma_plane')}, {r('sqrt(avg(e * e) + 1e-6)', 'band')} from o group by 1")
def thickness_band(spark, sf_dir):
    return rounded(stratigraphy.uncertainty(A.marks(spark, sf_dir), (0.0, 1.0, 0.0), 500.0))


@query(f"with {A.MARKS}, {_GROUPS}, o as (select profile_id, y - avg(y) over (partition by profile_id, boundary_id) as e from mk), bd as (select profile_id, sqrt(avg(e * e)) as s, sqrt(avg(e * e) + 1e-6) as band from o group by 1) select profile_id, lower, upper, {r('abs(d)', 'true_thickness')}, {r('abs(d)', 'apparent_thickness')}, {r('s', 'sigma_plane')}, {r('band', 'band')} from pr join bd using (profile_id) where upper is not null")
def thickness_measure(spark, sf_dir):
    return rounded(stratigraphy.measure(A.marks(spark, sf_dir), (0.0, 0.0, 1.0), (0.0, 1.0, 0.0)))


@query(f"with {A.SOUP_V}, {A.SOUP_T}, {_N}, u as (select fid, fx / fl as x, fy / fl as y, fz / fl as z from nl) select fid, {r('degrees(acos(greatest(-1e0, least(1e0, y))))', 'dip')}, case when sqrt(x * x + z * z) <= 1e-6 then 0e0 else round((degrees(atan2(-x, z)) % 360 + 360) % 360, 6) + 0e0 end as direction from u")
def face_dip(spark, sf_dir):
    n = mesh.face_normals(mesh.triangles(A.soup_vertices(spark, sf_dir), A.soup_faces(spark, sf_dir)))
    angle, direction = V.dip(V.p("n"))
    return rounded(n.select("fid", angle.alias("dip"), direction.alias("direction")))


# ---------------------------------------------------------------- positioning

_K0, _A, _E2 = "9.996e-1", "6378137e0", f"{G.E2!r}::double"
_UTM = f"""u as (select ord, latitude, longitude, cast(floor((longitude + 180) / 6) + 1 as int) as zone from fx),
w as (select *, radians(latitude) as p, radians(longitude - (6e0 * zone - 183e0)) as l from u), s as (select *, sin(p) as s, cos(p) as c, tan(p) * tan(p) as t, {G.EP2!r}::double * cos(p) * cos(p) as n2, cos(p) * l as x from w),
m as (select *, {_A} / sqrt(1 - {_E2} * s * s) as nu, {_A} * ({1 - G.E2 / 4 - 3 * G.E2**2 / 64 - 5 * G.E2**3 / 256!r}::double * p - {3 / 8 * (G.E2 + G.E2**2 / 4 + 15 * G.E2**3 / 128)!r}::double * sin(2 * p) + {15 / 256 * (G.E2**2 + 3 * G.E2**3 / 4)!r}::double * sin(4 * p) - {35 * G.E2**3 / 3072!r}::double * sin(6 * p)) as arc from s)"""
_EAST = f"5e5 + {_K0} * nu * (x + x * x * x * (1 - t + n2) / 6 + x ** 5 * (5 - 18 * t + t * t + 72 * n2 - 58 * {G.EP2!r}::double) / 120 + x ** 7 * (61 - 479 * t + 179 * t * t - t * t * t) / 5040)"
_NORTH = f"{_K0} * (arc + nu * s / c * (x * x / 2 + x ** 4 * (5 - t + 9 * n2 + 4 * n2 * n2) / 24 + x ** 6 * (61 - 58 * t + t * t + 600 * n2 - 330 * {G.EP2!r}::double) / 720)) + case when latitude < 0 then 1e7 else 0e0 end"


@query(f"with {A.FIXES}, {_UTM} select ord, {r(_EAST, 'easting', 3)}, {r(_NORTH, 'northing', 3)}, zone, latitude >= 0 as is_north, case when latitude >= 0 then 32600 + zone else 32700 + zone end as epsg from m")
def geo_utm_forward(spark, sf_dir):
    return rounded(A.fixes(spark, sf_dir).select("ord", *(c.alias(n) for n, c in G.utm(F.col("latitude"), F.col("longitude")).items())), 3)


@query(f"with {A.FIXES}, {_UTM} select ord, {r('degrees(l * s + l ** 3 * s * c * c * (1 + 3 * n2 + 2 * n2 * n2) / 3 + l ** 5 * s * c ** 4 * (2 - t) / 15)', 'convergence')} from m")
def geo_convergence(spark, sf_dir):
    return rounded(A.fixes(spark, sf_dir).select("ord", G.convergence(F.col("latitude"), F.col("longitude")).alias("convergence")))


@query(f"with {A.FIXES} select ord, {r('latitude', 'lat', 7)}, {r('longitude', 'lon', 7)} from fx")
def geo_utm_round_trip(spark, sf_dir):
    forward = A.fixes(spark, sf_dir).select("ord", *(c.alias(n) for n, c in G.utm(F.col("latitude"), F.col("longitude")).items()))
    return rounded(G.refined(forward, "easting", "northing", "zone", "is_north").select("ord", "lat", "lon"), 7)


@query(f"with {A.FIXES} select burst_id, ord, case when horizontal_accuracy > 10 then 'horizontal accuracy' end as reason, horizontal_accuracy <= 10 as accepted from fx")
def geo_fix_gate(spark, sf_dir):
    return positioning.gated(A.fixes(spark, sf_dir)).select("burst_id", "ord", "reason", "accepted")


_MEDIAN = """ok as (select * from fx where horizontal_accuracy <= 10), run as (select *, sum(1e0 / (horizontal_accuracy * horizontal_accuracy)) over (partition by burst_id order by latitude, ord rows unbounded preceding) as run, sum(1e0 / (horizontal_accuracy * horizontal_accuracy)) over (partition by burst_id) as al from ok),
med as (select burst_id, min_by(latitude, row(latitude, ord)) as latitude from run where run >= al / 2 group by 1)"""


@query(f"with {A.FIXES}, {_MEDIAN} select burst_id, {r('latitude', 'latitude')} from med")
def geo_weighted_median(spark, sf_dir):
    return rounded(positioning.weighted_median(positioning.gated(A.fixes(spark, sf_dir)).filter("accepted"), "latitude"))


@query(f"with {A.FIXES}, pl as (select burst_id, avg(latitude) as lat0, avg(longitude) as lon0 from fx group by 1), d as (select burst_id, (latitude - lat0) * 1.1132e5 as n, (longitude - lon0) * 1.1132e5 * cos(radians(lat0)) as e from fx join pl using (burst_id)) select burst_id, case when count(*) >= 2 then {r('sqrt(avg(n * n + e * e))', 'x', 4).removesuffix(' as x')} end as dispersion from d group by 1")
def geo_dispersion(spark, sf_dir):
    f = A.fixes(spark, sf_dir)
    return rounded(positioning.dispersion(f, f.groupBy("burst_id").agg(F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"))), 4)


_VERDICT = f"""{A.FIXES}, {_MEDIAN}, run2 as (select *, sum(1e0 / (horizontal_accuracy * horizontal_accuracy)) over (partition by burst_id order by longitude, ord rows unbounded preceding) as run, sum(1e0 / (horizontal_accuracy * horizontal_accuracy)) over (partition by burst_id) as al from ok),
med2 as (select burst_id, min_by(longitude, row(longitude, ord)) as longitude from run2 where run >= al / 2 group by 1), pl as (select * from med join med2 using (burst_id)),
st as (select burst_id, count(*) as n, {', '.join(f'sum({c} / (horizontal_accuracy * horizontal_accuracy)) / sum(1e0 / (horizontal_accuracy * horizontal_accuracy)) as {c}' for c in ('altitude', 'horizontal_accuracy', 'vertical_accuracy'))} from ok group by 1),
ds as (select burst_id, case when count(*) >= 2 then sqrt(avg(((ok.latitude - pl.latitude) * 1.1132e5) ** 2 + ((ok.longitude - pl.longitude) * 1.1132e5 * cos(radians(pl.latitude))) ** 2)) end as dispersion from ok join pl using (burst_id) group by 1)"""


@query(f"with {_VERDICT} select burst_id, {r('latitude', 'latitude', 6)}, {r('longitude', 'longitude', 6)}, n, {r('altitude', 'altitude', 6)}, {r('horizontal_accuracy', 'horizontal_accuracy', 6)}, {r('vertical_accuracy', 'vertical_accuracy', 6)}, {r('dispersion', 'dispersion', 6)}, case when coalesce(dispersion, 0) <= 15 then 'good' else 'degraded' end as quality from pl join st using (burst_id) join ds using (burst_id)")
def geo_burst_verdict(spark, sf_dir):
    return rounded(positioning.verdicts(A.fixes(spark, sf_dir)))


@query(f"with {A.FIXES}, {A.TRACK}, d as (select burst_id, tx - lag(tx) over w as dx, tz - lag(tz) over w as dz from tk window w as (partition by burst_id order by ts, ord)) select burst_id, {r('coalesce(sum(sqrt(dx * dx + dz * dz)), 0)', 'length', 4)}, count(*) as n from d group by 1")
def geo_track_length(spark, sf_dir):
    return rounded(positioning.track_length(A.track(spark, sf_dir)), 4)


_ASOF = """fi as (select burst_id, ts, latitude, longitude from fx where event_type not in ('click', 'view')), p as (select tk.*, f.ts as t0, f.latitude as la0, f.longitude as lo0 from tk asof left join fi f on tk.burst_id = f.burst_id and tk.ts >= f.ts),
q as (select p.*, f.ts as t1, f.latitude as la1, f.longitude as lo1 from p asof left join fi f on p.burst_id = f.burst_id and p.ts <= f.ts), k as (select *, case when t1 > t0 then (epoch_us(ts) - epoch_us(t0)) / (epoch_us(t1) - epoch_us(t0))::double else 0e0 end as k from q),
ip as (select burst_id, ord, tx, tz, case when t0 is null then la1 when t1 is null then la0 else la0 + k * (la1 - la0) end as latitude, case when t0 is null then lo1 when t1 is null then lo0 else lo0 + k * (lo1 - lo0) end as longitude from k)"""


def _other(spark, sf_dir):
    return A.fixes(spark, sf_dir).filter("event_type not in ('click', 'view')")


@query(f"with {A.FIXES}, {A.TRACK}, {_ASOF} select burst_id, ord, {r('latitude', 'latitude')}, {r("longitude", "longitude")} from ip")
def geo_asof_interpolate(spark, sf_dir):
    return rounded(positioning.interpolated(A.track(spark, sf_dir), _other(spark, sf_dir)).select("burst_id", "ord", "latitude", "longitude"))


@query(f"""with {A.FIXES}, h as (select burst_id, (ord % 101) / 1e1 as ax, value / 1e1 as ay, (ord % 101) / 1e1 * 8e-1 - value / 1e1 * 6e-1 + (ord % 7) as gx, (ord % 101) / 1e1 * 6e-1 + value / 1e1 * 8e-1 as gy from fx),
c as (select burst_id, ax - avg(ax) over w as ax, ay - avg(ay) over w as ay, gx - avg(gx) over w as gx, gy - avg(gy) over w as gy from h window w as (partition by burst_id)),
y as (select burst_id, count(*) as n, atan2(sum(ax * gy - ay * gx), sum(ax * gx + ay * gy)) as yaw, avg(sqrt(ax * ax + ay * ay)) as rad from c group by 1)
select burst_id, any_value(n) as n, {r('any_value(yaw)', 'yaw')}, {r('sqrt(avg((cos(yaw) * ax - sin(yaw) * ay - gx) ** 2 + (sin(yaw) * ax + cos(yaw) * ay - gy) ** 2)) / any_value(rad)', 'sigma')} from c join y using (burst_id) group by burst_id""")
def geo_horn_yaw(spark, sf_dir):
    pairs = A.fixes(spark, sf_dir).selectExpr("burst_id", "(ord % 101) / 1e1 as ax", "value / 1e1 as ay", "(ord % 101) / 1e1 * 8e-1 - value / 1e1 * 6e-1 + (ord % 7) as gx", "(ord % 101) / 1e1 * 6e-1 + value / 1e1 * 8e-1 as gy")
    return rounded(positioning.horn_yaw(pairs))


_YAW = f"""{A.FIXES}, {A.TRACK}, {_ASOF}, tl as (select burst_id, sum(sqrt(dx * dx + dz * dz)) as len, count(*) as n from (select burst_id, tx - lag(tx) over w as dx, tz - lag(tz) over w as dz from tk window w as (partition by burst_id order by ts, ord)) group by 1),
og as (select burst_id, avg(latitude) as lat0, avg(longitude) as lon0 from fi group by 1), h as (select burst_id, tx as ax, -tz as ay, (longitude - lon0) * 1.1132e5 * cos(radians(lat0)) as gx, (latitude - lat0) * 1.1132e5 as gy from ip join og using (burst_id) join tl using (burst_id) where n >= 3 and len >= 10),
c as (select burst_id, ax - avg(ax) over w as ax, ay - avg(ay) over w as ay, gx - avg(gx) over w as gx, gy - avg(gy) over w as gy from h window w as (partition by burst_id)),
y as (select burst_id, count(*) as n, sum(ax * gy - ay * gx) as num, sum(ax * gx + ay * gy) as den, avg(sqrt(ax * ax + ay * ay)) as rad from c group by 1), z as (select *, atan2(num, den) as yaw from y where abs(num) > 1e-10 or abs(den) > 1e-10)"""


@query(f"with {_YAW} select burst_id, any_value(n) as n, {r('any_value(yaw)', 'yaw')}, {r('sqrt(avg((cos(yaw) * ax - sin(yaw) * ay - gx) ** 2 + (sin(yaw) * ax + cos(yaw) * ay - gy) ** 2)) / any_value(rad)', 'sigma')} from c join z using (burst_id) group by burst_id")
def geo_yaw(spark, sf_dir):
    return rounded(positioning.yaw(A.track(spark, sf_dir), _other(spark, sf_dir)))


_PROFILE = "case o_orderkey % 3 when 0 then 'exact' when 1 then 'degraded' else 'omitted' end"


@query(f"select o_orderkey, {_PROFILE} as profile, {r('case o_orderkey % 3 when 0 then o_totalprice when 1 then round(o_totalprice / 1e2) * 1e2 else 0e0 end', 'easting', 2)} from orders")
def geo_precision_profile(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders").withColumn("profile", F.expr(_PROFILE))
    return rounded(o.select("o_orderkey", "profile", G.precision(F.col("o_totalprice"), F.col("profile")).alias("easting")), 2)


# --------------------------------------------------------- registration, change

_NN = f"""{A.SOUP_V}, s as (select vid as sid, x, y, z from sv where vid % 2 = 0), t as (select vid as tid, x, y, z from sv where vid % 2 = 1), j as (select sid, tid, s.x as x, s.y as y, s.z as z, t.x as qx, t.y as qy, t.z as qz, (s.x - t.x) ** 2 + (s.y - t.y) ** 2 + (s.z - t.z) ** 2 as d2 from s join t on abs(floor(s.x / 1e0) - floor(t.x / 1e0)) <= 1 and abs(floor(s.y / 1e0) - floor(t.y / 1e0)) <= 1 and abs(floor(s.z / 1e0) - floor(t.z / 1e0)) <= 1),
nn as (select *, row_number() over (partition by sid order by d2, tid) as k from j)"""


def _halves(spark, sf_dir):
    v = A.soup_vertices(spark, sf_dir)
    return v.filter("vid % 2 = 0").select(F.col("vid").alias("sid"), "x", "y", "z"), v.filter("vid % 2 = 1").select(F.col("vid").alias("tid"), "x", "y", "z", F.lit(0.0).alias("nx"), F.lit(1.0).alias("ny"), F.lit(0.0).alias("nz"))


@query(f"with {_NN} select s.sid, tid, {r('d2', 'd2')} from s left join (select * from nn where k = 1) n on n.sid = s.sid")
def nn_bucketed(spark, sf_dir):
    return rounded(registration.nearest(*_halves(spark, sf_dir), 1.0).select("sid", "tid", "d2"))


@query(f"with {_NN} select count(*) as n, {r('sqrt(avg(d2))', 'rmse')} from nn where k = 1")
def nn_rmse(spark, sf_dir):
    near = registration.nearest(*_halves(spark, sf_dir), 1.0).filter("tid is not null")
    return rounded(near.agg(F.count("*").alias("n"), F.sqrt(F.avg("d2")).alias("rmse")))


def _pairs(spark, sf_dir):
    """The halves' pairs, written once, as trimming reads them several times."""
    return mesh.scratch(registration.nearest(*_halves(spark, sf_dir), 1.0).filter("tid is not null"), "pairs")


_TRIM = f"{_NN}, o as (select *, row_number() over (order by d2, sid) as pos, count(*) over () as n from nn where k = 1), tr as (select * from o where pos <= greatest(6, floor(n * 7.5e-1)))"


@query(f"with {_TRIM} select sid, tid, {r('d2', 'd2')} from tr")
def icp_correspondences_trimmed(spark, sf_dir):
    return rounded(registration.trimmed(_pairs(spark, sf_dir)).select("sid", "tid", "d2"))


_JAC = "0e0 as j0, 1e0 as j1, 0e0 as j2, -z as j3, 0e0 as j4, x as j5, y - qy as r"


@query(f"with {_TRIM}, jc as (select {_JAC} from tr) select {', '.join(r(f'sum(j{i} * j{k})', f'h{i}{k}', 4) for i in range(6) for k in range(i, 6))}, {', '.join(r(f'sum(j{i} * r)', f'g{i}', 4) for i in range(6))}, {r('sum(r * r)', 'e2', 4)}, count(*) as n from jc")
def icp_normal_equations(spark, sf_dir):
    pairs = registration.trimmed(_pairs(spark, sf_dir))
    flat = pairs.select("sid", "x", "y", "z", F.col("t.x").alias("qx"), F.col("t.y").alias("qy"), F.col("t.z").alias("qz"), F.col("t.nx").alias("nx"), F.col("t.ny").alias("ny"), F.col("t.nz").alias("nz"))
    return rounded(registration.normal_equations(flat), 4)


@query(f"""with {A.PTS}, b as (select cast(floor(x / 5e-2) as bigint) as i, cast(floor(z / 5e-2) as bigint) as j, max(y) as b from pts where l_returnflag = 'R' group by 1, 2), c as (select cast(floor(x / 5e-2) as bigint) as i, cast(floor(z / 5e-2) as bigint) as j, max(y) as c from pts where l_returnflag <> 'R' group by 1, 2),
d as (select case when c is null then 0e0 when b is null then abs(c) else c - b end as d from b full join c using (i, j)) select {r('coalesce(sum(case when d > 2e-2 then d end), 0) * 2.5e-3', 'gained')}, {r('coalesce(sum(case when d < -2e-2 then -d end), 0) * 2.5e-3', 'lost')}, count(*) as cells from d""")
def diff_grid_volume(spark, sf_dir):
    p = A.points(spark, sf_dir)
    grids = (registration.height_grid(p.filter(c), 0.05) for c in ("l_returnflag = 'R'", "l_returnflag <> 'R'"))
    return rounded(registration.grid_change(*grids, 0.05, 0.02))


def _dot(a: tuple, b: tuple) -> str:
    return "(" + " + ".join(f"({x}) * ({y})" for x, y in zip(a, b, strict=True)) + ")"


def _less(a: str, b: str) -> tuple:
    return tuple(f'(f."{a}{c}" - f."{b}{c}")' if a else f'(p.{c} - f."{b}{c}")' for c in "xyz")


def _segment2(a: str, b: str) -> str:
    """SQL of the squared distance of p from the side a b of face f."""
    q, e = _less("", a), _less(b, a)
    t = f"greatest(0e0, least(1e0, {_dot(q, e)} / {_dot(e, e)}))"
    d = tuple(f"{x} - {t} * {y}" for x, y in zip(q, e, strict=True))
    return _dot(d, d)


_SIGNED = f"""{A.SOUP_V}, {A.SOUP_T}, {_N}, p as (select vid, x, y + 5e-2 as y, z from sv),
hs as (select p.vid, fid, {_dot(_less('', 'a'), ('fx', 'fy', 'fz'))} / fl as h, sqrt(least({_segment2('a', 'b')}, {_segment2('b', 'c')}, {_segment2('c', 'a')})) as edge,
 {_dot(_less('', 'a'), _less('b', 'a'))} as d1, {_dot(_less('', 'a'), _less('c', 'a'))} as d2, {_dot(_less('b', 'a'), _less('b', 'a'))} as g11, {_dot(_less('b', 'a'), _less('c', 'a'))} as g12, {_dot(_less('c', 'a'), _less('c', 'a'))} as g22
 from p join nl f on p.x between least(f.ax, f.bx, f.cx) - 1 and greatest(f.ax, f.bx, f.cx) + 1 and p.y between least(f.ay, f."by", f.cy) - 1 and greatest(f.ay, f."by", f.cy) + 1 and p.z between least(f.az, f.bz, f.cz) - 1 and greatest(f.az, f.bz, f.cz) + 1),
br as (select *, (g22 * d1 - g12 * d2) / (g11 * g22 - g12 * g12) as s, (g11 * d2 - g12 * d1) / (g11 * g22 - g12 * g12) as t from hs),
ds as (select vid, fid, case when h < 0 then -1 else 1 end * case when s >= 0 and t >= 0 and s + t <= 1 then abs(h) else edge end as d from br), bs as (select vid, arg_min(d, row(abs(d), fid)) as d from ds group by 1)"""


@query(f"with {_SIGNED} select sv.vid, {r('case when abs(d) <= 1 then d else 0 end', 'd')} from sv left join bs using (vid)")
def diff_signed_distance(spark, sf_dir):
    v = A.soup_vertices(spark, sf_dir)
    tri = mesh.triangles(v, A.soup_faces(spark, sf_dir))
    return rounded(registration.signed_distances(v.withColumn("y", F.col("y") + 0.05), tri, 1.0).select("vid", "d"))


def _changed(spark, sf_dir):
    return A.soup_vertices(spark, sf_dir).withColumn("d", F.col("y") / 10.0)


_CLUSTERS = f"""with recursive {A.SOUP_V}, hot as (select vid, y / 1e1 as d, x, y, z, cast(floor(x / 6e-1) as bigint) as kx, cast(floor(y / 6e-1) as bigint) as ky, cast(floor(z / 6e-1) as bigint) as kz from sv where abs(y / 1e1) > 2e-1),
cells as (select row(kx, ky, kz) as n, kx, ky, kz from hot group by all), ed as (select a.n as u, b.n as v from cells a join cells b on abs(a.kx - b.kx) <= 1 and abs(a.ky - b.ky) <= 1 and abs(a.kz - b.kz) <= 1),
rc as (select n as node, n as root from cells union select ed.v, rc.root from rc join ed on ed.u = rc.node), lab as (select node, min(root) as root from rc group by 1)
select count(*) as n, {r('avg(x)', 'x')}, {r('avg(y)', 'y')}, {r('avg(z)', 'z')}, {r('sum(abs(d)) * 4e-2', 'volume')}, case when sum(d) >= 0 then 'gained' else 'lost' end as kind from hot join lab on lab.node = row(kx, ky, kz) group by root having count(*) >= 5"""


@query(_CLUSTERS)
def diff_clusters(spark, sf_dir):
    return rounded(registration.change_clusters(_changed(spark, sf_dir), 0.2, 0.2).drop("component"))


@query()
def icp_align(spark, sf_dir):
    v = A.soup_vertices(spark, sf_dir)
    n = V.normalized((F.col("x") * 0.3, F.lit(1.0), F.col("z") * 0.7))
    target = v.select(F.col("vid").alias("tid"), "x", "y", "z", *(c.alias("n" + k) for c, k in zip(n, "xyz", strict=True)))
    m = V.matrix((0.02, -0.01, 0.015)) @ V.rotation((0, 1, 0), 0.5)
    source = mesh.transformed(v.select(F.col("vid").alias("sid"), "x", "y", "z"), V.rigid_inverse(m))
    got = registration.icp(source, target, voxels=(1.0,), iterations=6, distance=1.0)
    return rounded(spark.createDataFrame([(float(got.rmse), int(got.iterations), *map(float, got.transform[:3, 3]))], "rmse double, iterations long, tx double, ty double, tz double"), 4)


# ------------------------------------------------------- components, relations


@query(f"with {A.PART_V} select mesh_id, count(*) as vertices, min(vid)::bigint as component from pv group by mesh_id", dealt=True)
def components_vertex(spark, sf_dir):
    return mesh.vertex_components(A.part_vertices(spark, sf_dir), A.part_faces(spark, sf_dir)).groupBy("mesh_id", "component").agg(F.count("*").alias("vertices"))


@query("select p_partkey as mesh_id, component, 2::bigint as faces from part, (values (0), (2), (4), (6), (8), (10)) t(component)", dealt=True)
def components_dihedral(spark, sf_dir):
    tri = mesh.triangles(A.part_vertices(spark, sf_dir), A.part_faces(spark, sf_dir))
    return segmentation.face_components(tri, 45.0).groupBy("mesh_id", "component").agg(F.count("*").alias("faces"))


@query(dealt=True)
def segment_pipeline(spark, sf_dir):
    found, _ = segmentation.segments(A.part_vertices(spark, sf_dir), A.part_faces(spark, sf_dir), least=6)
    return rounded(found.drop("axes"))


_REL = f"""with {A.BOXES}, pr as (select a.scan, a.id as f, b.id as t, b.cx - a.cx as dx, b.cy - a.cy as dy, b.cz - a.cz as dz from bx a join bx b on a.scan = b.scan and a.id < b.id),
co as (select scan, id, cx + sx * hx as x, cy + sy * hy as y, cz + sz * hz as z from bx, (values (-1), (1)) p(sx), (values (-1), (1)) q(sy), (values (-1), (1)) w(sz)),
gp as (select a.scan, a.id as f, b.id as t, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)) as gap from co a join co b on a.scan = b.scan and a.id < b.id group by all)
select scan, f as "from", t as "to", 'distance' as kind, {r('sqrt(dx * dx + dy * dy + dz * dz)', 'value')} from pr
union all select scan, f, t, 'azimuth', case when abs(dx) < 1e-12 and abs(dz) < 1e-12 then 0e0 else round((degrees(atan2(dx, -dz)) % 360 + 360) % 360, 6) + 0e0 end from pr
union all select scan, f, t, 'heightDelta', round(dy, 6) + 0e0 from pr union all select scan, f, t, 'contact', round(gap, 6) + 0e0 from gp where gap < 2e-1"""


@query(_REL)
def specimen_relations(spark, sf_dir):
    return rounded(segmentation.relations(A.specimen_boxes(spark, sf_dir), 0.2))


# ----------------------------------------------------------------- repairs


_SIDES = "(values (1, 0), (-1, 0), (0, 1), (0, -1)) s(di, dj)"
#: Empty cells that the border does not reach, then sweep by sweep the means of filled neighbours, until none is left.
_FILL = f"""with recursive {A.PTS}, f as (select l_returnflag as flag, cast(floor(z / 5e-2) as bigint) as i, cast(floor(x / 5e-2) as bigint) as j, y - 5e-1 as h from pts where not (x between 0.4 and 0.6 and z between 0.4 and 0.6)),
th as (select flag, i, j, max(case when h >= 0 then h end) as up from f group by all having max(case when h >= 0 then h end) is not null),
bo as (select flag, min(i) as i0, max(i) as i1, min(j) as j0, max(j) as j1 from th group by flag),
al as (select flag, i, j, i in (i0, i1) or j in (j0, j1) as edge from bo, unnest(generate_series(i0, i1)) s(i), unnest(generate_series(j0, j1)) t(j)), em as (select * from al anti join th using (flag, i, j)),
rc as (select flag, i, j from em where edge union select em.flag, em.i, em.j from rc, {_SIDES} join em on em.flag = rc.flag and em.i = rc.i + di and em.j = rc.j + dj),
ho as (select flag, i, j from (select flag, i, j from em) anti join rc using (flag, i, j)),
sw as (select 0 as k, flag, i, j, up as v from th union all select 0, flag, i, j, null from ho),
st as (select * from sw union all select c.k + 1, c.flag, c.i, c.j, coalesce(c.v, c.around) from (select a.k, a.flag, a.i, a.j, a.v, avg(b.v) as around, count(*) filter (a.v is null) over () as open from st a cross join {_SIDES} left join st b on b.flag = a.flag and b.i = a.i + di and b.j = a.j + dj group by a.k, a.flag, a.i, a.j, a.v) c where open > 0 and c.k < 400)
select flag, i, j, {r('max_by(v, k)', 'up')}, (flag, i, j) in (select (flag, i, j) from ho) as filled from st group by flag, i, j"""


@query(_FILL)
def hole_fill(spark, sf_dir):
    p = A.points(spark, sf_dir).withColumn("flag", F.col("l_returnflag")).filter("not (x between 0.4 and 0.6 and z between 0.4 and 0.6)")
    cells = volume.envelope(volume.heights(p, *UP, 0.05, ("flag",)), ("flag",))
    return rounded(volume.filled_holes(cells, "up", "flag"))


_WHOLE = f"select mesh_id, 12::bigint as faces, {r('8 * hx * hy * hz', 'volume')} from (select {A._PARTS} from part)"


@query(_WHOLE.replace("12::bigint", "14::bigint"), dealt=True)
def mesh_close(spark, sf_dir):
    v, f = mesh.closed(A.part_vertices(spark, sf_dir), A.part_faces(spark, sf_dir).filter("fid > 1"))
    return _faces_and_volume(v, f)


def _faces_and_volume(v, f):
    volume_ = mesh.closed_volume(mesh.triangles(v, f)).select("mesh_id", F.abs("volume").alias("volume"))
    return rounded(f.groupBy("mesh_id").agg(F.count("*").alias("faces")).join(volume_, "mesh_id"))


@query(_WHOLE, dealt=True)
def mesh_fix_orientation(spark, sf_dir):
    v, f = A.part_vertices(spark, sf_dir), A.part_faces(spark, sf_dir)
    turned = (F.col("fid") + F.col("mesh_id")) % 3 == 1
    mixed = f.select("mesh_id", "fid", "a", F.when(turned, F.col("c")).otherwise(F.col("b")).alias("b"), F.when(turned, F.col("b")).otherwise(F.col("c")).alias("c"))
    return _faces_and_volume(v, mesh.oriented_faces(v, mixed))


def _decided(k: int, before: str, lo: int, hi: int) -> str:
    """SQL of the faces that are left when the edge (lo, hi) has kept its two most nearly parallel ones of more than two."""
    on = f"{lo} in (a, b, c) and {hi} in (a, b, c)"
    return f"""u{k} as (select *, count(*) over (partition by mesh_id) as n from {before} where {on}),
p{k} as (select i.mesh_id, i.fid as fi, j.fid as fj, row_number() over (partition by i.mesh_id order by round(abs(i.nx * j.nx + i.ny * j.ny + i.nz * j.nz), 9) desc, i.fid, j.fid) as o from u{k} i join u{k} j on i.mesh_id = j.mesh_id and i.fid < j.fid where i.n > 2),
s{k} as (select t.* from {before} t left join p{k} p on p.mesh_id = t.mesh_id and p.o = 1 where p.o is null or not ({on}) or t.fid in (p.fi, p.fj))"""


#: Fins on the edge from corner 0 to 2 of each box; the third of them also touches the edge from 2 to 6.
_FINS = ((99, 0, 2, 7, 1), (98, 0, 2, 5, 2), (97, 0, 2, 6, 3))
_FINNED = f"""{A.PART_V}, {A.PART_F}, ff as (select * from pf union all select p_partkey, fid, a, b, c from part, (values {', '.join(str(x) for x in _FINS)}) x(fid, a, b, c, every) where p_partkey % every = 0),
{A.PART_T.replace('pt as', 'ft as').replace('from pf f', 'from ff f')}, {_PN.split('vn as')[0].strip().removesuffix(',').replace('pn as', 'fn as').replace('from pt', 'from ft')},
n0 as (select mesh_id, fid, a, b, c, fx / l as nx, fy / l as ny, fz / l as nz from (select *, sqrt(fx * fx + fy * fy + fz * fz) as l from fn))"""


@query(f"with {_FINNED}, {_decided(1, 'n0', 0, 2)}, {_decided(2, 's1', 2, 6)} select mesh_id, fid::bigint as fid from s2", dealt=True)
def mesh_manifold_pass(spark, sf_dir):
    v, f = A.part_vertices(spark, sf_dir), A.part_faces(spark, sf_dir)
    fins = F.array(*(F.struct(*(F.lit(x).cast("long").alias(n) for n, x in zip(("fid", "a", "b", "c", "every"), fin, strict=True))) for fin in _FINS))
    extra = f.filter("fid = 0").select("mesh_id", F.explode(fins).alias("x")).select("mesh_id", "x.*").filter("mesh_id % every = 0").drop("every")
    return mesh.manifold_faces(v, f.unionByName(extra)).select("mesh_id", "fid")


# ------------------------------------------------------------ custody, store

_FILES = "concat(source, '/', doc_id)"


@query("select source as bundle_id, source || '/' || doc_id as relative_path, octet_length(encode(text))::bigint as bytes, sha256(text) as sha256 from documents where source <> 'src1'")
def custody_manifest(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").select(F.col("source").alias("bundle_id"), F.expr(_FILES).alias("relative_path"), F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("sha256"), F.when(F.col("source") == "src1", F.concat(F.lit("seals/"), F.col("doc_id"))).otherwise(F.expr(_FILES)).alias("p"))
    return d.filter(custody.is_content(F.col("p"))).drop("p")


@query("""with m as (select source as bundle_id, source || '/' || doc_id as p, '{"bytes":' || octet_length(encode(text)) || ',"relativePath":"' || source || '/' || doc_id || '","sha256":"' || sha256(text) || '"}' as t from documents) select bundle_id, sha256('[' || string_agg(t, ',' order by p) || ']') as root_hash, count(*) as entries from m group by 1""")
def custody_root_hash(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").select(F.col("source").alias("bundle_id"), F.expr(_FILES).alias("relative_path"), F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("sha256"))
    return custody.root_hash(d, "bundle_id")


_CHAIN = "c as (select conv_id, turn, sha256(text) as seal_hash, case when turn > 0 then case when turn % 3 = 2 then sha256('x') else lag(sha256(text)) over (partition by conv_id order by turn) end end as prev_hash from conversations)"


@query(f"with {_CHAIN}, l as (select *, lag(seal_hash) over (partition by conv_id order by turn) as b, row_number() over (partition by conv_id order by turn) = 1 as f from c) select conv_id, turn, case when f and prev_hash is not null then 'unexpected' when not f and prev_hash is distinct from b then 'broken' else 'ok' end as link from l")
def custody_chain_links(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    c = A.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2("text", 256).alias("seal_hash"))
    c = c.withColumn("prev_hash", F.when(F.col("turn") > 0, F.when(F.col("turn") % 3 == 2, F.sha2(F.lit("x"), 256)).otherwise(F.lag("seal_hash").over(w))))
    return custody.chain_links(c, "conv_id", "turn").select("conv_id", "turn", "link")


def _bundles(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").select(F.col("source").alias("bundle_id"), F.expr(_FILES).alias("relative_path"), F.sha2("text", 256).alias("sha256"), "doc_id")
    declared = d.filter("doc_id % 10 <> 3")
    found = d.filter("doc_id % 10 <> 5").withColumn("sha256", F.when(F.col("doc_id") % 10 == 7, F.sha2(F.lit("x"), 256)).otherwise(F.col("sha256")))
    return declared.drop("doc_id"), found.drop("doc_id")


_FAULT = "select source as bundle_id, source || '/' || doc_id as relative_path, case doc_id % 10 when 5 then 'missing' when 7 then 'changed' else 'undeclared' end as fault from documents where doc_id % 10 in"


@query(f"{_FAULT} (3, 5, 7)")
def custody_verify_files(spark, sf_dir):
    return custody.file_faults(*_bundles(spark, sf_dir))


@query(f"{_FAULT} (3)")
def custody_extra_files(spark, sf_dir):
    return custody.file_faults(*_bundles(spark, sf_dir)).filter("fault = 'undeclared'")


_TURNS = "case turn % 5 when 3 then 'missing' when 4 then 'changed' else 'undeclared' end"


@query(f"with {_CHAIN}, l as (select *, lag(seal_hash) over w as b, row_number() over w as k from c window w as (partition by conv_id order by turn)) select conv_id, 'link' as fault, turn::varchar as at from l where (k = 1 and prev_hash is not null) or (k > 1 and prev_hash is distinct from b) union all select conv_id, 'index', turn::varchar from l where k - 1 <> turn union all select conv_id, {_TURNS}, turn::varchar from conversations where turn % 5 in (2, 3, 4)")
def custody_verify_chain(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    c = A.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2("text", 256).alias("seal_hash"))
    seals = c.withColumn("prev_hash", F.when(F.col("turn") > 0, F.when(F.col("turn") % 3 == 2, F.sha2(F.lit("x"), 256)).otherwise(F.lag("seal_hash").over(w))))
    files = c.select("conv_id", F.col("turn").cast("string").alias("relative_path"), F.col("seal_hash").alias("sha256"), (F.col("turn") % 5).alias("k"))
    found = files.filter("k <> 3").withColumn("sha256", F.when(F.col("k") == 4, F.sha2(F.lit("x"), 256)).otherwise(F.col("sha256")))
    return custody.chain_faults(seals, files.filter("k <> 2").drop("k"), found.drop("k"), "conv_id", "turn")


@query("select event_id, (epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id)) / 1e6 as delta from events")
def custody_monotonic_delta(spark, sf_dir):
    return custody.monotonic_deltas(A.table(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("event_id", "delta")


@query("""select o_orderkey, '{"key":' || o_orderkey || ',"priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}' as json from orders""")
def canonical_json(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", C.canonical_json(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("priority"))).alias("json"))


@query("select event_id, strftime(make_timestamp(cast(round(epoch_us(ts) / 1e3) as bigint) * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' as iso, cast(round(epoch_us(ts) / 1e3) as bigint) as ms from events")
def canonical_instants(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    return A.table(spark, sf_dir, "events").select("event_id", C.iso_ms(ts).alias("iso"), C.unix_ms(ts).alias("ms"))


@query("select o.o_orderkey as finding_id, o.o_orderdate as created_at, count(l.l_orderkey) as scan_count, coalesce(sum((l_returnflag = 'R')::int), 0)::bigint as sealed_count from orders o left join lineitem l on l.l_orderkey = o.o_orderkey group by all")
def store_findings_summary(spark, sf_dir):
    return store.summaries(*_store(spark, sf_dir))


def _store(spark, sf_dir):
    return A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("finding_id"), F.col("o_orderdate").alias("created_at")), A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("finding_id"), (F.col("l_returnflag") == "R").alias("sealed"))


@query("select o_orderkey as finding_id, o_orderdate as created_at from orders")
def store_listing(spark, sf_dir):
    return store.listing(_store(spark, sf_dir)[0])


@query("with recursive s as (select o_orderkey as id, case when o_orderkey % 4 = 0 then null else o_orderkey - 1 end as parent from orders), t as (select id, id as root, 0 as depth from s where parent is null union all select s.id, t.root, t.depth + 1 from t join s on s.parent = t.id) select id as scan_id, root, depth from t")
def scan_lineage(spark, sf_dir):
    scans = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scan_id"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey") - 1).alias("parent_scan_id"))
    return store.lineage(scans)


# -------------------------------------------------------------------- exports


@query(f"""select 1 as section, '' as ord, '{records.SPECIMEN_COLUMNS}' as line union all select 1, '1' || lpad(cast(s_suppkey as varchar), 19, '0'), s_suppkey || ',' || s_name || ',' || (s_suppkey % 13) || ',' || s_nationkey || ',' || (s_suppkey % 7) || ',1,2,3,1,2,3,,,"height, field",,' || (s_suppkey // 10) || ',EX' from supplier""")
def export_csv_rows(spark, sf_dir):
    s = A.table(spark, sf_dir, "supplier")
    dims = {n: F.lit(v) for n, v in zip(("length_m", "width_m", "height_m", "dim_x_m", "dim_y_m", "dim_z_m"), (1, 2, 3, 1, 2, 3), strict=True)}
    rows = s.select(
        F.col("s_suppkey").alias("specimen_id"), F.col("s_name").alias("label"), (F.col("s_suppkey") % 13).alias("center_x_m"), F.col("s_nationkey").alias("center_y_m"), (F.col("s_suppkey") % 7).alias("center_z_m"), *(c.alias(n) for n, c in dims.items()),
        F.lit(None).cast("int").alias("exposed_volume_m3"), F.lit(None).cast("int").alias("estimated_volume_m3"), F.lit("height, field").alias("volume_method"), F.lit(None).cast("string").alias("classification_hint"), F.floor(F.col("s_suppkey") / 10).cast("long").alias("finding_id"), F.lit("EX").alias("expedition_code"),
    )
    return records.csv_lines(rows, records.SPECIMEN_COLUMNS, 1, "specimen_id")


@query("""select s_suppkey, '{"type":"FeatureCollection","crs":{"type":"name","properties":{"name":"urn:ogc:def:crs:EPSG::32719"}},"features":[{"type":"Feature","geometry":{"type":"Point","coordinates":[' || (300000 + s_suppkey) || ',' || (6000000 + s_nationkey) || ']},"properties":{"title":"' || s_name || '","id":"' || s_suppkey || '"}}]}' as feature from supplier""")
def export_geojson_feature(spark, sf_dir):
    s = A.table(spark, sf_dir, "supplier")
    return records.geojson(s, 300000 + F.col("s_suppkey"), (6000000 + F.col("s_nationkey")).cast("long"), F.lit(32719), {"title": F.col("s_name"), "id": F.col("s_suppkey").cast("string")}).select("s_suppkey", "feature")


_OBJ = f"select p_partkey as mesh_id, 0 as part, 0 as ord, 'o ' || p_partkey as line from part union all select p_partkey, 1, k + 1, 'v ' || (p_partkey / 2e0) || ' ' || (k + 25e-2) || ' ' || p_size from part, unnest(generate_series(0, 7)) t(k)"


def _obj_vertices(spark, sf_dir):
    v = A.dealt(A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("mesh_id"), "p_size"), "mesh_id").select("mesh_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("vid"), (F.col("mesh_id") / 2.0).alias("x"), "p_size")
    return v.select("mesh_id", "vid", "x", (F.col("vid") + 0.25).alias("y"), F.col("p_size").alias("z"))


@query(f"with {A.PART_F} {_OBJ} union all select mesh_id, 3, fid, 'f ' || (a + 1) || ' ' || (b + 1) || ' ' || (c + 1) from pf")
def export_obj_lines(spark, sf_dir):
    return records.obj_lines(_obj_vertices(spark, sf_dir), A.part_faces(spark, sf_dir))


@query(f"with {A.PART_F} {_OBJ} union all select p_partkey, 2, k + 1, 'vn 0.0 ' || (k / 4e0) || ' -1.0' from part, unnest(generate_series(0, 7)) t(k) union all select mesh_id, 3, fid, 'f ' || (a + 1) || '//' || (a + 1) || ' ' || (b + 1) || '//' || (b + 1) || ' ' || (c + 1) || '//' || (c + 1) from pf")
def export_obj_normals(spark, sf_dir):
    v = _obj_vertices(spark, sf_dir)
    return records.obj_lines(v, A.part_faces(spark, sf_dir), v.select("mesh_id", "vid", F.lit(0.0).alias("nx"), (F.col("vid") / 4.0).alias("ny"), F.lit(-1.0).alias("nz")))


def _through_ply(spark, sf_dir):
    return meshfiles.decoded_ply(meshfiles.encoded(A.part_vertices(spark, sf_dir), A.part_faces(spark, sf_dir), "ply"))


@query(f"with {A.PART_V} select mesh_id, vid::bigint as vid, x::float::double as x, y::float::double as y, z::float::double as z from pv")
def codec_ply_round_trip(spark, sf_dir):
    return _through_ply(spark, sf_dir)[0]


@query(f"with {A.PART_F} select mesh_id, fid::bigint as fid, a::bigint as a, b::bigint as b, c::bigint as c from pf")
def codec_ply_faces(spark, sf_dir):
    return _through_ply(spark, sf_dir)[1]


@query("select p_partkey as mesh_id, 84 + 50 * 12 as bytes from part")
def codec_stl(spark, sf_dir):
    return meshfiles.encoded(A.part_vertices(spark, sf_dir), A.part_faces(spark, sf_dir), "stl").select("mesh_id", F.octet_length("content").alias("bytes"))


@query()
def codec_las(spark, sf_dir):
    utm = {"easting": 350000.0, "northing": 6300000.0, "height": 500.0, "epsg": 32719}
    return meshfiles.encoded_las(A.part_vertices(spark, sf_dir), utm).select("mesh_id", F.octet_length("content").alias("bytes"), F.sha2("content", 256).alias("sha256"))
