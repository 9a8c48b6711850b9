"""Plans that must hold at any depth, size and form, and the refusals, against plain recomputations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravox.errors import ExportError, GeometryError, MeshError, RegistrationError, StoreError, StratigraphyError
from terravox.functions import vectors as V
from terravox.operators import custody, fit, mesh, positioning, registration, segmentation, store, volume
from terravox.sources import meshfiles, records

XYZ = "x double, y double, z double"


def box(spark, mesh_id=0, half=(0.5, 0.5, 0.5)):
    from terravox.plans.adapters import CUBE

    v = [(mesh_id, k, *(float(h) if k >> b & 1 else -float(h) for b, h in enumerate(half))) for k in range(8)]
    return spark.createDataFrame(v, f"mesh_id long, vid long, {XYZ}"), spark.createDataFrame([(mesh_id, i, *f) for i, f in enumerate(CUBE)], "mesh_id long, fid long, a long, b long, c long")


def test_lineage_of_any_depth(spark):
    chain = [(i, i - 1 if i else None) for i in range(1000)] + [(5000, None), (5001, 5000), (6001, 6000)]
    got = {r.scan_id: (r.root, r.depth) for r in store.lineage(spark.createDataFrame(chain, "scan_id long, parent_scan_id long")).collect()}
    assert got == {i: (0, i) for i in range(1000)} | {5000: (5000, 0), 5001: (5000, 1)}
    with pytest.raises(StoreError, match="cycle"):
        store.lineage(spark.createDataFrame([(1, 2), (2, 1), (3, None)], "scan_id long, parent_scan_id long"))
    assert store.lineage(spark.createDataFrame([], "scan_id long, parent_scan_id long")).count() == 0


def test_as_of_has_only_growing_frames(spark):
    """Both frames run from the partition's start to the row, so a burst costs its sort and one pass."""
    track = spark.range(6000).select(F.lit(0).alias("burst_id"), F.timestamp_seconds(F.col("id") * 2).alias("ts"), F.col("id").alias("ord"))
    fixes = spark.range(0, 6000, 7).select(F.lit(0).alias("burst_id"), F.timestamp_seconds(F.col("id") * 2 + 1).alias("ts"), F.col("id").cast("double").alias("latitude"), F.lit(1.0).alias("longitude"))
    df = positioning.interpolated(track, fixes)
    plan = df._jdf.queryExecution().toString().lower()
    assert "unboundedfollowing" not in plan
    t = np.arange(0, 6000, 7) * 2 + 1
    got = df.orderBy("ord").select("latitude").toPandas().latitude.to_numpy()
    assert np.allclose(got, np.interp(np.arange(6000) * 2, t, np.arange(0, 6000, 7).astype(float)), atol=1e-6)


def swept(grid, sweeps=400):
    """Hole filling of one dense grid."""
    was = ~np.isnan(grid)
    outside = np.zeros_like(was)
    outside[[0, -1], :] = outside[:, [0, -1]] = True
    outside &= ~was
    while True:
        wide = outside.copy()
        wide[1:] |= outside[:-1]
        wide[:-1] |= outside[1:]
        wide[:, 1:] |= outside[:, :-1]
        wide[:, :-1] |= outside[:, 1:]
        wide &= ~was
        if (wide == outside).all():
            break
        outside = wide
    for _ in range(sweeps):
        pad = np.pad(grid, 1, constant_values=np.nan)
        near = np.stack((pad[:-2, 1:-1], pad[2:, 1:-1], pad[1:-1, :-2], pad[1:-1, 2:]))
        n = (~np.isnan(near)).sum(0)
        todo = np.isnan(grid) & ~outside & (n > 0)
        if not todo.any():
            break
        grid[todo] = (np.nansum(near, 0) / np.maximum(n, 1))[todo]
    return grid, was


def test_holes_are_filled_like_a_whole_grid(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for g in range(3):
        grid = rng.uniform(0, 1, (25, 18))
        grid[rng.uniform(size=grid.shape) < 0.35] = np.nan
        grid[8:14, 5:11] = np.nan
        i0, j0 = -7, 40
        rows += [(f"g{g}", int(i) + i0, int(j) + j0, float(grid[i, j])) for i, j in zip(*np.nonzero(~np.isnan(grid)), strict=True)]
        used = np.nonzero(~np.isnan(grid))
        a, b, c, d = used[0].min(), used[0].max() + 1, used[1].min(), used[1].max() + 1
        full, was = swept(grid[a:b, c:d].copy())
        want |= {(f"g{g}", i + i0 + a, j + j0 + c): (full[i, j], not was[i, j]) for i, j in zip(*np.nonzero(~np.isnan(full)), strict=True)}
    cells = spark.createDataFrame([*rows, ("g0", 0, 41, None)], "flag string, i long, j long, up double")
    got = {(r.flag, r.i, r.j): (r.up, r.filled) for r in volume.filled_holes(cells, "up", "flag").collect()}
    assert got.keys() == want.keys()
    assert all(got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0]) for k in want)
    ring = [("r", i, j, 1.0) for i in range(9) for j in range(9) if i in (0, 8) or j in (0, 8)]
    left = volume.filled_holes(spark.createDataFrame(ring, "flag string, i long, j long, up double"), "up", "flag", sweeps=2).filter("up is null")
    assert left.count() == 9 and left.filter("filled").count() == 0


def test_trimmed_takes_the_nearest(spark, monkeypatch):
    monkeypatch.setattr(registration, "RANKED", 50)
    rng = np.random.default_rng(6)
    d2 = np.concatenate((rng.exponential(1, 3000) ** 3, np.full(700, 0.25), [1e9]))
    pairs = spark.createDataFrame(list(enumerate(map(float, d2))), "sid long, d2 double")
    for cut in (0.25, 0.6, 0.0, 0.999):
        keep = max(6, int(np.floor(len(d2) * (1 - cut))))
        want = sorted(zip(d2, range(len(d2)), strict=True))[:keep]
        assert sorted((r.d2, r.sid) for r in registration.trimmed(pairs, cut).collect()) == want
    assert registration.trimmed(pairs.filter("false")).count() == 0


def test_numbers_follow_key_order(spark):
    rows = [(m, int(k)) for m in range(3) for k in np.random.default_rng(m).permutation(500)[: 100 * m + 5]]
    got = mesh.numbered(spark.createDataFrame(rows, "mesh_id long, key long").repartition(7), "key").collect()
    for m in range(3):
        own = sorted(r.key for r in got if r.mesh_id == m)
        assert [r.vid for r in sorted((r for r in got if r.mesh_id == m), key=lambda r: r.key)] == list(range(len(own)))


def test_signed_distance_to_faces_of_any_size(spark):
    rng = np.random.default_rng(12)
    tri = np.concatenate((rng.uniform(0, 20, (6, 3, 3)), rng.uniform(0, 20, (40, 1, 3)) + rng.uniform(0, 0.2, (40, 3, 3))))
    pts = np.concatenate((rng.uniform(0, 20, (150, 3)), tri[6:, 0] + 0.1))
    t = spark.createDataFrame([(0, i, *map(float, f.ravel())) for i, f in enumerate(tri)], "mesh_id long, fid long, " + ", ".join(f"{k}{c} double" for k in "abc" for c in "xyz"))
    p = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(pts)], f"vid long, {XYZ}")

    def exact(q, a, b, c):
        e1, e2, n = b - a, c - a, np.cross(b - a, c - a)
        s, u = np.linalg.solve([[e1 @ e1, e1 @ e2], [e1 @ e2, e2 @ e2]], [e1 @ (q - a), e2 @ (q - a)])
        if s >= 0 and u >= 0 and s + u <= 1:
            return abs((q - a) @ n) / np.linalg.norm(n)
        side = lambda m, o: np.linalg.norm(q - m - np.clip((q - m) @ (o - m) / ((o - m) @ (o - m)), 0, 1) * (o - m))
        return min(side(a, b), side(b, c), side(c, a))

    for r in registration.signed_distances(p, t, 0.6).collect():
        d = min(exact(pts[r.vid], *f) for f in tri)
        assert abs(r.d) == pytest.approx(d if d <= 0.6 else 0, abs=1e-9)
    assert registration.signed_distances(p, t.filter("false"), 0.6).filter("d <> 0").count() == 0


def test_icp_options(spark):
    """The bound on distance, agreeing normals, the stable mask, and the final RMSE over all points."""
    rng = np.random.default_rng(17)
    pts, normals = [], []
    for axis in range(3):
        q = np.insert(rng.uniform(-0.25, 0.25, (500, 2)), axis, 0.25, 1)
        pts.append(q)
        normals.append(np.tile(np.eye(3)[axis], (len(q), 1)))
    p, n = np.vstack(pts), np.vstack(normals)
    target = spark.createDataFrame([(i, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(p, n, strict=True))], f"tid long, {XYZ}, nx double, ny double, nz double").cache()
    m = V.matrix((0.015, -0.01, 0.012)) @ V.rotation((1, 2, 3), 2)
    source = mesh.transformed(target.select(F.col("tid").alias("sid"), "x", "y", "z", "nx", "ny", "nz"), V.rigid_inverse(m)).cache()
    got = registration.icp(source, target, voxels=(0.1, 0.05), iterations=10)
    assert np.abs(got.transform - m).max() < 5e-3 and got.rmse < 2e-3
    # A fifth of the target has moved away; only the rest is stable.
    gone = target.withColumn("y", F.when(F.col("tid") % 5 == 0, F.col("y") + 0.06).otherwise(F.col("y")))
    masked = registration.icp(source, gone, voxels=(0.1, 0.05), iterations=10, stable=F.col("tid") % 5 != 0)
    assert np.abs(masked.transform - m).max() < 5e-3
    with pytest.raises(RegistrationError, match="insufficient"):
        registration.icp(source, target.withColumn("x", F.col("x") + 0.5), voxels=(0.1,), iterations=3)
    with pytest.raises(RegistrationError, match="insufficient"):  # normals at right angles to all of the target's
        registration.icp(source.withColumns({"nx": F.lit(0.0), "ny": F.lit(0.0), "nz": F.lit(0.0)}), target, voxels=(0.1,), iterations=3)


def test_refusals(spark):
    v, f = box(spark)
    hole = f.filter("fid > 1")
    assert mesh.closed_volume(mesh.triangles(v, f)).first().volume == pytest.approx(1.0)
    with pytest.raises(Exception, match="mesh is open"):
        mesh.closed_volume(mesh.triangles(v, hole)).collect()
    assert mesh.closed_volume(mesh.triangles(v, hole), "null").first().volume is None
    v2, f2 = mesh.closed(v, hole)
    assert mesh.watertightness(v2, f2).first().is_closed and abs(mesh.closed_volume(mesh.triangles(v2, f2)).first().volume) == pytest.approx(1.0)
    fin = hole.unionByName(spark.createDataFrame([(0, 90, 0, 7, 3), (0, 91, 0, 7, 5)], "mesh_id long, fid long, a long, b long, c long"))
    with pytest.raises(Exception, match="still open"):
        mesh.closed(v, fin)[1].collect()
    with pytest.raises(Exception, match="empty mesh"):
        meshfiles.encoded(v, f.filter("false")).collect()
    place = spark.createDataFrame([(1, None)], "id int, e double")
    with pytest.raises(Exception, match="missing UTM"):
        records.geojson(place, F.col("e"), F.col("e"), F.lit(32719), {"id": F.col("id")}).collect()
    with pytest.raises(ExportError, match="missing UTM"):
        meshfiles.las_bytes(np.zeros((1, 3)), None)
    marks, image = spark.createDataFrame([(9, 9)], "col long, row long"), spark.createDataFrame([(1, 1)], "col long, row long")
    with pytest.raises(StratigraphyError, match="no marks"):
        fit.back_projected(marks, image, 20.0, (0.0, 0.0), (0, 0, 0), (0.0, 1.0, 0.0), V.seeded_basis)
    with pytest.raises(MeshError):
        meshfiles.ply_parts(b"ply\nend_header\n")


def test_orientation_of_large_and_odd_meshes(spark):
    """A torus with faces turned at random, two pieces, a Moebius band, and an edge of three faces."""
    rng = np.random.default_rng(30)
    n, m = 24, 15
    at = lambda i, j: (i % n) * m + j % m
    good = [f for i in range(n) for j in range(m) for f in ((at(i, j), at(i + 1, j), at(i, j + 1)), (at(i + 1, j), at(i + 1, j + 1), at(i, j + 1)))]
    turn = rng.uniform(size=len(good)) < 0.4
    turn[0] = False
    rows = [(0, k, *((a, c, b) if t else (a, b, c))) for k, ((a, b, c), t) in enumerate(zip(good, turn, strict=True))]
    band = [(k, (k + 1) % 5, (k + 2) % 5) for k in range(5)]
    rows += [(1, k, *map(int, f)) for k, f in enumerate(band)] + [(2, 0, 0, 1, 2), (2, 1, 0, 1, 3), (2, 2, 1, 0, 4)]
    f = spark.createDataFrame(rows, "mesh_id long, fid long, a long, b long, c long")
    got = {(r.mesh_id, r.fid): r for r in mesh.oriented_faces(f.select("mesh_id", F.col("a").alias("vid")), f).collect()}
    assert len(got) == len(rows)
    assert [got[0, k].flipped for k in range(len(good))] == turn.tolist()
    assert all((r.a, r.b, r.c) == good[k] for (i, k), r in got.items() if i == 0)
    assert not any(r.flipped for (i, _), r in got.items() if i == 2)


def test_contact_is_the_nearest_corners(spark):
    rng = np.random.default_rng(3)
    rows = [(0, i, *map(float, rng.uniform(0, 2, 3)), *map(float, rng.uniform(0.1, 0.4, 3))) for i in range(7)]
    got = segmentation.relations(spark.createDataFrame(rows, "scan long, id long, cx double, cy double, cz double, hx double, hy double, hz double"), 10.0).filter("kind = 'contact'").collect()
    sign = np.array([[1 if k >> b & 1 else -1 for b in range(3)] for k in range(8)])
    corner = {r[1]: np.array(r[2:5]) + sign * np.array(r[5:8]) for r in rows}
    assert len(got) == 21
    for r in got:
        assert r.value == pytest.approx(np.linalg.norm(corner[r["from"]][:, None] - corner[r.to][None], axis=2).min())


def test_clipping_keeps_the_area_inside(spark):
    rng = np.random.default_rng(21)
    tri = rng.uniform(-1, 1, (30, 3, 3))
    t = spark.createDataFrame([(0, i, *map(float, f.ravel())) for i, f in enumerate(tri)], "mesh_id long, fid long, " + ", ".join(f"{k}{c} double" for k in "abc" for c in "xyz"))
    axes, half = V.rotation((0, 1, 0), 30)[:3, :3], np.array((0.6, 0.5, 0.7))
    pieces = mesh.clipped_faces(t, (0, 0, 0), axes, half).toPandas()
    c = pieces[[k + n for k in "abc" for n in "xyz"]].to_numpy().reshape(-1, 3, 3)
    assert (np.abs(c.reshape(-1, 3) @ axes.T) <= half + 1.1e-3).all()
    area = np.linalg.norm(np.cross(c[:, 1] - c[:, 0], c[:, 2] - c[:, 0]), axis=1) / 2
    u, w = rng.uniform(size=(2, 40_000))
    u, w = np.where(u + w > 1, 1 - u, u), np.where(u + w > 1, 1 - w, w)
    for i, (a, b, d) in enumerate(tri):
        if not (np.abs(np.array((a, b, d)) @ axes.T) <= half + 1e-3).all(1).any():
            continue  # faces without a corner inside go
        inside = (np.abs((a + u[:, None] * (b - a) + w[:, None] * (d - a)) @ axes.T) <= half).all(1).mean()
        assert area[pieces.fid == i].sum() == pytest.approx(inside * np.linalg.norm(np.cross(b - a, d - a)) / 2, abs=0.02)


def test_chain_faults_name_place_and_kind(spark):
    seals = spark.createDataFrame([("b", 0, "h0", None), ("b", 1, "h1", "h0"), ("b", 3, "h3", "hX"), ("c", 0, "k0", "k9")], "bundle_id string, n int, seal_hash string, prev_hash string")
    declared = spark.createDataFrame([("b", "a.ply", "1"), ("b", "b.ply", "2")], "bundle_id string, relative_path string, sha256 string")
    found = spark.createDataFrame([("b", "b.ply", "3"), ("b", "c.ply", "4")], "bundle_id string, relative_path string, sha256 string")
    got = {tuple(r) for r in custody.chain_faults(seals, declared, found, "bundle_id", "n").collect()}
    assert got == {("b", "link", "3"), ("b", "index", "3"), ("c", "link", "0"), ("b", "missing", "a.ply"), ("b", "changed", "b.ply"), ("b", "undeclared", "c.ply")}


# ------------------------------------------- repairs and fits that run in rounds


def test_two_cells_far_apart_have_no_holes(spark):
    import time

    cells = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 10_000, 10_000, 2.0), ("a", 5_000, 5, 1.0), ("a", 5_000, 9_999, 1.0)], "flag string, i long, j long, up double")
    began = time.time()
    assert volume.filled_holes(cells, "up", "flag").count() == 4
    assert time.time() - began < 60
    ring = [("a", i, j, 1.0) for i in (0, 3000) for j in (0, 1, 2)] + [("a", i, j, 1.0) for i in range(1, 3000) for j in (0, 2)]
    got = volume.filled_holes(spark.createDataFrame(ring, "flag string, i long, j long, up double"), "up", "flag")
    assert got.filter("filled").count() == 2999 and got.filter("up <> 1").count() == 0


def sequential_manifold(v, f):
    place = {r[1]: np.array(r[2:5]) for r in v}
    normal = {}
    for _, fid, a, b, c in f:
        n = np.cross(place[b] - place[a], place[c] - place[a])
        normal[fid] = n / max(np.linalg.norm(n), 1e-12)
    edges, live = {}, {r[1] for r in f}
    for _, fid, a, b, c in sorted(f):
        for x, y in ((a, b), (b, c), (c, a)):
            edges.setdefault((min(x, y), max(x, y)), []).append(fid)
    for e in sorted(edges):
        own = [i for i in edges[e] if i in live]
        if len(own) > 2:
            _, i, j = min((-round(abs(float(normal[i] @ normal[j])), mesh.DIGITS), i, j) for k, i in enumerate(own) for j in own[k + 1 :])
            live -= set(own) - {i, j}
    return live


@pytest.mark.parametrize("seed", range(3))
def test_manifold_rounds_equal_one_after_another(spark, seed):
    rng = np.random.default_rng(seed)
    n = (8, 12, 40)[seed]
    v = [(7, i, *map(float, rng.standard_normal(3))) for i in range(n)]
    tri = {tuple(sorted(map(int, rng.choice(n, 3, replace=False)))) for _ in range(6 * n)}
    f = [(7, k, *t) for k, t in enumerate(sorted(tri))]
    got = mesh.manifold_faces(spark.createDataFrame(v, "mesh_id long, vid long, x double, y double, z double"), spark.createDataFrame(f, "mesh_id long, fid long, a long, b long, c long"))
    want = sequential_manifold(v, f)
    assert {r.fid for r in got.collect()} == want and len(want) < len(f)


CUBE = [(0, 2, 1), (1, 2, 3), (4, 5, 6), (5, 7, 6), (0, 1, 4), (1, 5, 4), (2, 6, 3), (3, 6, 7), (0, 4, 2), (2, 4, 6), (1, 3, 5), (3, 7, 5)]


def cubes(spark, many):
    """many: of each mesh its faces (fid, a, b, c)."""
    v = [(m, k, float(k & 1), float(k >> 1 & 1), float(k >> 2)) for m in many for k in range(8)]
    f = [(m, *x) for m, fs in many.items() for x in fs]
    return spark.createDataFrame(v, "mesh_id long, vid long, x double, y double, z double"), spark.createDataFrame(f, "mesh_id long, fid long, a long, b long, c long")


def test_faces_wound_unlike_make_no_rim(spark):
    turned = lambda *which: [(i, a, c, b) if i in which else (i, a, b, c) for i, (a, b, c) in enumerate(CUBE)]
    whole = {1: turned(), 2: turned(5), 3: turned(0, 7, 11)}
    assert mesh.closed_meshes(*cubes(spark, whole)).count() == 0
    assert mesh.closed(*cubes(spark, whole))[1].count() == 36
    # Holes beside a turned face, two holes that touch in a corner, and one in a well-wound cube.
    without = {4: [x for x in turned(1) if x[0] != 0], 5: [x for x in turned() if x[0] not in (0, 5)], 6: [x for x in turned() if x[0] > 1]}
    v, f = mesh.closed(*cubes(spark, without))
    shut = {r.mesh_id: r for r in mesh.watertightness(v, f).collect()}
    assert all(r.is_closed and r.euler == 2 for r in shut.values()) and len(shut) == 3
    assert {r.mesh_id: round(r.volume, 9) for r in mesh.closed_volume(mesh.triangles(v, f)).collect()}[6] == pytest.approx(mesh.closed_volume(mesh.triangles(*cubes(spark, {6: turned()}))).first().volume)


def test_merge_moves_and_thins_parts(spark):
    rng = np.random.default_rng(3)
    v, f, want_v, want_f = [], [], [], []
    quantum, stride = 0.25, 3
    m = {}
    for p in range(3):
        n = (10, 4, 7)[p]
        local = rng.integers(0, 5, (n, 3)) * 0.25
        m[p] = np.array([[0.0, 0, 1, p], [0, 1, 0, 0.5], [-1, 0, 0, 0], [0, 0, 0, 1]])
        v += [(0, p, 5 + 2 * k, *map(float, q)) for k, q in enumerate(local)]
        tri = rng.integers(0, n, (6, 3)).tolist() if p < 2 else []
        f += [(0, p, k, *(5 + 2 * x for x in t)) for k, t in enumerate(tri)]
        if not tri:
            continue
        slot, seen = [], {tuple(np.round(q / quantum)): i for i, q in enumerate(want_v)}
        for k in range(0, n, stride):
            w = (m[p] @ np.append(local[k], 1))[:3]
            key = tuple(np.round(w / quantum))
            if key not in seen:
                seen[key] = len(want_v)
                want_v.append(w)
            slot.append(seen[key])
        want_f += [(p, k, *(slot[max(0, min(len(slot) - 1, (x + stride // 2) // stride))] for x in t)) for k, t in enumerate(tri)]
    f.append((0, 0, 99, 5, 7, 1000))  # a corner that is not there
    vs = spark.createDataFrame(v, "mesh_id long, part_id long, vid long, x double, y double, z double")
    fs = spark.createDataFrame(f, "mesh_id long, part_id long, fid long, a long, b long, c long")
    ts = spark.createDataFrame([(0, p, [float(x) for x in a.ravel()]) for p, a in m.items()], "mesh_id long, part_id long, m array<double>")
    gv, gf = mesh.merged(vs, fs, quantum, ts, stride)
    assert np.allclose([(r.x, r.y, r.z) for r in gv.orderBy("vid").collect()], want_v)
    assert sorted((r.part_id, r.fid, r.a, r.b, r.c) for r in gf.collect()) == sorted(want_f)
    assert mesh.sampling_stride(0.01, 1e-3) == 10 and mesh.sampling_stride(0, 1e-3) == 5 and mesh.sampling_stride(1, 0.1) == 1


@pytest.mark.parametrize("scoring", ["msac", "inliers"])
def test_ransac_equals_one_after_another(spark, scoring):
    rng = np.random.default_rng(8)
    flat = np.column_stack((rng.uniform(0, 3, 260), rng.normal(0, 0.004, 260), rng.uniform(0, 3, 260)))
    pts = np.vstack((flat, rng.uniform(0, 3, (140, 3))))
    n = np.tile((0.0, 1.0, 0.0), (400, 1))
    n[260:] = rng.standard_normal((140, 3))
    df = spark.createDataFrame([(i, *map(float, p), *map(float, q)) for i, (p, q) in enumerate(zip(pts, n, strict=True))], "id long, x double, y double, z double, nx double, ny double, nz double")
    options = {"constraint": "horizontal", "tilt": 10.0, "seed": 5}
    got = fit.ransac_plane(df, "id", 200, 0.02, 30, scoring=scoring, confidence=0.99, **options)
    best, share, until = None, min(0.999, 30 / 400), 200
    for hid, *h in fit.hypotheses(df, "id", 200, **options):
        if hid >= until:
            break
        d = np.abs((pts - h[:3]) @ np.array(h[3:]))
        inliers, msac = int((d <= 0.02).sum()), float(np.minimum(d * d, 0.0004).sum())
        value = (msac if scoring == "msac" else -inliers, hid)
        if best is None or value < best[0]:
            best = value, inliers, h
            share = max(share, inliers / 400)
            until = min(200, max(1, int(np.log1p(-0.99) / np.log1p(-(share**3)))))
    assert (got["hid"], got["inliers"], got["iterations"]) == (best[0][1], best[1], until) and until < 200
    assert abs(got["normal"][1]) > 0.999
    # Only points whose normals agree are drawn from.
    few = fit.hypotheses(df.withColumn("ny", F.when(F.col("id") < 3, F.col("ny")).otherwise(0.0)).withColumn("nx", F.when(F.col("id") < 3, 0.0).otherwise(1.0)).withColumn("nz", F.lit(0.0)), "id", 20, **options)
    assert {tuple(np.round(h[1:4], 9)) for h in few} <= {tuple(np.round(p, 9)) for p in pts[:3]}
    with pytest.raises(GeometryError):
        fit.ransac_plane(df, "id", scoring="other")
