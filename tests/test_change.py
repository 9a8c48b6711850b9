import numpy as np
import pytest
from pyspark.sql import functions as F

from terravox.errors import VolumeError
from terravox.functions import vectors as V
from terravox.operators import fit, mesh, registration, segmentation, volume
from terravox.plans import adapters


def closest(p, a, b, c):
    """Distance to a triangle by dense barycentric search."""
    u, v = np.meshgrid(np.linspace(0, 1, 161), np.linspace(0, 1, 161))
    keep = u + v <= 1 + 1e-12
    q = a + u[keep][:, None] * (b - a) + v[keep][:, None] * (c - a)
    return np.linalg.norm(q - p, axis=1).min()


def test_signed_distance_is_the_nearest_face(spark):
    rng = np.random.default_rng(2)
    tri, pts = rng.uniform(0, 2, (12, 3, 3)), rng.uniform(0, 2, (40, 3))
    t = spark.createDataFrame([(0, i, *map(float, f.ravel())) for i, f in enumerate(tri)], "mesh_id long, fid long, " + ", ".join(f"{k}{c} double" for k in "abc" for c in "xyz"))
    p = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(pts)], "vid long, x double, y double, z double")
    for r in registration.signed_distances(p, t, 0.6).collect():
        d = min(closest(pts[r.vid], *f) for f in tri)
        assert abs(r.d) == pytest.approx(d, abs=0.02) if d < 0.55 else r.d == 0 or d <= 0.62


def test_three_bumps_are_three_clusters(spark):
    x, z = np.meshgrid(np.linspace(-1, 1, 61), np.linspace(-1, 1, 61))
    y = sum(np.maximum(0, 0.1 * (1 - np.hypot(x - a, z - b) / 0.15)) for a, b in ((-0.5, -0.5), (0.5, 0.5), (-0.5, 0.5)))
    rows = [(i, *map(float, p), float(p[1])) for i, p in enumerate(np.column_stack((x.ravel(), y.ravel(), z.ravel())))]
    d = spark.createDataFrame(rows, "vid long, x double, y double, z double, d double")
    got = registration.change_clusters(d, registration.noise_floor(0.002), 0.05).collect()
    assert len(got) == 3 and {r.kind for r in got} == {"gained"}
    assert registration.change_clusters(d.withColumn("d", F.lit(0.001)), 0.02, 0.05).count() == 0


def test_roi_keeps_inside_vertices_of_dropped_faces(spark):
    v = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0), (0, 1, 2.0, 0.0, 0.0), (0, 2, 0.0, 2.0, 0.0)], "mesh_id long, vid long, x double, y double, z double")
    f = spark.createDataFrame([(0, 0, 0, 1, 2)], "mesh_id long, fid long, a long, b long, c long")
    box = {"centre": (0, 0, 0), "axes": np.eye(3), "half": (0.5, 0.5, 0.5)}
    kept, faces = mesh.roi(v, f, V.in_box(V.p(), **box))
    assert kept.count() == 1 and faces.count() == 0
    cut = mesh.clipped_faces(mesh.triangles(v, f), **box).toPandas()
    corners = cut[[a + c for a in "abc" for c in "xyz"]].to_numpy().reshape(-1, 3)
    assert len(cut) >= 1 and np.abs(corners).max() <= 0.5 + 1e-9


def test_overhang_needs_the_closed_mesh(spark):
    v, f = adapters.part_vertices(spark, "/root/testdata/sf0.001"), adapters.part_faces(spark, "/root/testdata/sf0.001")
    vol = mesh.closed_volume(mesh.triangles(v, f)).join(adapters.table(spark, "/root/testdata/sf0.001", "part").select(F.col("p_partkey").alias("mesh_id"), (8 * (0.1 + F.col("p_size") / 200) * (0.2 + (F.col("p_partkey") % 5) / 10) * 0.25).alias("true")), "mesh_id")
    assert vol.filter(F.abs("volume") > 0).filter(F.abs(F.abs(F.col("volume")) - F.col("true")) > 1e-9).count() == 0
    with pytest.raises(VolumeError):
        volume.heights(v, (0, 0, 0), (0, 1, 0), 0.0)


def test_box_fit_recovers_a_turned_box(spark):
    rng = np.random.default_rng(4)
    m = (V.rotation((0, 1, 0), 37) @ V.rotation((1, 0, 0), 12))[:3, :3]
    half = np.array((0.15, 0.10, 0.05))
    pts = np.vstack([rng.uniform(-1, 1, (4000, 3)), [[a, b, c] for a in (-1, 1) for b in (-1, 1) for c in (-1, 1)]]) * half @ m.T
    got = fit.boxes(spark.createDataFrame([(0, *map(float, p)) for p in pts], "label long, x double, y double, z double"), "label").first()
    assert np.allclose(sorted((got.hx, got.hy, got.hz)), sorted(half), atol=8e-3)


def test_segments_of_a_box_are_its_sides(spark):
    one = adapters.part_vertices(spark, "/root/testdata/sf0.001").filter("mesh_id = 1")
    faces = adapters.part_faces(spark, "/root/testdata/sf0.001").filter("mesh_id = 1")
    found, members = segmentation.segments(one, faces, least=6)
    assert found.count() == 6 and {r.triangle_count for r in found.collect()} == {2}
    assert members.count() == 24
    boxes = spark.createDataFrame([(0, 1, 0.0, 0.0, 0.0, 0.1, 0.1, 0.1), (0, 2, 0.19, 0.0, 0.0, 0.1, 0.1, 0.1)], "scan long, id long, cx double, cy double, cz double, hx double, hy double, hz double")
    kinds = {r.kind: r.value for r in segmentation.relations(boxes, 0.05).collect()}
    assert kinds["azimuth"] == pytest.approx(90) and kinds["contact"] == pytest.approx(0.01) and len(kinds) == 4


@pytest.mark.parametrize("crowd", [3, 40])
def test_nearest_in_crowded_cells(spark, monkeypatch, crowd):
    monkeypatch.setattr(registration, "CROWD", crowd)
    rng = np.random.default_rng(crowd)
    thick = np.concatenate((rng.normal(0.3, 1e-3, (300, 3)), rng.uniform(-3, 3, (200, 3)), rng.normal(-1.7, 0.05, (150, 3)), np.full((60, 3), 0.25), rng.uniform(0, 1, (80, 3)).round(1)))
    asked = np.concatenate((rng.uniform(-3.5, 3.5, (150, 3)), thick[::9] + rng.normal(0, 1e-3, (len(thick[::9]), 3)), [[50.0, 0, 0], [0.25, 0.25, 0.25]]))
    t = spark.createDataFrame([(i, *map(float, p), f"t{i}") for i, p in enumerate(thick)], "tid long, x double, y double, z double, name string").repartition(5)
    s = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(asked)], "sid long, x double, y double, z double").repartition(3)
    got = {r.sid: r for r in registration.nearest(s, t, 1.0).collect()}
    assert len(got) == len(asked)
    for i, p in enumerate(asked):
        near = np.flatnonzero((np.abs(np.floor(thick) - np.floor(p)) <= 1).all(1))
        d2 = ((thick[near] - p) ** 2).sum(1)
        want = min(zip(d2, near, strict=True), default=(None, None))
        assert got[i].tid == want[1]
        if want[1] is not None:
            assert got[i].d2 == pytest.approx(want[0], abs=1e-12) and got[i].t.name == f"t{want[1]}"
    plan = registration.descended(s, t, 1.0)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
