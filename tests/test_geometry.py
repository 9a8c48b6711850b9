import numpy as np
import pytest
from pyspark.sql import functions as F

from terravox.errors import GeoError, GeometryError, MeshError, RegistrationError
from terravox.functions import canonical, geodesy
from terravox.functions import vectors as V
from terravox.operators import fit, mesh, positioning, registration, stratigraphy, volume
from terravox.sources import meshfiles


def sphere(spark, r=0.5, rings=24, segments=48, mesh_id=0):
    pts, faces = [(0.0, r, 0.0)], []
    for i in range(1, rings):
        t = np.pi * i / rings
        pts += [(r * np.sin(t) * np.cos(p), r * np.cos(t), r * np.sin(t) * np.sin(p)) for p in 2 * np.pi * np.arange(segments) / segments]
    pts.append((0.0, -r, 0.0))
    at = lambda i, j: 1 + (i - 1) * segments + j % segments
    for j in range(segments):
        faces.append((0, at(1, j + 1), at(1, j)))
        faces += [f for i in range(1, rings - 1) for f in ((at(i, j), at(i, j + 1), at(i + 1, j)), (at(i, j + 1), at(i + 1, j + 1), at(i + 1, j)))]
        faces.append((len(pts) - 1, at(rings - 1, j), at(rings - 1, j + 1)))
    v = spark.createDataFrame([(mesh_id, i, *map(float, p)) for i, p in enumerate(pts)], "mesh_id long, vid long, x double, y double, z double")
    f = spark.createDataFrame([(mesh_id, i, *map(int, f)) for i, f in enumerate(faces)], "mesh_id long, fid long, a long, b long, c long")
    return v, f


def test_sphere_is_closed_and_has_its_volume(spark):
    v, f = sphere(spark)
    w = mesh.watertightness(v, f).first()
    assert w.is_closed and w.euler == 2
    assert abs(mesh.closed_volume(mesh.triangles(v, f)).first().volume) == pytest.approx(4 / 3 * np.pi * 0.125, rel=0.01)


def test_open_hemisphere_closes(spark):
    v, f = sphere(spark)
    up = v.filter("y >= -0.001")
    half = mesh.faces_within(f, up)
    assert not mesh.watertightness(up, half).first().is_closed
    added = mesh.closed_meshes(up, half)
    v2 = up.unionByName(added.filter("kind = 'v'").select("mesh_id", F.col("id").alias("vid"), "x", "y", "z"))
    f2 = half.unionByName(added.filter("kind = 'f'").select("mesh_id", F.col("id").alias("fid"), "a", "b", "c"))
    w = mesh.watertightness(v2, f2).first()
    assert w.is_closed and w.euler == 2
    assert abs(mesh.closed_volume(mesh.triangles(v2, f2)).first().volume) == pytest.approx(2 / 3 * np.pi * 0.125, rel=0.01)


def test_cone_height_field(spark):
    n = 200
    x, z = np.meshgrid(np.linspace(-1, 1, n), np.linspace(-1, 1, n))
    y = np.maximum(0, 1 - np.hypot(x, z))
    pts = spark.createDataFrame([tuple(map(float, p)) for p in np.column_stack((x.ravel(), y.ravel(), z.ravel()))], "x double, y double, z double")
    got = volume.field_volume(volume.envelope(volume.heights(pts.filter("y > 0"), (0, 0, 0), (0, 1, 0), 0.02)), 0.02).first()
    assert got.positive == pytest.approx(np.pi / 3, rel=0.03)


def test_merge_and_components(spark):
    v = spark.createDataFrame([(0, 0, 0, 0.0, 0.0, 0.0), (0, 0, 1, 0.0004, 0.0, 0.0), (0, 0, 2, 1.0, 1.0, 1.0)], "mesh_id long, part_id long, vid long, x double, y double, z double")
    f = spark.createDataFrame([(0, 0, 0, 0, 1, 2)], "mesh_id long, part_id long, fid long, a long, b long, c long")
    assert mesh.merged(v, f)[0].count() == 2
    a, fa = sphere(spark, 0.3, 8, 12)
    b = a.withColumn("vid", F.col("vid") + 1000).withColumn("x", F.col("x") + 2)
    fb = fa.select("mesh_id", (F.col("fid") + 1000).alias("fid"), *((F.col(c) + 1000).alias(c) for c in "abc"))
    assert mesh.vertex_components(a.unionByName(b), fa.unionByName(fb)).select("component").distinct().count() == 2


def test_utm_control_points(spark):
    #: Published control points (lat, lon, easting, northing).
    known = [(-33.42536, -73.5, 639453.8321, 6300550.3071), (-27.0, -75.0, 500000.0, 7013564.7574), (-53.0, -68.0, 567109.4354, 4127261.7386), (-27.11667, -109.36667, 661896.4774, 6999590.3797)]
    df = spark.createDataFrame(known, "lat double, lon double, e double, n double")
    got = df.select("e", "n", *(c.alias(k) for k, c in geodesy.utm(F.col("lat"), F.col("lon")).items())).collect()
    for r in got:
        assert abs(r.e - r.easting) < 1e-3 and abs(r.n - r.northing) < 1e-3
    back = geodesy.refined(df.select("lat", "lon", *(c.alias(k) for k, c in geodesy.utm(F.col("lat"), F.col("lon")).items())).withColumnsRenamed({"lat": "lat0", "lon": "lon0"}), "easting", "northing", "zone", "is_north").collect()
    assert all(abs(r.lat - r.lat0) < 1e-8 and abs(r.lon - r.lon0) < 1e-8 for r in back)
    with pytest.raises(GeoError, match="unsupported zone"):
        geodesy.checked(spark.createDataFrame([(5.0, -125.0)], "latitude double, longitude double"))


def test_ransac_finds_the_wall(spark):
    rng = np.random.default_rng(1)
    floor = np.column_stack((rng.uniform(0, 4, 800), rng.normal(0, 0.003, 800), rng.uniform(0, 4, 800)))
    wall = np.column_stack((rng.normal(0, 0.003, 300), rng.uniform(0, 4, 300), rng.uniform(0, 4, 300)))
    pts = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(np.vstack((floor, wall)))], "id long, x double, y double, z double")
    got = fit.ransac_plane(pts, "id", 300, 0.01, constraint="vertical", tilt=5)
    assert abs(got["normal"][0]) > np.cos(np.radians(0.5))
    again = fit.ransac_plane(pts, "id", 300, 0.01, constraint="vertical", tilt=5)
    assert again == got


def test_colinear_points_are_refused(spark):
    line = spark.createDataFrame([(i, 1.0 * i, 2.0 * i, 3.0 * i) for i in range(50)], "id long, x double, y double, z double")
    assert fit.is_colinear(line, "id")
    with pytest.raises(GeometryError):
        fit.plane(line)


def test_icp_recovers_a_known_transform(spark):
    rng = np.random.default_rng(7)
    side = rng.uniform(-0.25, 0.25, (600, 2))
    pts, normals = [], []
    for axis in range(3):
        p = np.insert(side, axis, 0.25, 1)
        pts.append(p)
        normals.append(np.tile(np.eye(3)[axis], (len(p), 1)))
    p, n = np.vstack(pts), np.vstack(normals)
    target = spark.createDataFrame([(i, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(p, n, strict=True))], "tid long, x double, y double, z double, nx double, ny double, nz double")
    m = V.matrix((0.02, -0.01, 0.015)) @ V.rotation((1, 2, 3), 2)
    source = mesh.transformed(target.select(F.col("tid").alias("sid"), "x", "y", "z"), V.rigid_inverse(m))
    got = registration.icp(source, target, voxels=(0.1,), iterations=12)
    assert np.abs(got.transform - m).max() < 5e-3 and got.rmse < 2e-3
    flat = target.filter("nx = 1")
    with pytest.raises(RegistrationError):
        registration.icp(flat.select(F.col("tid").alias("sid"), "x", "y", "z"), flat, voxels=(0.1,), iterations=3)


def test_true_thickness_of_dipping_strata(spark):
    dip, direction = np.radians(25), np.radians(130)
    n = np.array((-np.sin(direction) * np.sin(dip), np.cos(dip), np.cos(direction) * np.sin(dip)))
    rows = []
    for b, at in (("top", 0.12), ("bottom", -0.12), ("mid", 0.0)):
        for k, x in enumerate(np.linspace(-0.6, 0.6, 5)):
            y = (at - n[0] * x) / n[1]
            rows.append((0, k, b, float(x), float(y), 0.0))
    marks = spark.createDataFrame(rows, "profile_id long, ord int, boundary_id string, x double, y double, z double")
    got = stratigraphy.measure(marks, (0, 0, 1), n).collect()
    assert len(got) == 2 and all(abs(r.true_thickness - 0.12) < 2e-3 for r in got)


def test_gps_gate_and_yaw(spark):
    rng = np.random.default_rng(42)
    yaw, rows, track = np.radians(47.3), [], []
    t = np.arange(120)
    x, y = 60 * np.abs((t / 30) % 2 - 1), t * 0.5
    e, n = np.cos(yaw) * x - np.sin(yaw) * y, np.sin(yaw) * x + np.cos(yaw) * y
    for i in range(120):
        rows.append((0, i, -33 + (n[i] + rng.normal(0, 1.5)) / 111320, -70 + (e[i] + rng.normal(0, 1.5)) / 111320 / np.cos(np.radians(33)), 0.0, 3.0, 3.0, 1000 + i))
        track.append((0, i, 1000 + i, float(x[i]), 0.0, float(-y[i])))
    f = spark.createDataFrame([tuple(float(v) if k in (2, 3) else v for k, v in enumerate(r)) for r in rows], "burst_id long, ord int, latitude double, longitude double, altitude double, horizontal_accuracy double, vertical_accuracy double, s long").withColumn("ts", F.timestamp_seconds("s"))
    k = spark.createDataFrame(track, "burst_id long, ord int, s long, tx double, ty double, tz double").withColumn("ts", F.timestamp_seconds("s"))
    assert abs(np.degrees(positioning.yaw(k, f).first().yaw) - 47.3) < 2
    assert positioning.verdicts(f.withColumn("horizontal_accuracy", F.lit(25.0))).count() == 0


def test_ply_round_trip_and_faults(spark):
    v, f = sphere(spark, rings=4, segments=6)
    data = meshfiles.encoded(v, f)
    v2, f2 = meshfiles.decoded_ply(data)
    assert v2.count() == v.count() and f2.count() == f.count()
    assert meshfiles.encoded(v2, f2).first().content == data.first().content
    for bad in (b"", b"ply\nend_header\n", bytes(data.first().content)[:-1]):
        with pytest.raises(MeshError):
            meshfiles.ply_parts(bad)


def test_canonical_json():
    assert canonical.encode({"b": -0.0, "a": [1, None, "x\n"], "c": None}) == b'{"a":[1,null,"x\\n"],"b":0.0}'
    with pytest.raises(Exception, match="finite"):
        canonical.encode({"a": float("nan")})
