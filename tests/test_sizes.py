"""What keeps the registered queries whole on large tables."""

import re

import pytest

from terravox.plans import adapters, registry
from terravox.sessions import measured_session


def static_plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["export_obj_normals", "export_obj_lines", "plane_removal", "mesh_close", "mesh_fix_orientation", "mesh_decimate_faces", "mesh_merge_dedup", "mesh_merge_world_faces", "mesh_manifold_pass", "mesh_vertex_normals", "volume_closed_mesh"])
def test_no_guessed_broadcast(spark, sf_dir, name):
    """Sides made by exploding are not broadcast by the size of the files they come from."""
    assert "BroadcastHashJoin" not in static_plan(registry.QUERIES[name](spark, sf_dir))


def test_measured_session(spark, sf_dir, monkeypatch):
    before = spark.conf.getAll
    own = measured_session(spark, sf_dir)
    assert spark.conf.getAll == before
    assert own.conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr("terravox.sessions.EACH", 1 << 10)
    assert int(measured_session(spark, sf_dir).conf.get("spark.sql.shuffle.partitions")) > 100


def test_meshes_are_dealt(spark, sf_dir, monkeypatch):
    """More meshes are more tasks, and no mesh is in two."""
    monkeypatch.setattr(adapters, "MESHES_A_TASK", 30)
    n = spark.read.parquet(f"{sf_dir}/part.parquet").count()
    for df in (adapters.part_vertices(spark, sf_dir), adapters.part_faces(spark, sf_dir)):
        parts = df.select("mesh_id").rdd.mapPartitions(lambda rows: [{r.mesh_id for r in rows}]).collect()
        assert len(parts) == 1 + n // 30 and sum(map(len, parts)) == n == len(set.union(*parts))


@pytest.mark.parametrize("name", ["edge_multiplicity", "mesh_watertightness"])
def test_edges_are_counted_where_meshes_are_dealt(spark, sf_dir, monkeypatch, name):
    """Edges stay with their mesh: what is shuffled before they are counted is the parts' rows."""
    monkeypatch.setattr(adapters, "MESHES_A_TASK", 30)
    plan = static_plan(registry.QUERIES[name](spark, sf_dir))
    assert "REPARTITION_BY_NUM" in plan and not re.search(r"hashpartitioning\(mesh_id#\d+L?, lo#", plan)


def test_decoded_files_share_batches(spark, monkeypatch):
    """Files are handed on together, not a frame each, and equal what was encoded."""
    import pandas as pd

    from terravox.sources import meshfiles

    v = adapters.part_vertices(spark, "/root/testdata/sf0.001").filter("mesh_id < 40")
    f = adapters.part_faces(spark, "/root/testdata/sf0.001").filter("mesh_id < 40")
    rows = meshfiles.encoded(v, f).toPandas()
    decode = {}
    monkeypatch.setattr(meshfiles, "scratch", lambda df, label: df)

    class Contents:
        def select(self, *names):
            return self

        def mapInPandas(self, function, schema):
            decode["f"] = function
            return spark.createDataFrame([], schema)

    meshfiles.decoded_ply(Contents())
    made = list(decode["f"]([rows]))
    assert len(made) == 1
    got = pd.concat(made)
    want = f.toPandas().sort_values(["mesh_id", "fid"])
    mine = got[got.kind == "f"].sort_values(["mesh_id", "id"])
    assert mine[["mesh_id", "id", "a", "b", "c"]].to_numpy().tolist() == want[["mesh_id", "fid", "a", "b", "c"]].to_numpy().tolist()
    assert (got.kind == "v").sum() == 8 * len(rows)


@pytest.mark.parametrize("name", ["volume_closed_mesh", "mesh_vertex_normals"])
def test_dealt_meshes_stay(spark, sf_dir, monkeypatch, name):
    """Corners and vertices of dealt meshes are joined where they are: nothing but the parts' rows is shuffled."""
    monkeypatch.setattr(adapters, "MESHES_A_TASK", 30)
    assert not re.search(r"hashpartitioning\(mesh_id#\d+L?, [a-z]", static_plan(registry.QUERIES[name](spark, sf_dir)))


def test_components_without_rounds(spark, monkeypatch):
    """Components that lie together are joined where they are, those over several tasks by links of their centres."""
    from pyspark.sql import functions as F

    from terravox.operators import mesh

    node = lambda c: F.struct(F.lit(7).cast("long").alias("mesh_id"), c.cast("long").alias("vid"))
    n = spark.range(3000)
    nodes = n.select(node(F.col("id")).alias("node"))
    chains = n.filter("id % 10 < 9").select(node(F.col("id")).alias("u"), node(F.col("id") + 1).alias("v")).repartition(5)
    got = lambda edges: {r.node.vid: r.component.vid for r in mesh.labelled(nodes, edges).collect()}
    rounds = mesh.in_rounds
    monkeypatch.setattr(mesh, "in_rounds", lambda *_: pytest.fail("rounds"))
    assert got(chains) == {i: i // 10 * 10 for i in range(3000)}
    # An edge to what is no node joins nothing.
    stray = spark.createDataFrame([((7, 5), (7, -1)), ((7, 25), (7, -1))], chains.schema)
    assert got(chains.unionByName(stray)) == {i: i // 10 * 10 for i in range(3000)}
    monkeypatch.setattr(mesh, "in_rounds", rounds)
    monkeypatch.setattr(mesh, "TOGETHER", 64)
    assert got(chains) == {i: i // 10 * 10 for i in range(3000)}


def test_distances_are_bounded_by_corners(spark, sf_dir):
    """A point meets the faces that are as near as a corner in its cell, in the task that joined them; distances stay exact."""
    import numpy as np

    from terravox.functions import vectors as V
    from terravox.operators import mesh, registration

    v = adapters.soup_vertices(spark, "/root/testdata/sf0.01")
    tri = mesh.triangles(v, adapters.soup_faces(spark, "/root/testdata/sf0.01")).cache()
    points = v.filter("vid % 5 = 0").select("vid", "x", (v.y + 0.05).alias("y"), "z")
    r = {row.vid: row.r for row in registration.bounded_by_corners(points, tri, 1.0).collect()}
    assert sum(x < 0.2 for x in r.values()) > len(r) / 2
    df = registration.signed_distances(points, tri, 1.0)
    assert not re.search(r"SortMergeJoin \[fid", static_plan(df))
    rows = tri.toPandas()
    a, b, c = (rows[[k + n for n in "xyz"]].to_numpy() for k in "abc")
    got = {row.vid: row.d for row in df.collect()}
    for p in points.collect():
        d = V.triangle_distances(np.tile([p.x, p.y, p.z], (len(a), 1)), a, b, c)
        k = np.lexsort((rows.fid.to_numpy(), np.abs(d)))[0]
        assert got[p.vid] == pytest.approx(d[k] if abs(d[k]) <= 1 else 0.0, abs=1e-9)
        assert abs(d[k]) <= r[p.vid] or r[p.vid] == 1.0


def test_clusters_are_sought_when_asked_for(spark, sf_dir, monkeypatch):
    """Volumes of a change need no cluster; who asks for the clusters has them."""
    from terravox.operators import registration

    asked = []
    change = registration.change_clusters
    monkeypatch.setattr(registration, "change_clusters", lambda *a: asked.append(a) or change(*a))
    assert registry.QUERIES["diff_pipeline"](spark, sf_dir).count() == 1 and not asked
    d = adapters.soup_vertices(spark, sf_dir).selectExpr("vid", "x", "y", "z", "y / 10 as d")
    found = registration.Change(distances=d, threshold=0.02, size=2.0)
    assert found["clusters"].count() > 0 and len(asked) == 1
    with pytest.raises(KeyError):
        found["cluster"]


def test_site_frame_of_a_burst_in_a_supported_zone(spark, sf_dir, tmp_path):
    """Users far east have no UTM place here; the frame is that of the largest burst that has one."""
    from pyspark.sql import functions as F

    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    far = rows.withColumn("user_id", F.lit(5000).cast("long"))
    rows.unionByName(far).write.parquet(str(tmp_path / "events.parquet"))
    expected, got = (registry.QUERIES["geo_site_frame"](spark, d).collect() for d in (sf_dir, str(tmp_path)))
    assert got == expected and len(got) == 1


def test_yaw_works_track_points_out_once(spark, sf_dir):
    """One pass over the interpolated points, so that a task does not hold them sorted four times."""
    plan = static_plan(registry.QUERIES["geo_yaw"](spark, sf_dir))
    assert plan.count("Union") == 1


def test_trimmed_pairs_are_found_once(spark, sf_dir):
    """Trimming reads written pairs and does not join anew at each pass."""
    assert "Join" not in static_plan(registry.QUERIES["icp_correspondences_trimmed"](spark, sf_dir))
