"""The store of findings: writers that commit, readers that plan, files by ranges and hashes in bounded memory."""

import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravox.errors import StoreError
from terravox.sources import bundles, meshfiles

ROWS = "finding_id string, scan_id string, kind string, item_id string, content binary"


def box(n):
    rng = np.random.default_rng(n)
    return meshfiles.ply_bytes(rng.random((n, 3)), rng.integers(0, n, (2 * n, 3)))


def some(spark, rows):
    return spark.createDataFrame([(*r[:4], bytearray(r[4])) for r in rows], ROWS).repartition(3)


def listed(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, fs in os.walk(root) for f in fs)


FIRST = [("a", None, "finding", None, b"{}"), ("a", "s1", "scan", None, b'{"scanID":"s1"}'), ("a", "s1", "mesh", None, box(50)), ("a", "s1", "measurements", None, b"[]"), ("a", "s1", "media", "m1", b"{}"), ("a", "s1", "specimen", "p1", box(3)), ("b", None, "finding", None, b"{}"), ("b", "s2", "scan", None, b"{}"), ("b", "s2", "mesh", None, box(9))]


def test_items_are_written_and_read(spark, tmp_path):
    root = str(tmp_path / "store")
    bundles.write_items(some(spark, FIRST), root)
    assert listed(root) == sorted(["FND-a/finding.json", "FND-a/scans/s1/scan.json", "FND-a/scans/s1/mesh.ply", "FND-a/scans/s1/measurements.json", "FND-a/scans/s1/media/m1.json", "FND-a/scans/s1/specimens/p1.ply", "FND-b/finding.json", "FND-b/scans/s2/scan.json", "FND-b/scans/s2/mesh.ply"])
    got = {(r.finding_id, r.scan_id, r.kind, r.item_id): bytes(r.content) for r in bundles.read_items(spark, root).collect()}
    assert got == {r[:4]: r[4] for r in FIRST}
    assert bundles.read_items(spark, str(tmp_path / "none")).count() == 0


def test_one_scan_reads_its_files_alone(spark, tmp_path):
    root = str(tmp_path / "store")
    bundles.write_items(some(spark, FIRST), root)
    one = bundles.read_items(spark, root).filter("finding_id = 'b' and scan_id = 's2' and kind = 'mesh'")
    assert [bytes(r.content) for r in one.collect()] == [box(9)]
    assert one.rdd.getNumPartitions() == 1
    reader = bundles.ItemReader({"path": root})
    left = list(reader.pushFilters([bundles.EqualTo(("finding_id",), "a"), bundles.In(("scan_id",), ("s1",)), bundles.EqualTo(("bytes",), 2)]))
    assert len(left) == 1 and reader.partitions() == [bundles.Findings(("a",))]
    os.remove(tmp_path / "store/FND-a/scans/s1/mesh.ply")
    assert {r[2] for r in reader.read(reader.partitions()[0])} == {"scan", "measurements", "media", "specimen"}


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    root = str(tmp_path / "store")
    bundles.write_items(some(spark, FIRST), root)
    before = listed(root)
    bad = some(spark, [("a", f"n{i}", "scan", None, b"{}") for i in range(20)]).withColumn("content", F.when(F.col("scan_id") == "n7", F.raise_error(F.lit("no content")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="no content"):
        bundles.write_items(bad, root)
    for rows, said in (
        ([("a", "s1", "media", "m2", b""), ("c", "s1", "media", "m2", b"")], "finding not found"),
        ([("a", "s9", "scan", None, b""), ("a", "s9", "scan", None, b"")], "written twice"),
        ([("a", "../x", "scan", None, b"")], "needs a name"),
        ([("a", "s9", "odd", None, b"")], "unknown kind"),
        ([("", "s9", "scan", None, b"")], "no finding"),
    ):
        with pytest.raises(Exception, match=said):
            bundles.write_items(some(spark, rows), root)
    assert listed(root) == before


def test_seals(spark, tmp_path):
    root = str(tmp_path / "store")
    bundles.write_items(some(spark, FIRST), root)
    seal = lambda f, i: (f, None, "seal", str(i), f'{{"index":{i}}}'.encode())
    bundles.write_items(some(spark, [seal("a", 1), seal("a", 0), seal("b", 0)]), root)
    bundles.write_items(some(spark, [seal("a", 2), ("a", "s1", "sealed", None, b"1\n")]), root)
    assert (tmp_path / "store/FND-a/seals/chain.jsonl").read_bytes() == b'{"index":0}\n{"index":1}\n{"index":2}\n'
    before = listed(root)
    for rows, said in (([seal("a", 2)], "out of place"), ([seal("b", 2)], "out of place"), ([("a", "s1", "sealed", None, b"")], "sealed"), ([("a", "s1", "media", "late", b"")], "sealed")):
        with pytest.raises(Exception, match=said):
            bundles.write_items(some(spark, rows), root)
    assert listed(root) == before


def test_a_new_scan_is_moved_at_once(tmp_path, monkeypatch):
    """A commit's moves grow with the scans, not with their files; where a scan is there already, its new files are moved one by one."""
    from pyspark.sql import Row

    from terravox.sources import files

    moved, opened = [], files.opened

    class Counted:
        def __init__(self, store):
            self.store = store

        def __getattr__(self, name):
            if name == "move":
                return lambda a, b: (moved.append(b), self.store.move(a, b))
            return getattr(self.store, name)

    monkeypatch.setattr(files, "opened", lambda uri: (Counted(opened(uri)[0]), opened(uri)[1]))
    root = str(tmp_path / "store")
    rows = [Row(finding_id=f, scan_id=s, kind=k, item_id=i, content=c) for f, s, k, i, c in FIRST]
    writer = bundles.ItemWriter(root)
    writer.commit([writer.write(rows[:6]), writer.write(rows[6:])])
    assert len(moved) == 4 and len(listed(root)) == len(FIRST)
    writer = bundles.ItemWriter(root)
    writer.commit([writer.write([Row(finding_id="a", scan_id="s1", kind="media", item_id=f"n{i}", content=b"") for i in range(2)])])
    assert len(moved) == 6 and len(listed(root)) == len(FIRST) + 2


def test_store_query_in_a_new_process(sf_dir, tmp_path):
    """Sources are found also where nothing has been registered or made active before."""
    import subprocess
    import sys

    code = f"""
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.sql.warehouse.dir", "file://{tmp_path}/warehouse").getOrCreate()
for name in ("store_items_of_some", "store_rebuilt_index"):
    print("rows", entry.queries()[name](spark, "{sf_dir}").count())
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.stdout.count("rows") == 2, done.stderr[-2000:]


def test_small_items_are_written_by_all_tasks(spark, tmp_path):
    """What takes time is the number of files, so few bytes are not put into one task."""
    from terravox.sessions import own_session

    own = own_session(spark, {"spark.sql.shuffle.partitions": "7"})
    sc = spark.sparkContext
    sc.setJobGroup("store", "store")
    bundles.write_items(some(own, FIRST), str(tmp_path / "store"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    status = sc.statusTracker()
    stages = [status.getStageInfo(s) for j in status.getJobIdsForGroup("store") for s in status.getJobInfo(j).stageIds]
    assert 7 in {s.numTasks for s in stages if s}


def test_load_mesh(spark, tmp_path):
    root = str(tmp_path / "store")
    bundles.write_items(some(spark, FIRST), root)
    v, f = bundles.load_mesh(spark, root, "a", "s1", records=16)
    assert v.rdd.getNumPartitions() == 4 and f.rdd.getNumPartitions() == 7
    xyz, tri = meshfiles.ply_parts(box(50))
    assert [tuple(r) for r in v.orderBy("vid").collect()] == [(i, *map(float, p)) for i, p in enumerate(xyz)]
    assert [tuple(r) for r in f.orderBy("fid").collect()] == [(i, *map(int, t)) for i, t in enumerate(tri)]
    for finding, scan in (("a", "s2"), ("z", "s1")):
        with pytest.raises(StoreError, match="scan not found"):
            bundles.load_mesh(spark, root, finding, scan)
    path = tmp_path / "store/FND-b/scans/s2/mesh.ply"
    path.write_bytes(box(9)[:-1])
    with pytest.raises(StoreError, match="bundle corrupt"):
        bundles.load_mesh(spark, root, "b", "s2")


def test_large_file_from_parts(spark, tmp_path):
    rows = spark.range(0, 20_000, 1, 7).select(F.col("id").alias("place"), F.lpad(F.col("id").cast("string"), 8, "0").cast("binary").alias("content"))
    path = str(tmp_path / "out" / "whole.bin")
    rows = bundles.packed(rows.orderBy(F.rand(1)), lambda b: b"".join(b.column(1).to_pylist()))
    bundles.write_parts(rows, path, 160_000)
    assert open(path, "rb").read() == b"".join(b"%08d" % i for i in range(20_000))
    assert os.listdir(tmp_path / "out") == ["whole.bin"]
    with pytest.raises(Exception, match="bytes of"):
        bundles.write_parts(rows, str(tmp_path / "out" / "other.bin"), 1)
    assert os.listdir(tmp_path / "out") == ["whole.bin"]


# ------------------------------------------------------------------- hashes


def test_files_of_any_size_are_hashed(spark, tmp_path):
    from terravox.operators import custody

    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "é x.txt").write_bytes(b"abc")
    (tmp_path / "empty").write_bytes(b"")
    with open(tmp_path / "sparse", "wb") as f:
        f.truncate(3 << 30)  # longer than any binary value
    found = custody.files(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == 2
    zeros, sha = bytes(1 << 20), hashlib.sha256()
    for _ in range(3 << 10):
        sha.update(zeros)
    got = {r.relative_path: (r.bytes, r.sha256) for r in found.collect()}
    assert got == {"d/é x.txt": (3, hashlib.sha256(b"abc").hexdigest()), "empty": (0, hashlib.sha256(b"").hexdigest()), "sparse": (3 << 30, sha.hexdigest())}


# ------------------------------------------------------------------ streams


def line(i, **more):
    import json

    return json.dumps({"burst_id": "b", "ord": i, "latitude": -33.0, "longitude": -70.0, "horizontal_accuracy": 5.0, "ts": f"2026-01-01T00:00:{i % 60:02d}Z", **more}) + "\n"


def test_a_restarted_stream_gives_each_fix_once(spark, tmp_path):
    from terravox.sources import fixes

    logs, out = tmp_path / "logs", str(tmp_path / "out")
    (logs / "sub").mkdir(parents=True)

    def run():
        q = fixes.from_logs(spark, str(logs)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
        q.awaitTermination()
        return sorted(r.ord for r in spark.read.parquet(out).collect())

    (logs / "a.jsonl").write_text("".join(line(i) for i in range(5)) + line(5)[:-9])
    (logs / "sub" / "b.jsonl").write_text(line(10))
    assert run() == [0, 1, 2, 3, 4, 10]
    with open(logs / "a.jsonl", "a") as f:
        f.write(line(5)[-9:] + line(6))
    (logs / "c.jsonl").write_text(line(20))
    assert run() == [0, 1, 2, 3, 4, 5, 6, 10, 20]
    assert run() == [0, 1, 2, 3, 4, 5, 6, 10, 20]
    # A batch that was planned but not finished is planned again with the same ranges.
    reader = fixes.LogReader({"path": str(logs)}, None)
    end = reader.latestOffset()
    planned = reader.partitions({"a.jsonl": 0}, end)
    with open(logs / "a.jsonl", "a") as f:
        f.write(line(7))
    assert reader.partitions({"a.jsonl": 0}, end) == planned and reader.latestOffset() != end


def test_one_fix_by_hand(spark, tmp_path):
    from terravox.sources import fixes

    for _ in range(2):
        q = fixes.by_hand(spark, {"burst_id": "m", "latitude": -33.5, "source": "manual"}).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination()
    (r,) = spark.read.parquet(str(tmp_path / "out")).collect()
    assert (r.burst_id, r.latitude, r.source, r.longitude) == ("m", -33.5, "manual", None)


def test_lines_that_are_no_fixes(spark):
    from pyspark.sql.types import StructType

    from terravox.sources import fixes

    schema = StructType.fromDDL(fixes.FIX)
    assert fixes.parsed(b"{", schema) == fixes.parsed(b"[]", schema) == fixes.parsed(b'{"ord": "x"}', schema) == (None,) * 9
    assert fixes.parsed(b'{"ord": 3}', schema)[:3] == (None, 3, None)


# -------------------------------------------------------------- large files


def test_large_files_equal_those_of_one_task(spark, tmp_path):
    from terravox.errors import ExportError, MeshError
    from terravox.sources import large

    rng = np.random.default_rng(2)
    n, xyz = 5000, rng.random((5000, 3)).round(2)
    tri = rng.integers(0, n, (7000, 3))
    v = spark.createDataFrame([(int(i) * 3 + 1, *map(float, p)) for i, p in enumerate(xyz)], "vid long, x double, y double, z double").repartition(7)
    f = spark.createDataFrame([(int(i), *(int(k) * 3 + 1 for k in t)) for i, t in enumerate(tri)], "fid long, a long, b long, c long").repartition(5)
    path = lambda name: str(tmp_path / "out" / name)
    large.write_ply(v, f, path("m.ply"))
    assert open(path("m.ply"), "rb").read() == meshfiles.ply_bytes(xyz, tri)
    large.write_stl(v, f, path("m.stl"))
    assert open(path("m.stl"), "rb").read() == meshfiles.stl_bytes(xyz[tri])
    utm = {"easting": 350000.0, "northing": 6300000.0, "height": 500.0, "epsg": 32719}
    large.write_las(v, utm, path("m.las"))
    assert open(path("m.las"), "rb").read() == meshfiles.las_bytes(xyz, utm)
    back = large.read_las(spark, path("m.las"), records=1000)
    assert back.rdd.getNumPartitions() == -(-len(np.unique(xyz, axis=0)) // 1000)
    want = np.unique(xyz, axis=0) + [350000.0, 6300000.0, 500.0]
    assert np.abs(np.array(sorted(tuple(r) for r in back.select("x", "y", "z").collect())) - want).max() < 1.1e-3
    with pytest.raises(ExportError, match="without its vertex"):
        large.write_ply(v.filter("vid > 1"), f, path("bad.ply"))
    with pytest.raises(ExportError, match="empty mesh"):
        large.write_ply(v, f.limit(0), path("bad.ply"))
    with pytest.raises(ExportError, match="missing UTM"):
        large.write_las(v, None, path("bad.las"))
    (tmp_path / "short.las").write_bytes(open(path("m.las"), "rb").read()[:-1])
    with pytest.raises(MeshError):
        large.las_layout(*large.files.opened(str(tmp_path / "short.las")))
    assert sorted(os.listdir(tmp_path / "out")) == ["m.las", "m.ply", "m.stl"]


def test_las_header_and_records():
    import struct

    utm = {"easting": 10.5, "northing": 20.0, "height": -3.25, "epsg": 32719}
    xyz = np.array([[0.0, 0.0, 0.0], [1.2345, 2.0, 3.0], [0.0, 0.0, 0.0]])
    data = meshfiles.las_bytes(xyz, utm)
    begin = struct.unpack_from("<I", data, 96)[0]
    assert data[:4] == b"LASF" and data[24:26] == bytes([1, 4]) and data[104] == 2
    assert struct.unpack_from("<H", data, 94)[0] == 375 and struct.unpack_from("<H", data, 105)[0] == 26
    assert struct.unpack_from("<II", data, 107) == (2, 2) and struct.unpack_from("<Q", data, 247)[0] == 2
    assert struct.unpack_from("<6d", data, 131) == (0.001, 0.001, 0.001, 10.5, 20.0, -3.25)
    assert struct.unpack_from("<6d", data, 179) == (11.7345, 10.5, 22.0, 20.0, -0.25, -3.25)
    assert data[375 + 54 : begin] == meshfiles.wkt(32719).encode() + b"\0" and b"zone 19S" in data
    assert len(data) == begin + 2 * 26
    assert struct.unpack_from("<3i", data, begin) == (0, 0, 0) and struct.unpack_from("<3i", data, begin + 26) == (1234, 2000, 3000)
    assert data[begin + 14] == 9 and data[begin + 15 : begin + 26] == bytes(11)
    with pytest.raises(Exception, match="no points"):
        meshfiles.las_bytes(xyz[:0], utm)


def test_stl_records():
    import struct

    tri = np.array([[[0, 0, 0], [1, 0, 0], [0, 1, 0]], [[0, 0, 0], [0, 0, 0], [1, 1, 1]]], float)
    data = meshfiles.stl_bytes(tri)
    assert len(data) == 84 + 100 and struct.unpack_from("<I", data, 80)[0] == 2
    assert struct.unpack_from("<12fH", data, 84) == (0, 0, 1, 0, 0, 0, 1000, 0, 0, 0, 1000, 0, 0)
    assert struct.unpack_from("<3f", data, 134) == (0, 0, 0)
