"""Exports in two sections, records' statistics, cut meshes, and whole chains with signatures and roots."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravox.errors import VolumeError
from terravox.functions import canonical as C
from terravox.operators import custody, mesh, volume
from terravox.sources import records


def test_csv_of_both_sections(spark):
    m = spark.createDataFrame([(2, "length", 1.5, "m", 'a "b", c', True, None), (1, "area", 2.0, "m2", "x", False, 0.25)], "measurement_id long, kind string, value double, unit string, method string, is_inferred boolean, uncertainty double")
    s = spark.createDataFrame([(7, *[None] * 16)], ", ".join(f"{c} {'long' if c == 'specimen_id' else 'string'}" for c in records.SPECIMEN_COLUMNS.split(",")))
    lines = [r.line for r in records.csv_document(s, m, "specimen_id", "measurement_id").orderBy("section", "ord").collect()]
    assert lines == [records.SPECIMEN_COLUMNS, "7" + "," * 16, "", records.MEASUREMENT_COLUMNS, "1,area,2.0,m2,x,false,0.25", '2,length,1.5,m,"a ""b"", c",true,']
    assert records.csv_document(s, m.limit(0), "specimen_id", "measurement_id").count() == 2


def test_record_statistics(spark):
    rows = [("a", 1, -33.0, -70.0, 1.0, 5.0), ("a", 2, -33.1, -70.1, 2.0, 3.0), ("a", 3, -33.2, -70.2, 3.0, 30.0), ("b", 1, -33.0, -70.0, 1.0, 99.0)]
    got = {r.burst_id: r.geo for r in records.geo_statistics(spark.createDataFrame(rows, "burst_id string, ord long, latitude double, longitude double, altitude double, horizontal_accuracy double")).collect()}
    assert (got["a"].fixCount, got["a"].chosenFix.ord, got["b"].fixCount, got["b"].chosenFix, got["b"].meridianConvergence) == (3, 2, 1, None, 0.0)
    assert abs(got["a"].meridianConvergence) > 0.1
    plain = records.sidecar("ply", {"findingID": "f"})
    assert plain["capture"] == records.NO_CAPTURE and plain["geo"]["fixCount"] == 0 and plain["geo"]["quality"] == "unvalidated"
    full = records.sidecar("ply", {}, capture={"duration": 4, "anchorCount": 2}, geo=got["a"].asDict(True), device={"model": "m"})
    assert full["capture"]["duration"] == 4 and full["capture"]["thermalState"] == "nominal" and full["geo"]["fixCount"] == 3 and full["device"] == {"model": "m"}
    assert C.encode(full)


def test_iso_texts(spark):
    texts = ["2026-01-02T03:04:05.678Z", "2026-01-02T03:04:05Z", "2026-01-02 03:04:05Z", "2026-13-02T03:04:05Z", "", None]
    got = [r.t for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string").orderBy("i").select(F.unix_millis(C.parsed_iso(F.col("s"))).alias("t")).collect()]
    assert got == [1767323045678, 1767323045000, None, None, None, None]


def test_cut_pieces_are_welded(spark):
    rng = np.random.default_rng(2)
    v = [(0, i, *map(float, p)) for i, p in enumerate(rng.uniform(-1, 1, (30, 3)))]
    f = [(0, i, *map(int, rng.choice(30, 3, replace=False))) for i in range(40)]
    tri = mesh.triangles(spark.createDataFrame(v, "mesh_id long, vid long, x double, y double, z double"), spark.createDataFrame(f, "mesh_id long, fid long, a long, b long, c long"))
    pieces = mesh.clipped_faces(tri, (0, 0, 0), np.eye(3), (0.6, 0.6, 0.6)).cache()
    gv, gf = mesh.welded(pieces)
    rows = sorted(pieces.collect(), key=lambda r: (r.fid, r.piece))
    place, want = {}, []
    for r in rows:
        want.append(tuple(place.setdefault(tuple(r[k + c] + 0.0 for c in "xyz"), len(place)) for k in "abc"))
    assert {r.vid: (r.x, r.y, r.z) for r in gv.collect()} == {i: p for p, i in place.items()}
    assert [(r.a, r.b, r.c) for r in gf.orderBy("fid").collect()] == want and len(want) > 20


def test_support_plane_needs_points(spark):
    with pytest.raises(VolumeError):
        volume.support_plane(spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "vid long, x double, y double, z double"), "vid")


def test_whole_chains(spark):
    signer = custody.HmacSigner(b"k")
    files = lambda b: [(b, f"f{i}", i, hashlib.sha256(f"{b}{i}".encode()).hexdigest()) for i in range(3)]
    declared = [x for b in ("good", "forged", "root", "link", "file") for x in files(b)]
    root = {b: C.digest([{"relativePath": p, "bytes": n, "sha256": h} for _, p, n, h in files(b)]) for b in ("good", "forged", "root", "link", "file")}
    seals = []
    for b in root:
        own = root[b] if b != "root" else "0" * 64
        for i in (0, 1):
            sign = signer.sign(custody.payload(own, 1000 + i, "Ana")).hex()
            seals.append((b, i, f"{b}{i}", (f"{b}0" if b != "link" else "x") if i else None, own, 1000 + i, "Ana", sign if (b, i) != ("forged", 1) else "no hex"))
    found = [(b, p, h if (b, p) != ("file", "f1") else "0") for b, p, _, h in declared]
    got = custody.verified_chains(
        spark.createDataFrame(seals, "bundle_id string, index int, seal_hash string, prev_hash string, root_hash string, ms long, author string, signature string").repartition(3),
        spark.createDataFrame(declared, "bundle_id string, relative_path string, bytes long, sha256 string").repartition(3),
        spark.createDataFrame(found, "bundle_id string, relative_path string, sha256 string"),
        signer, "bundle_id", "index",
    )
    assert sorted(tuple(r) for r in got.collect()) == [("file", "changed", "f1"), ("forged", "signature", "1"), ("link", "link", "1"), ("root", "root hash", "1")]
