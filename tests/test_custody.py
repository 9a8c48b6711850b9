import datetime

import pytest
from pyspark.sql import functions as F

from terravox.errors import CustodyError, ExportError
from terravox.functions.canonical import digest
from terravox.operators import custody, store
from terravox.sources import records
from terravox.streaming import gps


def test_seal_and_tamper():
    signer = custody.HmacSigner(b"k")
    found = {"a.txt": "1" * 64, "z.txt": "2" * 64}
    entries = lambda: [{"relativePath": p, "bytes": 1, "sha256": h} for p, h in found.items()]
    one = custody.seal(entries(), "Ana", 1000, None, signer)
    found["b.txt"] = "3" * 64
    two = custody.seal(entries(), "Ana", 2000, one, signer)
    assert custody.verify([one, two], found, signer, 2) == []
    assert custody.verify([two], found, signer) != []
    assert "changed a.txt" in custody.verify([one, two], found | {"a.txt": "9" * 64}, signer)
    assert "undeclared s.txt" in custody.verify([one, two], found | {"s.txt": "9" * 64}, signer)
    assert "expected 3 seals" in custody.verify([one, two], found, signer, 3)
    with pytest.raises(CustodyError):
        custody.verify([], found, signer)


def test_bundle_on_disk(spark, tmp_path):
    folder = records.write_finding(str(tmp_path), {"findingID": "F-1", "title": "x", "createdAt": "2026-01-01T00:00:00.000Z"})
    records.write_scan(folder, {"scanID": "S-1"})
    (tmp_path / "FND-broken").mkdir()
    (tmp_path / "FND-broken" / "finding.json").write_text("not json")
    rows = store.rebuilt_index(spark, str(tmp_path)).collect()
    assert [(r.findingID, r.scan_count) for r in rows] == [("F-1", 1)]
    found = custody.manifest(custody.files(spark, folder)).orderBy("relative_path").collect()
    assert [r.relative_path for r in found] == ["finding.json", "scans/S-1/scan.json"]
    entries = [{"relativePath": r.relative_path, "bytes": r.bytes, "sha256": r.sha256} for r in found]
    seal = custody.seal(entries, "Ana", 1, None, custody.HmacSigner(b"k"))
    records.append_seal(folder, seal)
    assert records.read_seals(folder) == [seal]
    frame = spark.createDataFrame([("b", r.relative_path, r.bytes, r.sha256) for r in found], "bundle_id string, relative_path string, bytes long, sha256 string")
    assert custody.root_hash(frame, "bundle_id").first().root_hash == digest(entries) == seal["rootHash"]
    records.mark_sealed(folder)
    with pytest.raises(ExportError):
        records.mark_sealed(folder)
    with pytest.raises(ExportError):
        records.write_scan(folder, {"scanID": "S-2"})


def test_root_hash_feeds_entries_one_by_one(spark):
    names = [f'{"dir/" * (i % 3)}fi"é{i}.txt' for i in range(25_000)]
    rows = [(None if i % 50 == 0 else f"b{int(i % 3 > 0)}", p, i, f"{i:064x}") for i, p in enumerate(names)]
    frame = spark.createDataFrame(rows, "bundle_id string, relative_path string, bytes long, sha256 string").repartition(5)
    got = custody.root_hash(frame, "bundle_id")
    assert "collect_list" not in got._jdf.queryExecution().toString()
    want = {}
    for b, p, n, h in rows:
        want.setdefault(b, []).append({"relativePath": p, "bytes": n, "sha256": h})
    want = {(b, digest(sorted(es, key=lambda e: e["relativePath"].encode())), len(es)) for b, es in want.items()}
    assert {tuple(r) for r in got.collect()} == want
    assert custody.root_hash(frame.filter("false"), "bundle_id").count() == 0


def test_streams(spark, tmp_path):
    now = datetime.datetime(2026, 1, 1)
    rows = [("b", i, -33.0, -70.0, 1.0, 5.0 if i % 2 else 50.0, 5.0, now + datetime.timedelta(seconds=i), "gps") for i in range(10)]
    spark.createDataFrame(rows, gps.FIX).write.json(str(tmp_path / "in"))
    q = gps.gate(gps.fixes(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("gate").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("gate").filter(F.col("accepted")).count() == 5


def test_seals_may_come_late(spark, tmp_path):
    """A seal waits for the one before it; what still waits when the watermark has passed is a broken link."""
    schema = "bundle_id string, index int, own string, previous string, ts timestamp"
    at = lambda minute: datetime.datetime(2026, 1, 1, 0, minute)
    batches = [[("b", 0, "h0", None, at(0)), ("b", 2, "h2", "h1", at(1)), ("c", 0, "k0", "x", at(0)), ("c", 2, "k2", "k1", at(1))], [("b", 1, "h1", "h0", at(2)), ("b", 3, "h3", "h9", at(40)), ("b", 1, "h1", "h0", at(3))]]
    folder = tmp_path / "in"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(folder))
        faults = gps.chain_faults(spark.readStream.schema(schema).json(str(folder)))
        q = faults.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(150)
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("bundle_id", "index", "link").collect())
    assert got == [("b", 0, "ok"), ("b", 1, "ok"), ("b", 1, "repeated"), ("b", 2, "ok"), ("b", 3, "broken"), ("c", 0, "broken"), ("c", 2, "broken")]
