"""One large mesh or cloud as one file, written and read by ranges of its fixed-width records.

Counts and bounds are aggregates, so the header is known before any record is
written; each task packs the records of a range of places, and the commit joins the
parts (see `bundles.write_parts`). No task holds the mesh.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from ..errors import ExportError, MeshError
from ..operators.mesh import dropped, numbered, scratch, triangles
from . import files, meshfiles
from .bundles import RECORDS, Range, head, packed, registered, write_parts


def _columns(batch: pa.RecordBatch, first: int, n: int) -> np.ndarray:
    return np.column_stack([batch.column(first + k).to_numpy() for k in range(n)])


def _faces(batch: pa.RecordBatch) -> bytes:
    out = np.zeros(batch.num_rows, meshfiles._FACE)
    out["n"], out["v"] = 3, _columns(batch, 1, 3)
    return out.tobytes()


def write_ply(vertices: DataFrame, faces: DataFrame, path: str) -> None:
    """One mesh, its vertices in order of vid and its faces in order of fid; an empty mesh and a face without its vertex are refused."""
    one = F.lit(0).cast("long").alias("mesh_id")
    v = scratch(numbered(vertices.select(one, F.col("vid").alias("old"), "x", "y", "z"), "old"), "vertices")
    corner = faces.select("fid", F.posexplode(F.array("a", "b", "c")).alias("k", "old")).join(v.select("old", "vid"), "old", "left")
    wide = corner.groupBy("fid").agg(*(F.max(F.when(F.col("k") == k, F.col("vid"))).alias(n) for k, n in enumerate("abc")))
    f = scratch(numbered(wide.select(one, F.col("fid").alias("old"), "a", "b", "c"), "old").withColumnRenamed("vid", "place"), "faces")
    nv, (nf, bad) = v.count(), f.agg(F.count("*"), F.count_if(F.greatest(*(F.col(c).isNull().cast("int") for c in "abc")) > 0)).first()
    if not nf:
        raise ExportError("empty mesh")
    if bad:
        raise ExportError("face without its vertex")
    top = meshfiles.ply_bytes(np.zeros((0, 3)), np.zeros((0, 3))).replace(b"vertex 0", b"vertex %d" % nv).replace(b"face 0", b"face %d" % nf)
    parts = head(v.sparkSession, top).unionByName(packed(v.select(F.col("vid").alias("place"), "x", "y", "z"), lambda b: _columns(b, 1, 3).astype("<f4").tobytes()))
    write_parts(parts.unionByName(packed(f.select((F.col("place") + nv).alias("place"), "a", "b", "c"), _faces)), path, len(top) + 12 * nv + 13 * nf)
    dropped(v)
    dropped(f)


def write_stl(vertices: DataFrame, faces: DataFrame, path: str) -> None:
    """One mesh as binary STL, its faces in order of fid."""
    one = F.lit(0).cast("long").alias("mesh_id")
    tri = triangles(vertices.withColumn("mesh_id", one), faces.withColumn("mesh_id", one))
    corners = [a + c for a in "abc" for c in "xyz"]
    f = scratch(numbered(tri.select("mesh_id", F.col("fid").alias("old"), *corners), "old").withColumnRenamed("vid", "place"), "faces")
    n = f.count()
    if not n:
        raise ExportError("empty mesh")
    top = meshfiles.stl_bytes(np.zeros((0, 3, 3)))[:80] + struct.pack("<I", n)
    pack = lambda b: meshfiles.stl_bytes(_columns(b, 1, 9).reshape(-1, 3, 3))[84:]
    write_parts(head(f.sparkSession, top).unionByName(packed(f.select("place", *corners), pack)), path, 84 + 50 * n)
    dropped(f)


def write_las(points: DataFrame, utm: dict | None, path: str, order: str = "vid") -> None:
    """One cloud about a UTM place: equal positions once, in the order of their first point."""
    at = meshfiles.las_place(utm)
    first = points.groupBy("x", "y", "z").agg(F.min(order).alias("old")).withColumn("mesh_id", F.lit(0).cast("long"))
    p = scratch(numbered(first, "old").withColumnRenamed("vid", "place"), "points")
    ends = p.agg(F.count("*").alias("n"), *(f(c).alias(f"{k}{c}") for c in "xyz" for k, f in (("lo", F.min), ("hi", F.max)))).first()
    lo, hi = (np.array([ends[k + c] if ends.n else -a for c, a in zip("xyz", at, strict=True)]) + at for k in ("lo", "hi"))
    top = meshfiles.las_head(ends.n, lo, hi, utm)
    pack = lambda b: meshfiles.las_records(_columns(b, 1, 3))
    write_parts(head(p.sparkSession, top).unionByName(packed(p.select("place", "x", "y", "z"), pack)), path, len(top) + meshfiles._LAS.itemsize * ends.n)
    dropped(p)


def las_layout(store, path: str) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Where the points begin, their number, scale and offset; MeshError where the file's size does not fit."""
    with store.open_input_file(path) as f:
        top = f.read(375)
    if len(top) < 375 or top[:4] != b"LASF" or top[104] != meshfiles.LAS_FORMAT:
        raise MeshError("not a LAS file of point format 2")
    begin, n = struct.unpack_from("<I", top, 96)[0], struct.unpack_from("<Q", top, 247)[0]
    if store.get_file_info(path).size != begin + meshfiles._LAS.itemsize * n:
        raise MeshError("LAS file has the wrong length")
    return begin, n, np.frombuffer(top, "<f8", 3, 131), np.frombuffer(top, "<f8", 3, 155)


class LasReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.records = options["path"], int(options.get("records", RECORDS))

    def partitions(self):
        begin, n, _, _ = las_layout(*files.opened(self.path))
        return [Range(begin + meshfiles._LAS.itemsize * i, i, min(self.records, n - i)) for i in range(0, n, self.records)] or [Range(0, 0, 0)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        store, path = files.opened(self.path)
        _, _, scale, offset = las_layout(store, path)
        with store.open_input_file(path) as f:
            f.seek(partition.offset)
            for i in range(0, partition.n, 1 << 16):
                n = min(1 << 16, partition.n - i)
                grid = np.frombuffer(f.read(meshfiles._LAS.itemsize * n), meshfiles._LAS)["xyz"]
                ids = np.arange(partition.first + i, partition.first + i + n)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, *grid.T.astype(np.int64), *(grid * scale + offset).T)], names=["pid", "gx", "gy", "gz", "x", "y", "z"])


class LasFile(DataSource):
    """format("terravox_las"), options path and records: a cloud by ranges of its points."""

    @classmethod
    def name(cls):
        return "terravox_las"

    def schema(self):
        return "pid long, gx long, gy long, gz long, x double, y double, z double"

    def reader(self, schema):
        return LasReader(self.options)


def read_las(spark: SparkSession, path: str, records: int = RECORDS) -> DataFrame:
    """pid, grid place and position of the points of one cloud, a task for each range of records."""
    return registered(spark, LasFile).read.format("terravox_las").option("path", path).option("records", records).load()
