"""Mesh and point-cloud files: PLY both ways, STL, OBJ and LAS out.

A mesh is one file, so a file's bytes are made in one task from its rows; many
meshes are many tasks. Readers take Spark's own binaryFile rows, so any store
that Spark reads will do.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ExportError, MeshError
from ..functions.canonical import number_text
from ..operators.mesh import scratch, whole_meshes

_FACE = np.dtype([("n", "u1"), ("v", "<i4", 3)])
_STL = np.dtype([("n", "<f4", 3), ("v", "<f4", 9), ("attr", "<u2")])
_LAS = np.dtype([("xyz", "<i4", 3), ("intensity", "<u2"), ("returns", "u1"), ("klass", "u1"), ("angle", "i1"), ("user", "u1"), ("source", "<u2"), ("rgb", "<u2", 3)])


def ply_bytes(xyz: np.ndarray, tri: np.ndarray) -> bytes:
    """Little-endian PLY: float positions and triangle faces."""
    head = f"ply\nformat binary_little_endian 1.0\nelement vertex {len(xyz)}\nproperty float x\nproperty float y\nproperty float z\nelement face {len(tri)}\nproperty list uchar int vertex_indices\nend_header\n"
    f = np.zeros(len(tri), _FACE)
    f["n"], f["v"] = 3, tri
    return head.encode() + xyz.astype("<f4").tobytes() + f.tobytes()


def ply_parts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Positions and faces; MeshError for anything but a whole triangle mesh in this form."""
    end = data.find(b"end_header\n", 0, 4096)
    if not data.startswith(b"ply") or end < 0:
        raise MeshError("not a PLY file")
    lines = data[:end].decode("ascii", "replace").split("\n")
    count = {w[1]: int(w[2]) for w in (x.split() for x in lines) if len(w) == 3 and w[0] == "element"}
    if "format binary_little_endian 1.0" not in lines or not {"vertex", "face"} <= count.keys():
        raise MeshError("unsupported PLY header")
    body, nv, nf = data[end + 11 :], count["vertex"], count["face"]
    if len(body) != 12 * nv + 13 * nf:
        raise MeshError("PLY body has the wrong length")
    f = np.frombuffer(body, _FACE, nf, 12 * nv)
    if (f["n"] != 3).any():
        raise MeshError("PLY face is not a triangle")
    return np.frombuffer(body, "<f4", 3 * nv).reshape(-1, 3), f["v"]


def stl_bytes(tri: np.ndarray, scale: float = 1000.0) -> bytes:
    """Binary STL of (n, 3, 3) corners, metres to millimetres."""
    n = np.cross(tri[:, 1] - tri[:, 0], tri[:, 2] - tri[:, 0])
    size = np.linalg.norm(n, axis=1, keepdims=True)
    out = np.zeros(len(tri), _STL)
    out["n"], out["v"] = np.where(size > 1e-12, n / np.maximum(size, 1e-12), 0), (tri * scale).reshape(-1, 9)
    return b"terravox binary STL".ljust(80, b"\0") + struct.pack("<I", len(tri)) + out.tobytes()


def obj_text(name: str, xyz: np.ndarray, tri: np.ndarray, normals: np.ndarray | None = None) -> str:
    rows = [f"o {name}"] + ["v " + " ".join(number_text(c) for c in p) for p in xyz.tolist()]
    if normals is not None:
        rows += ["vn " + " ".join(number_text(c) for c in p) for p in normals.tolist()]
    form = "{0}//{0}" if normals is not None else "{0}"
    return "\n".join(rows + ["f " + " ".join(form.format(i + 1) for i in f) for f in tri.tolist()]) + "\n"


#: The coordinate systems of the three zones.
WKT_NAMES = {32718: ("WGS 84 / UTM zone 18S", -75), 32719: ("WGS 84 / UTM zone 19S", -69), 32712: ("WGS 84 / UTM zone 12S", -111)}


def wkt(epsg: int) -> str:
    if epsg not in WKT_NAMES:
        return 'LOCAL_CS["local",UNIT["metre",1]]'
    name, meridian = WKT_NAMES[epsg]
    return f'PROJCS["{name}",GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]],PROJECTION["Transverse_Mercator"],PARAMETER["latitude_of_origin",0],PARAMETER["central_meridian",{meridian}],PARAMETER["scale_factor",0.9996],PARAMETER["false_easting",500000],PARAMETER["false_northing",10000000],UNIT["metre",1],AUTHORITY["EPSG","{epsg}"]]'


#: The millimetre grid and the point format (positions and colour) of LAS files.
LAS_SCALE, LAS_FORMAT = 0.001, 2


def las_place(utm: dict | None) -> np.ndarray:
    if utm is None:
        raise ExportError("missing UTM coordinate")
    return np.array([utm["easting"], utm["northing"], utm.get("height", 0.0)])


def las_head(n: int, lo: np.ndarray, hi: np.ndarray, utm: dict, day: int = 1, year: int = 2000) -> bytes:
    """Header and projection record of n points within lo and hi, on a grid that starts at the UTM place."""
    if not n:
        raise ExportError("no points")
    record = wkt(utm["epsg"]).encode() + b"\0"
    vlr = struct.pack("<H16sHH32s", 0, b"LASF_Projection", 2112, len(record), b"OGC WKT CRS") + record
    legacy = n if n < 1 << 32 else 0
    head = struct.pack("<4sHHIHH8sBB32s32sHHHIIBHI5I", b"LASF", 0, 0x10, 0, 0, 0, b"\0" * 8, 1, 4, b"terravox", b"terravox", day, year, 375, 375 + len(vlr), 1, LAS_FORMAT, _LAS.itemsize, legacy, legacy, 0, 0, 0, 0)
    head += struct.pack("<12d", LAS_SCALE, LAS_SCALE, LAS_SCALE, *las_place(utm), hi[0], lo[0], hi[1], lo[1], hi[2], lo[2])
    return head + struct.pack("<QQIQ15Q", 0, 0, 0, n, n, *[0] * 14) + vlr


def las_records(xyz: np.ndarray) -> bytes:
    """Records of places about the UTM place, in whole millimetres towards it."""
    points = np.zeros(len(xyz), _LAS)
    points["xyz"] = np.trunc(np.round(xyz / LAS_SCALE, 6))
    points["returns"] = 0x09
    return points.tobytes()


def las_bytes(xyz: np.ndarray, utm: dict | None, day: int = 1, year: int = 2000) -> bytes:
    """LAS 1.4, point format 2, millimetre grid about the UTM place; equal positions once, in first order; a cloud without points is refused."""
    place = las_place(utm)
    _, first = np.unique(xyz, axis=0, return_index=True)
    p = xyz[np.sort(first)]
    lo, hi = (p.min(0) + place, p.max(0) + place) if len(p) else (place, place)
    return las_head(len(p), lo, hi, utm, day, year) + las_records(p)


def encoded(vertices: DataFrame, faces: DataFrame, form: str = "ply") -> DataFrame:
    """mesh_id, content: each mesh as a file of the form ply, stl or obj; an empty mesh is refused."""

    def file(r) -> bytes:
        if not len(r.fid):
            raise ExportError("empty mesh")
        xyz, vid = np.column_stack((r.x, r.y, r.z)), np.asarray(r.vid)
        corners = np.column_stack((r.a, r.b, r.c))
        tri = np.searchsorted(vid, corners)
        if (vid[np.minimum(tri, len(vid) - 1)] != corners).any():
            raise ExportError("face without its vertex")
        if form == "ply":
            return ply_bytes(xyz, tri)
        return stl_bytes(xyz[tri]) if form == "stl" else obj_text(str(r.mesh_id), xyz, tri).encode()

    def make(batches):
        for pdf in batches:
            rows = [(r.mesh_id, file(r)) for r in pdf.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["mesh_id", "content"])

    return whole_meshes(vertices, faces).mapInPandas(make, "mesh_id long, content binary")


def encoded_las(points: DataFrame, utm: dict, by: str = "mesh_id", order: str = "vid") -> DataFrame:
    """A LAS file for each cloud."""

    def make(batches):
        for pdf in batches:
            files = [las_bytes(np.column_stack([np.array(r[c], float) for c in "xyz"]), utm) for r in pdf[["x", "y", "z"]].to_dict("records")]
            yield pd.DataFrame({by: pdf[by], "content": files})

    whole = points.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, "x", "y", "z"))).alias("p"))
    return whole.select(by, *(F.col("p." + c).alias(c) for c in "xyz")).mapInPandas(make, f"{by} long, content binary")


#: Rows of decoded files that are handed on at once.
ROWS_AT_ONCE = 100_000


def decoded_ply(contents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of rows (mesh_id, content); each file is parsed once, into a written table."""

    def table(files: list[tuple]) -> pd.DataFrame:
        """Files (name, positions, faces) as rows, those of vertices first."""
        nv, nf = [len(xyz) for _, xyz, _ in files], [len(tri) for _, _, tri in files]
        names = np.array([name for name, _, _ in files])
        xyz = np.concatenate([xyz for _, xyz, _ in files] + [np.zeros((sum(nf), 3))], dtype=float)
        abc = np.concatenate([np.zeros((sum(nv), 3), "int64")] + [tri for _, _, tri in files], dtype="int64")
        columns = {c: xyz[:, k] for k, c in enumerate("xyz")} | {c: abc[:, k] for k, c in enumerate("abc")}
        return pd.DataFrame({"mesh_id": np.concatenate([np.repeat(names, nv), np.repeat(names, nf)]), "kind": np.repeat(["v", "f"], [sum(nv), sum(nf)]), "id": np.concatenate([np.arange(n) for n in nv + nf]), **columns})

    def parts(batches):
        for pdf in batches:
            files, n = [], 0
            for name, data in zip(pdf.mesh_id, pdf.content, strict=True):
                files.append((name, *ply_parts(data)))
                n += len(files[-1][1]) + len(files[-1][2])
                if n >= ROWS_AT_ONCE:
                    yield table(files)
                    files, n = [], 0
            if files:
                yield table(files)

    rows = scratch(contents.select("mesh_id", "content").mapInPandas(parts, "mesh_id long, kind string, id long, x double, y double, z double, a long, b long, c long"), "ply")
    return rows.filter("kind = 'v'").select("mesh_id", F.col("id").alias("vid"), "x", "y", "z"), rows.filter("kind = 'f'").select("mesh_id", F.col("id").alias("fid"), "a", "b", "c")


def read_ply(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of every PLY file under path; mesh_id is the number in its name."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.ply").load(path)
    return decoded_ply(found.select(F.regexp_extract("path", r"(\d+)[^/]*\.ply$", 1).cast("long").alias("mesh_id"), "content"))
