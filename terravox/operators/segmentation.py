"""Segments of a mesh and the relations between their boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from .fit import segment_boxes
from .mesh import TOGETHER, face_normal, faces_within, labelled, scratch, triangles, without_plane


def dihedral_edges(tri: DataFrame, degrees: float = 45.0) -> DataFrame:
    """u, v: pairs of faces that share a vertex and whose planes meet at no more than the angle, once for each vertex that they share.

    The pairs are of faces around one vertex, so their number follows the mesh's valence.
    """
    import math

    n = V.normalized(face_normal())
    at = tri.select("mesh_id", "fid", F.explode(F.array("a", "b", "c")).alias("vid"), *(c.alias("n" + k) for c, k in zip(n, "xyz", strict=True)))
    other = at.select("mesh_id", "vid", F.col("fid").alias("fid2"), *(F.col("n" + k).alias("m" + k) for k in "xyz"))
    pairs = at.join(other, ["mesh_id", "vid"]).filter((F.col("fid") < F.col("fid2")) & (F.abs(V.dot(V.p("n"), V.p("m"))) >= math.cos(math.radians(degrees)) - 1e-12))
    return pairs.select(F.struct("mesh_id", "fid").alias("u"), F.struct("mesh_id", F.col("fid2").alias("fid")).alias("v"))


def face_components(tri: DataFrame, degrees: float = 45.0) -> DataFrame:
    """mesh_id, fid, component: faces joined over vertices with a flat enough angle."""
    tri = scratch(tri, "triangles")  # three readers
    near = dihedral_edges(tri, degrees).repartition("u.mesh_id", F.floor(F.col("u.fid") / TOGETHER))
    out = labelled(tri.select(F.struct("mesh_id", "fid").alias("node")), near)
    return out.select("node.mesh_id", "node.fid", F.col("component.fid").alias("component"))


def segments(vertices: DataFrame, faces: DataFrame, plane: tuple | None = None, roi=None, degrees: float = 45.0, least: int = 50) -> tuple[DataFrame, DataFrame]:
    """(segments: component with triangle_count and box, members: component, vid).

    ROI, then the support plane's removal, then components of faces, those under `least` corners dropped.
    """
    if roi is not None:
        faces = faces_within(faces, vertices.filter(roi))
    if plane is not None:
        vertices, faces = without_plane(vertices, faces, *plane)
    tri = triangles(vertices, faces)
    comp = face_components(tri, degrees)
    corner = tri.join(comp, ["mesh_id", "fid"]).select("mesh_id", "component", "fid", F.explode(F.array("a", "b", "c")).alias("vid"))
    size = corner.groupBy("mesh_id", "component").agg(F.count_distinct("fid").alias("triangle_count"), F.count("*").alias("n3")).filter(F.col("n3") >= least).drop("n3")
    members = corner.select("mesh_id", "component", "vid").distinct().join(size.select("mesh_id", "component"), ["mesh_id", "component"], "left_semi")
    named = members.join(vertices.select("mesh_id", "vid", "x", "y", "z"), ["mesh_id", "vid"]).withColumn("segment", F.concat_ws(":", "mesh_id", "component"))
    boxes = segment_boxes(named, "segment")
    return size.withColumn("segment", F.concat_ws(":", "mesh_id", "component")).join(boxes, "segment"), members


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def reboxed(members: DataFrame, vertices: DataFrame, by: str = "segment") -> DataFrame:
    """The box of each segment of members(by, mesh_id, vid), after its vertices have changed."""
    return segment_boxes(members.select(by, "mesh_id", "vid").distinct().join(vertices.select("mesh_id", "vid", "x", "y", "z"), ["mesh_id", "vid"]), by)


def corners(boxes: DataFrame) -> DataFrame:
    """boxes (id, cx..cz, hx..hz), level ones, with the array of their eight corners (x, y, z)."""
    at = lambda k: F.struct(*((F.col("c" + c) + (1.0 if k >> b & 1 else -1.0) * F.col("h" + c)).alias(c) for b, c in enumerate("xyz")))
    return boxes.withColumn("corners", F.array(*(at(k) for k in range(8))))


def relations(boxes: DataFrame, contact: float = 0.01) -> DataFrame:
    """from, to, kind, value for every two boxes (scan, id, cx.., hx..) of a scan: distance, azimuth, heightDelta, and contact where corners come closer than `contact`."""
    placed = corners(boxes)
    a = placed.select("scan", F.col("id").alias("from"), *(F.col("c" + c).alias("a" + c) for c in "xyz"), F.col("corners").alias("p"))
    b = placed.select("scan", F.col("id").alias("to"), *(F.col("c" + c).alias("b" + c) for c in "xyz"), F.col("corners").alias("q"))
    pair = a.join(b, "scan").filter(F.col("from") < F.col("to"))
    d = V.sub(V.p("b"), V.p("a"))
    # All 64 distances of two boxes' corners within one row.
    gap = F.array_min(F.flatten(F.transform("p", lambda m: F.transform("q", lambda n: V.length(tuple(m[c] - n[c] for c in "xyz"))))))
    wide = pair.withColumn("distance", V.length(d)).withColumn("azimuth", V.azimuth(d[0], d[2])).withColumn("heightDelta", d[1]).withColumn("gap", gap)
    long = wide.select("scan", "from", "to", "gap", F.expr("stack(4, 'distance', distance, 'azimuth', azimuth, 'heightDelta', heightDelta, 'contact', gap) as (kind, value)"))
    return long.filter((F.col("kind") != "contact") | (F.col("gap") < contact)).drop("gap")
