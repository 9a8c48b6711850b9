"""Text exports: CSV, GeoJSON, OBJ lines, record sidecars and the verification note."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ExportError
from ..functions import canonical as C

#: The two sections of the CSV export.
SPECIMEN_COLUMNS = "specimen_id,label,center_x_m,center_y_m,center_z_m,length_m,width_m,height_m,dim_x_m,dim_y_m,dim_z_m,exposed_volume_m3,estimated_volume_m3,volume_method,classification_hint,finding_id,expedition_code"
MEASUREMENT_COLUMNS = "measurement_id,kind,value,unit,method,is_inferred,uncertainty"


def csv_lines(rows: DataFrame, columns: str, section: int, order: str) -> DataFrame:
    """section, ord, line: rows as CSV text under their header; a null is an empty field."""
    names = columns.split(",")
    line = F.concat_ws(",", *(F.coalesce(C.csv_field(F.col(n)), F.lit("")) for n in names))
    head = rows.sparkSession.createDataFrame([(section, "", columns)], "section int, ord string, line string")
    return head.unionByName(rows.select(F.lit(section).alias("section"), F.concat(F.lit("1"), F.lpad(F.col(order).cast("string"), 19, "0")).alias("ord"), line.alias("line")))


def measurement_lines(rows: DataFrame, order: str) -> DataFrame:
    """The second section: an empty line, its header and rows(measurement_id, kind, value, unit, method, is_inferred, uncertainty); nothing if there are no rows."""
    top = rows.sparkSession.createDataFrame([(2, "", ""), (2, "0", MEASUREMENT_COLUMNS)], "section int, ord string, line string")
    some = rows.limit(1).select(F.lit(2).alias("section")).distinct()
    lines = csv_lines(rows.withColumn("is_inferred", F.col("is_inferred").cast("string")), MEASUREMENT_COLUMNS, 2, order).filter("ord <> ''")
    return top.join(some, "section", "left_semi").unionByName(lines)


def csv_document(specimens: DataFrame, measurements: DataFrame, specimen_order: str, measurement_order: str) -> DataFrame:
    """section, ord, line of both sections; the file's lines are in order of section and ord."""
    return csv_lines(specimens, SPECIMEN_COLUMNS, 1, specimen_order).unionByName(measurement_lines(measurements, measurement_order))


def geojson(rows: DataFrame, east: Column, north: Column, epsg: Column, properties: dict[str, Column]) -> DataFrame:
    """rows with `feature`: a GeoJSON point in projected coordinates, its text fields escaped. A row without a place fails the query."""
    point = F.struct(F.lit("Point").alias("type"), F.array(east, north).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*(c.alias(n) for n, c in properties.items())).alias("properties"))
    crs = F.struct(F.lit("name").alias("type"), F.struct(F.concat(F.lit("urn:ogc:def:crs:EPSG::"), epsg.cast("string")).alias("name")).alias("properties"))
    return rows.withColumn("feature", F.when(east.isNotNull() & north.isNotNull(), F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), crs.alias("crs"), F.array(feature).alias("features")))).otherwise(F.raise_error(F.lit("missing UTM coordinate")).cast("string")))


def obj_lines(vertices: DataFrame, faces: DataFrame, normals: DataFrame | None = None) -> DataFrame:
    """mesh_id, part, ord, line of each mesh: its name, vertices, normals (mesh_id, vid, nx, ny, nz) if given, and faces by 1-based place."""
    from pyspark.sql import Window

    at = vertices.withColumn("i", F.row_number().over(Window.partitionBy("mesh_id").orderBy("vid")))
    text = lambda kind, names: F.concat_ws(" ", F.lit(kind), *(F.col(c).cast("string") for c in names))
    name = vertices.select("mesh_id").distinct().select("mesh_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("ord"), F.concat(F.lit("o "), F.col("mesh_id").cast("string")).alias("line"))
    v = at.select("mesh_id", F.lit(1).alias("part"), F.col("i").cast("long").alias("ord"), text("v", "xyz").alias("line"))
    corner = faces.select("mesh_id", "fid", F.posexplode(F.array("a", "b", "c")).alias("k", "vid")).join(at.select("mesh_id", "vid", "i"), ["mesh_id", "vid"])
    form = (lambda x: F.concat_ws("//", x["i"].cast("string"), x["i"].cast("string"))) if normals is not None else (lambda x: x["i"].cast("string"))
    f = corner.groupBy("mesh_id", "fid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "i"))), form), " ").alias("t"))
    out = name.unionByName(v).unionByName(f.select("mesh_id", F.lit(3).alias("part"), F.col("fid").alias("ord"), F.concat(F.lit("f "), F.col("t")).alias("line")))
    if normals is None:
        return out
    n = at.select("mesh_id", "vid", "i").join(normals, ["mesh_id", "vid"])
    return out.unionByName(n.select("mesh_id", F.lit(2).alias("part"), F.col("i").cast("long").alias("ord"), text("vn", ("nx", "ny", "nz")).alias("line")))


#: The statistics of a record that was made without a capture or a place.
NO_CAPTURE = {"duration": 0, "anchorCount": 0, "coverageFraction": 0, "trackingEvents": [], "thermalState": "nominal", "depthConfidenceStats": {"lowFraction": 0, "mediumFraction": 0, "highFraction": 0}}
NO_PLACE = {"fixCount": 0, "meridianConvergence": 0, "yawMethod": "gps_track", "quality": "unvalidated"}


def geo_statistics(fixes: DataFrame, by: str = "burst_id") -> DataFrame:
    """by, geo: of each burst's fixes the statistics of its record as a struct: the number of all fixes, the most accurate accepted one and the convergence there."""
    from ..functions import geodesy as G
    from ..operators.positioning import gated

    fix = F.struct("horizontal_accuracy", "ord", "latitude", "longitude", "altitude")
    each = gated(fixes).groupBy(by).agg(F.count("*").alias("fixCount"), F.min(F.when(F.col("accepted"), fix)).alias("chosenFix"))
    turn = F.when(F.col("chosenFix").isNotNull(), G.convergence(F.col("chosenFix.latitude"), F.col("chosenFix.longitude"))).otherwise(0.0)
    return each.select(by, F.struct("fixCount", "chosenFix", turn.alias("meridianConvergence"), F.lit("gps_track").alias("yawMethod"), F.lit("unvalidated").alias("quality")).alias("geo"))


def sidecar(form: str, finding: dict, utm: dict | None = None, algorithms: dict[str, str] | None = None, measurements: list[dict] | None = None, custody: dict | None = None, device: dict | None = None, capture: dict | None = None, geo: dict | None = None) -> dict:
    """The record that goes beside an export; what is not known of capture and place has its fixed statistics."""
    return {"schemaVersion": 1, "format": form, "finding": finding, "utm": utm, "algorithms": algorithms or {}, "measurements": measurements or [], "custody": custody, "device": device, "capture": NO_CAPTURE | (capture or {}), "geo": NO_PLACE | {"utm": utm} | (geo or {})}


def write_file(data: bytes, path: str) -> str:
    """Puts data in place whole: a temporary file beside it, then one rename."""
    try:
        handle, temporary = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
        with os.fdopen(handle, "wb") as f:
            f.write(data)
        os.replace(temporary, path)
    except OSError as e:
        raise ExportError(f"cannot write {path}") from e
    return path


def write_export(data: bytes, path: str, record: dict) -> tuple[str, str]:
    """A driver-side sink for one small export: the file and its sidecar."""
    return write_file(data, path), write_file(C.encode(record), os.path.splitext(path)[0] + ".record.json")


def verification_note(title: str, root: str, seals: int) -> str:
    return f"Bundle: {title}\nSeals: {seals}\nRoot hash (SHA-256 of the canonical manifest): {root}\n\nHash every file but seals/, .sealed and this note, list path, bytes and hash by path,\nand compare with the last line of seals/chain.jsonl.\n"


def write_finding(root: str, finding: dict) -> str:
    """A finding's folder, by its whole id, with its manifest."""
    folder = os.path.join(root, f"FND-{finding['findingID']}")
    for d in ("scans", "seals", "exports"):
        os.makedirs(os.path.join(folder, d), exist_ok=True)
    write_file(C.encode(finding), os.path.join(folder, "finding.json"))
    return folder


def write_scan(folder: str, scan: dict) -> str:
    """A scan's folder inside its finding's; refused once that is sealed."""
    if is_sealed(folder):
        raise ExportError("finding is sealed")
    path = os.path.join(folder, "scans", scan["scanID"])
    for d in ("specimens", "media", "depth"):
        os.makedirs(os.path.join(path, d), exist_ok=True)
    write_file(C.encode(scan), os.path.join(path, "scan.json"))
    return path


def append_seal(folder: str, seal: dict) -> None:
    with open(os.path.join(folder, "seals", "chain.jsonl"), "ab") as f:
        f.write(C.encode(seal) + b"\n")


def read_seals(folder: str) -> list[dict]:
    with open(os.path.join(folder, "seals", "chain.jsonl"), encoding="utf-8") as f:
        return [json.loads(x) for x in f if x.strip()]


def mark_sealed(folder: str) -> None:
    path = os.path.join(folder, ".sealed")
    if os.path.exists(path):
        raise ExportError("already sealed")
    write_file(b"", path)


def is_sealed(folder: str) -> bool:
    return os.path.exists(os.path.join(folder, ".sealed"))
