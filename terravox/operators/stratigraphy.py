"""Thickness of strata between boundaries picked on a wall."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import StratigraphyError
from ..functions import vectors as V
from .fit import ortho_raster, ransac_plane


def boundary_groups(marks: DataFrame, by: tuple[str, ...] = ("profile_id",)) -> DataFrame:
    """Boundaries of two marks or more: centroid, count, first ordinal."""
    return marks.groupBy(*by, "boundary_id").agg(F.min("ord").alias("first"), F.count("*").alias("n"), *(F.avg(c).alias("c" + c) for c in "xyz")).filter("n > 1")


def down_dip(wall_normal, up=(0.0, 1.0, 0.0)) -> np.ndarray:
    """Unit direction down the wall."""
    n, u = np.array(wall_normal, float), np.array(up, float)
    d = -u + n * float(u @ n)
    return d / max(np.linalg.norm(d), 1e-12)


def thickness(groups: DataFrame, stratum_normal, wall_normal, by: tuple[str, ...] = ("profile_id",)) -> DataFrame:
    """True and apparent thickness between boundaries that follow one another along the stratum's normal."""
    n = np.array(stratum_normal, float)
    n = n / np.linalg.norm(n) * (1 if n[1] >= 0 else -1)
    slope = abs(float(down_dip(wall_normal) @ n))
    along = V.dot(V.p("c"), V.lit3(n))
    w = Window.partitionBy(*by).orderBy("t", "boundary_id")
    pairs = groups.withColumn("t", along).withColumn("upper", F.lead("boundary_id").over(w)).withColumn("t2", F.lead("t").over(w)).filter("upper is not null")
    true = F.abs(F.col("t2") - F.col("t"))
    return pairs.select(*by, F.col("boundary_id").alias("lower"), "upper", true.alias("true_thickness"), (true / slope if slope >= 1e-6 else true).alias("apparent_thickness"))


def uncertainty(marks: DataFrame, stratum_normal, per_metre: float, by: tuple[str, ...] = ("profile_id",)) -> DataFrame:
    """Scatter of the marks about their boundary's level, and with half a pixel the band of a thickness."""
    n = np.array(stratum_normal, float) / np.linalg.norm(stratum_normal)
    t = V.dot(V.p(), V.lit3(n))
    each = marks.groupBy(*by, "boundary_id").agg(F.count("*").alias("n"), F.var_pop(t).alias("v"))
    sigma = F.sqrt(F.sum(F.col("n") * F.col("v")) / F.sum("n"))
    pixel = 0.5 / max(per_metre, 1.0)
    return each.groupBy(*by).agg(sigma.alias("sigma_plane")).withColumn("band", F.sqrt(F.col("sigma_plane") * F.col("sigma_plane") + pixel * pixel))


def measure(marks: DataFrame, wall_normal, stratum_normal, per_metre: float = 500.0) -> DataFrame:
    groups = boundary_groups(marks)
    if groups.limit(2).count() < 2:
        raise StratigraphyError("fewer than two boundaries of two points")
    return thickness(groups, stratum_normal, wall_normal).join(uncertainty(marks, stratum_normal, per_metre), "profile_id")


def wall_profile(points: DataFrame, order: str, per_metre: float = 500.0, tilt: float = 15.0, **ransac) -> tuple[dict, DataFrame]:
    """The best near-vertical plane and the ortho picture on it."""
    plane = ransac_plane(points, order, constraint="vertical", tilt=tilt, **ransac)
    return plane, ortho_raster(points, plane["point"], plane["normal"], per_metre)
