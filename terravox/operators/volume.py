"""Volumes over signed height fields, closed meshes and cavities.

A height field is rows (i, j, h): a height over a cell of a plane's grid. Its
envelope keeps the highest non-negative and the lowest negative height of each
cell; volumes are sums over cells. One shuffle, by cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import VolumeError
from ..functions import vectors as V
from .mesh import dropped, labelled, scratch


def heights(points: DataFrame, point, normal, size: float, by: tuple[str, ...] = ()) -> DataFrame:
    """i, j, h of points over the plane's grid."""
    if size <= 0:
        raise VolumeError("cell size must be positive")
    u, v, h = V.local(V.p(), point, normal)
    return points.select(*by, V.cell(u, size).alias("i"), V.cell(v, size).alias("j"), h.alias("h"))


def raster_heights(tri: DataFrame, point, normal, size: float, by: tuple[str, ...] = (), most_cells: int = 1 << 20) -> DataFrame:
    """i, j, h at the centre of each cell that a face covers: cells of the face's bounds are exploded, then tested."""
    corner = {k: V.local(V.p(k), point, normal) for k in "abc"}
    flat = tri.select(*by, *(c.alias(k + n) for k in "abc" for c, n in zip(corner[k], "uvh", strict=True)))
    at = lambda n: [F.col(k + n) for k in "abc"]
    for n, lo, hi in (("u", "i0", "i1"), ("v", "j0", "j1")):
        flat = flat.withColumn(lo, V.cell(F.least(*at(n)), size)).withColumn(hi, V.cell(F.greatest(*at(n)), size))
    cells = (F.col("i1") - F.col("i0") + 1) * (F.col("j1") - F.col("j0") + 1)
    flat = flat.filter(F.when(cells <= most_cells, True).otherwise(F.raise_error(F.lit("a face covers too many cells")).cast("boolean")))
    out = flat.withColumn("i", F.explode(F.sequence("i0", "i1"))).withColumn("j", F.explode(F.sequence("j0", "j1")))
    u, v = (F.col("i") + 0.5) * size, (F.col("j") + 0.5) * size
    a, b, c = ((F.col(k + "u"), F.col(k + "v"), F.col(k + "h")) for k in "abc")
    h = V.plane_height(u, v, a, b, c)
    return out.filter(V.in_triangle(u, v, a, b, c)).select(*by, "i", "j", h.alias("h")).filter("h is not null")


def envelope(field: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """up and lo of each cell; null where the cell has no such height."""
    return field.groupBy(*by, "i", "j").agg(F.max(F.when(F.col("h") >= 0, F.col("h"))).alias("up"), F.min(F.when(F.col("h") < 0, F.col("h"))).alias("lo"))


def field_volume(cells: DataFrame, size: float, by: tuple[str, ...] = ()) -> DataFrame:
    """positive, negative, covered_area, filled_ratio, cells, uncertainty (as published) and uncertainty_m3."""
    area = float(size) ** 2
    box = (F.max("i") - F.min("i") + 1) * (F.max("j") - F.min("j") + 1)
    return cells.groupBy(*by).agg(
        (F.coalesce(F.sum("up"), F.lit(0.0)) * area).alias("positive"),
        F.abs(F.coalesce(F.sum("lo"), F.lit(0.0)) * area).alias("negative"),
        (F.count("*") * area).alias("covered_area"),
        (F.count("*") / box).alias("filled_ratio"),
        F.count("*").alias("cells"),
        (F.count("*") * (0.5 * size)).alias("uncertainty"),
        (F.count("*") * (0.5 * size * area)).alias("uncertainty_m3"),
    )


#: Fixed value: how many points of a prior scan give its support plane.
SUPPORT = 2000


def support_plane(prior: DataFrame, order: str, most: int = SUPPORT) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Mean and direction of least variance of the first points of a prior scan by `order`, through which its heights are taken."""
    from .fit import plane

    first = prior.orderBy(order).limit(most)
    if len(first.limit(3).collect()) < 3:
        raise VolumeError("the prior scan has too few points")
    found = plane(first)
    return tuple(map(float, found["point"])), tuple(map(float, found["normal"]))


def gaps(there: DataFrame, by: str) -> DataFrame:
    """by, i, j0, j1, open: the runs of empty cells between two filled ones of a row.

    A run is open if it lies in the first or last row, or if the row above or below has
    no cell at all or ends before the run does: then it reaches the border there.
    """
    from pyspark.sql import Window

    row = Window.partitionBy(by, "i").orderBy("j")
    runs = there.select(by, "i", "j", F.lag("j").over(row).alias("before")).filter("j - before > 1").select(by, "i", (F.col("before") + 1).alias("j0"), (F.col("j") - 1).alias("j1"))
    ends = there.groupBy(by, "i").agg(F.min("j").alias("from"), F.max("j").alias("to"))
    beside = runs
    for name, shift in (("up", 1), ("down", -1)):
        beside = beside.join(ends.select(by, (F.col("i") + shift).alias("i"), F.col("from").alias(name + "0"), F.col("to").alias(name + "1")), [by, "i"], "left")
    inside = [F.coalesce((F.col("j0") >= F.col(n + "0")) & (F.col("j1") <= F.col(n + "1")), F.lit(False)) for n in ("up", "down")]
    return beside.select(by, "i", "j0", "j1", (~(inside[0] & inside[1])).alias("open"))


def filled_holes(cells: DataFrame, value: str, by: str, sweeps: int = 400) -> DataFrame:
    """Interior holes of one envelope take the mean of their filled neighbours, sweep by sweep; what the border reaches stays empty.

    Only gaps within rows are rows here, never the cells of the bounds: a hole is made
    of gaps that overlap from row to row, of which none reaches the border. Of two
    rows' gaps each is joined to the last one of the other row that starts no later,
    as it overlaps no earlier one. Each hole is filled apart, from its rim. `sweeps` is the
    published bound; a cell that it leaves empty has a row without a value.
    """
    import numpy as np
    import pandas as pd
    from pyspark.sql import Window

    there = cells.filter(F.col(value).isNotNull()).select(by, "i", "j", F.col(value).alias("v"))
    runs = scratch(gaps(there, by), "gaps")
    node = F.struct(by, "i", "j0")
    pairs = runs.select(by, "j0", "j1", node.alias("node"), F.explode(F.array(F.struct(F.col("i").alias("pair"), F.lit(0).alias("side")), F.struct((F.col("i") - 1).alias("pair"), F.lit(1).alias("side")))).alias("e")).select("*", "e.*")
    order = Window.partitionBy(by, "pair").orderBy("j0", "side")
    last = lambda side: F.last(F.when(F.col("side") == side, F.struct("node", "j1")), True).over(order)
    met = pairs.withColumn("other", F.when(F.col("side") == 0, last(1)).otherwise(last(0))).filter(F.col("other.j1") >= F.col("j0"))
    # Two gaps that start together meet once: the second sees the first.
    hole = labelled(runs.select(node.alias("node")), met.select(F.col("node").alias("u"), F.col("other.node").alias("v")))
    named = runs.withColumn("node", node).join(hole, "node").select(by, "i", "j0", "j1", "open", "component")
    open_ = named.filter("open").select("component").distinct()
    shut = named.join(open_, "component", "left_anti")
    inner = scratch(shut.select(by, "component", "i", F.explode(F.sequence("j0", "j1")).alias("j")), "holes")
    dropped(runs)
    step = lambda pairs: F.explode(F.array(*(F.struct((F.col("i") + a).alias("i"), (F.col("j") + c).alias("j")) for a, c in pairs)))
    rim = inner.select(by, "component", step(((0, 1), (1, 0), (0, -1), (-1, 0))).alias("o")).select(by, "component", "o.i", "o.j").distinct().join(there, [by, "i", "j"])

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        todo = pdf[pdf.v.isna()]
        at = {k: n for n, k in enumerate(zip(pdf.i, pdf.j, strict=True))}
        v = np.append(pdf.v.to_numpy(float), np.nan)
        own = np.array([at[k] for k in zip(todo.i, todo.j, strict=True)])
        beside = np.array([[at.get((i + a, j + c), -1) for a, c in ((-1, 0), (1, 0), (0, -1), (0, 1))] for i, j in zip(todo.i, todo.j, strict=True)])
        for _ in range(sweeps):
            around = v[beside]
            n = (~np.isnan(around)).sum(1)
            now = np.isnan(v[own]) & (n > 0)
            if not now.any():
                break
            v[own[now]] = np.nansum(around[now], 1) / n[now]
        return pd.DataFrame({by: todo[by], "i": todo.i, "j": todo.j, value: v[own], "filled": ~np.isnan(v[own])})

    kind = dict(cells.dtypes)[by]
    both = inner.withColumn("v", F.lit(None).cast("double")).unionByName(rim.select(by, "component", "i", "j", "v"))
    filled = both.groupBy("component").applyInPandas(fill, f"{by} {kind}, i long, j long, {value} double, filled boolean")
    return there.select(by, "i", "j", F.col("v").alias(value), F.lit(False).alias("filled")).unionByName(filled.withColumn(value, F.nanvl(value, F.lit(None).cast("double"))))


# ------------------------------------------------------------------ cavities


def cavity_prior(prior: DataFrame, damaged: DataFrame, size: float) -> DataFrame:
    """Lost (positive) and gained (negative) volume of a damaged envelope against the prior one's upper side."""
    area = float(size) ** 2
    p, d = prior.filter("up is not null").select("i", "j", F.col("up").alias("p")), damaged.select("i", "j", F.coalesce("up", "lo", F.lit(0.0)).alias("d"), "lo")
    both = p.join(d, ["i", "j"], "left").select((F.col("p") - F.coalesce("d", F.lit(0.0))).alias("x"))
    below = d.filter("lo is not null").join(p, ["i", "j"], "left_anti").select((-F.col("lo")).alias("x"))
    x = F.col("x")
    return both.unionByName(below).agg((F.coalesce(F.sum(F.when(x > 0, x)), F.lit(0.0)) * area).alias("positive"), (F.coalesce(F.sum(F.when(x < 0, -x)), F.lit(0.0)) * area).alias("negative"), F.count("*").alias("cells"), F.lit(False).alias("is_inferred"))


def cavity_plane(damaged: DataFrame, size: float) -> DataFrame:
    """Volume under (positive) and over (negative) a rim plane; the level is inferred."""
    area = float(size) ** 2
    return damaged.agg((F.coalesce(F.sum(-F.col("lo")), F.lit(0.0)) * area).alias("positive"), (F.coalesce(F.sum("up"), F.lit(0.0)) * area).alias("negative"), F.count("*").alias("cells"), F.lit(size / 2).alias("uncertainty"), F.lit(True).alias("is_inferred"))


def cavity_quadric(points: DataFrame, quadric, size: float) -> DataFrame:
    """Volume under a quadric z = q(u, v) over the level grid, from the lowest point of each cell."""
    u, v, h = F.col("z"), F.col("x"), F.col("y")
    low = points.select(V.cell(u, size).alias("i"), V.cell(v, size).alias("j"), (h - V.quadric_height(quadric, u, v)).alias("d")).groupBy("i", "j").agg(F.min("d").alias("d"))
    area = float(size) ** 2
    return low.agg((F.coalesce(F.sum(F.when(F.col("d") < 0, -F.col("d"))), F.lit(0.0)) * area).alias("positive"), F.count("*").alias("cells"), F.lit(size / 2).alias("uncertainty"), F.lit(True).alias("is_inferred"))


def cavity_mirror(healthy: DataFrame, damaged: DataFrame, size: float) -> DataFrame:
    """Volume that the mirrored healthy side has over the damaged one; only what is missing counts."""
    area = float(size) ** 2
    h, d = healthy.select("i", "j", F.coalesce("up", "lo").alias("h")), damaged.select("i", "j", F.coalesce("up", "lo").alias("d"))
    x = F.greatest(F.col("h") - F.coalesce("d", F.lit(0.0)), F.lit(0.0))
    return h.join(d, ["i", "j"], "left").agg((F.coalesce(F.sum(x), F.lit(0.0)) * area).alias("positive"), F.count("*").alias("cells"), F.lit(True).alias("is_inferred"))


#: What a scan is for, and how its volume is taken.
ROUTES = {
    "baseline": "height_field",
    "postIntervention": "height_field",
    "monitoring": "height_field",
    "damageAssessment": "cavity",
    "rescueDocumentation": "closed_mesh",
    "specimenInventory": "closed_mesh",
    "stratigraphicProfile": "closed_mesh",
}


def route(purposes: DataFrame, column: str = "purpose") -> DataFrame:
    how = None
    for purpose, name in sorted(ROUTES.items()):
        test = F.col(column) == purpose
        how = F.when(test, name) if how is None else how.when(test, name)
    return purposes.withColumn("integrator", how.otherwise("none"))
