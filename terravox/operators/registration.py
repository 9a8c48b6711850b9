"""Nearest neighbours, point-to-plane ICP and change between two scans.

The nearest-neighbour join is a bucket join: the target's cell is exploded to
its 27 neighbours, joined by cell, and the least (distance, id) wins; where cells are
crowded they are halved until none is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import RegistrationError
from ..functions import vectors as V
from .mesh import dropped, labelled, scratch


def _cells(size: float) -> list:
    return [V.cell(F.col(c), size).alias("k" + c) for c in "xyz"]


#: Targets of one cell that may meet its sources all at once; halvings of a cell.
CROWD, DEPTH = 512, 24


def around(target: DataFrame, size: float) -> DataFrame:
    """tid and place (tx, ty, tz) of each target, once for each of the 27 cells around its own."""
    t = target.select("tid", *(F.col(c).alias("t" + c) for c in "xyz"), *_cells(size))
    for k in ("kx", "ky", "kz"):
        t = t.withColumn("o", F.explode(F.array(*(F.lit(i) for i in (-1, 0, 1))))).withColumn(k, F.col(k) + F.col("o")).drop("o")
    return t


def _first_nearest(batches):
    """Of rows (sid, tid, d2) each batch's least (d2, tid) of each sid, so that few rows are shuffled; a JVM aggregate over the pair would sort them all."""
    for batch in batches:
        sid, tid, d2 = (batch.column(k).to_numpy() for k in range(3))
        order = np.lexsort((tid, d2, sid))
        first = order[np.concatenate(([True], sid[order][1:] != sid[order][:-1]))] if len(order) else order
        yield pa.RecordBatch.from_arrays([pa.array(x[first]) for x in (sid, tid, d2)], names=["sid", "tid", "d2"])


def least(pairs: DataFrame) -> DataFrame:
    """sid, tid, d2: the least (d2, tid) of each sid, of pairs (sid, tid, d2) with whole-number ids."""
    few = pairs.select(F.col("sid").cast("long"), F.col("tid").cast("long"), "d2").mapInArrow(_first_nearest, "sid long, tid long, d2 double")
    return few.groupBy("sid").agg(F.min(F.struct("d2", "tid")).alias("m")).select("sid", "m.tid", "m.d2")


def nearest(source: DataFrame, target: DataFrame, size: float, exploded: DataFrame | None = None, within: float | None = None) -> DataFrame:
    """sid, tid, d2 (and the target's row in t): the nearest target within the 27 cells around each source point.

    source(sid, x, y, z), target(tid, x, y, z, ...). A source point without one has nulls.
    exploded: the target's places by cell, from `around`, for a target that is asked again
    and again and is thin. Else cells with more than CROWD targets are halved until
    none has (see `descended`), so that no cell's points all meet in one task.
    within: pairs at this distance or farther are no candidates.
    """
    if exploded is None and (target.groupBy(*_cells(size)).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) > CROWD:
        best = descended(source, target, size)
    else:
        s = source.select("sid", "x", "y", "z", *_cells(size))
        d = V.sub(V.p(), V.p("t"))
        met = s.join(around(target, size) if exploded is None else exploded, ["kx", "ky", "kz"]).select("sid", "tid", V.dot(d, d).alias("d2"))
        best = least(met if within is None else met.filter(F.col("d2") < within * within))
    found = source.select("sid", "x", "y", "z").join(best, "sid", "left")
    return found.join(target.select("tid", F.struct(*target.columns).alias("t")), "tid", "left").select("sid", "x", "y", "z", "tid", "d2", "t")


_KEY = ["kx", "ky", "kz"]


def descended(source: DataFrame, target: DataFrame, size: float) -> DataFrame:
    """sid, tid, d2 as `nearest` has them, by halving crowded cells.

    Each cell has a place of one of its targets, which bounds the distance from above,
    and its box bounds it from below. A source point starts with the 27 cells
    around it and goes down level by level into the eighths of crowded ones, leaving
    all cells that lie farther than the best bound. So it ends with few cells, none
    of which is crowded; only then do points meet points. Targets in one place
    count as their first. Each level is a written table.
    """
    cell = lambda level: [V.cell(F.col(c), size / 2**level).alias("k" + c) for c in "xyz"]
    left = scratch(target.groupBy("x", "y", "z").agg(F.min("tid").alias("tid")), "targets")
    levels, leaves = [], None
    for level in range(DEPTH + 1):
        keyed = left.select("tid", "x", "y", "z", *cell(level))
        cells = scratch(keyed.groupBy(*_KEY).agg(F.count("*").alias("n"), F.min(F.struct("tid", "x", "y", "z")).alias("rep")).select(*_KEY, (F.col("n") > (CROWD if level < DEPTH else 1 << 62)).alias("crowded"), F.col("rep.x").alias("rx"), F.col("rep.y").alias("ry"), F.col("rep.z").alias("rz")), "cells")
        levels.append(cells)
        split = keyed.join(cells.select(*_KEY, "crowded"), _KEY)
        own = split.filter("not crowded").select(F.lit(level).alias("level"), *_KEY, "tid", F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("z").alias("tz"))
        leaves = own if leaves is None else leaves.unionByName(own)
        if cells.filter("crowded").isEmpty():
            break
        left = scratch(split.filter("crowded").select("tid", "x", "y", "z"), "targets")

    def bounded(rows: DataFrame, level: int) -> DataFrame:
        step = size / 2**level
        gap = [F.greatest(F.lit(0.0), F.col("k" + c) * step - F.col(c), F.col(c) - (F.col("k" + c) + 1) * step) - 1e-6 * step for c in "xyz"]
        rep = [F.col(c) - F.col("r" + c) for c in "xyz"]
        return rows.select("sid", "x", "y", "z", F.lit(level).alias("level"), *_KEY, "crowded", sum((F.greatest(F.lit(0.0), g) ** 2 for g in gap), F.lit(0.0)).alias("low"), V.dot(rep, rep).alias("high"))

    def pruned(rows: DataFrame) -> DataFrame:
        return rows.withColumn("high", F.min("high").over(Window.partitionBy("sid"))).filter(F.col("low") <= F.col("high") * (1 + 1e-9))

    start = source.select("sid", "x", "y", "z", *cell(0))
    for k in _KEY:
        start = start.withColumn("o", F.explode(F.array(*(F.lit(i) for i in (-1, 0, 1))))).withColumn(k, F.col(k) + F.col("o")).drop("o")
    rows = scratch(pruned(bounded(start.join(levels[0], _KEY), 0)), "candidates")
    for level, cells in enumerate(levels[1:], 1):
        # A cell's eighths are those whose halved places are its own.
        eighths = cells.select("*", *(F.shiftright(k, 1).alias("u" + k) for k in _KEY))
        open_ = rows.filter("crowded").select("sid", "x", "y", "z", *(F.col(k).alias("u" + k) for k in _KEY))
        below = bounded(open_.join(eighths, ["u" + k for k in _KEY]), level)
        new = scratch(pruned(rows.filter("not crowded").unionByName(below)), "candidates")
        dropped(rows)
        rows = new
    d = [F.col(c) - F.col("t" + c) for c in "xyz"]
    met = rows.select("sid", "x", "y", "z", "level", *_KEY).join(leaves, ["level", *_KEY]).select("sid", "tid", V.dot(d, d).alias("d2"))
    return least(met)


#: Pairs that may be ranked in one task; bins of a step towards them.
RANKED, BINS = 10_000, 1024


def trimmed(pairs: DataFrame, cut: float = 0.25, least: int = 6) -> DataFrame:
    """The max(least, floor(n (1 - cut))) nearest pairs, ties by sid.

    Counts over a grid of distances narrow the span that holds the last pair taken,
    until few enough pairs lie in it to rank; the rest are taken by their distance alone.
    """
    n, lo, hi = pairs.agg(F.count("*"), F.min("d2"), F.max("d2")).first()
    keep = min(n, max(least, int(np.floor(n * (1 - cut)))))
    if n == 0 or keep == n:
        return pairs
    d2, below, inside = F.col("d2"), 0, n
    while inside > RANKED and lo + (hi - lo) / BINS > lo:
        width = (hi - lo) / BINS
        bins = pairs.filter(d2.between(lo, hi)).groupBy(F.least(F.floor((d2 - lo) / width), F.lit(BINS - 1)).alias("b")).count().collect()
        running, at = below, 0
        for at, count in sorted((r.b, r["count"]) for r in bins):
            running += count
            if running >= keep:
                break
        # A bin more on either side, as the bounds are rounded.
        span = (lo + max(0, at - 1) * width, min(hi, lo + (at + 2) * width))
        under, within = pairs.agg(F.count_if(d2 < span[0]), F.count_if(d2.between(*span))).first()
        if within == inside or not under < keep <= under + within:
            break
        (lo, hi), below, inside = span, under, within
    return pairs.filter(d2 < lo).unionByName(pairs.filter(d2.between(lo, hi)).orderBy("d2", "sid").limit(keep - below))


_J = ("jx", "jy", "jz", "ja", "jb", "jc")


def normal_equations(pairs: DataFrame) -> DataFrame:
    """One row: the 21 sums of JtJ, the 6 of Jtr, the squared residuals and n, of pairs (x..z, qx..qz, nx..nz)."""
    n = V.p("n")
    arm = V.cross(V.p(), n)
    r = V.dot(V.sub(V.p(), V.p("q")), n)
    rows = pairs.select(*(c.alias(k) for c, k in zip((*n, *arm), _J, strict=True)), r.alias("r"))
    return rows.agg(*(F.sum(F.col(_J[i]) * F.col(_J[k])).alias(f"h{i}{k}") for i in range(6) for k in range(i, 6)), *(F.sum(F.col(_J[i]) * F.col("r")).alias(f"g{i}") for i in range(6)), F.sum(F.col("r") * F.col("r")).alias("e2"), F.count("*").alias("n"))


@dataclass
class Alignment:
    transform: np.ndarray
    rmse: float  # over all source points with a target around them
    trimmed_rmse: float  # of the pairs that the transform was solved from
    iterations: int
    inlier_ratio: float
    condition: float
    heuristic: float


#: Least change of the RMSE, how much worse a turn may be, damping and its least, greatest turn (radians), points a level needs, cell of the final RMSE.
SETTLED, WORSE, DAMPING, LEAST_DAMPING, TURN, ENOUGH, FINAL_CELL = 1e-7, 1.1, 1e-3, 1e-8, 0.2, 10, 0.1


def moved_by(source: DataFrame, m: np.ndarray) -> DataFrame:
    """source moved by a rigid transform that is a row of its own: as literals its numbers would have each iteration's plan compiled anew."""
    m = np.array(m, float)
    m[:3, :3] /= np.maximum(np.linalg.norm(m[:3, :3], axis=0), 1e-12)
    row = source.sparkSession.createDataFrame([(m[:3].ravel().tolist(),)], "__m array<double>")
    at = lambda r, c: F.element_at("__m", 4 * r + c + 1)
    place = {k: sum((at(r, c) * F.col(n) for c, n in enumerate("xyz")), at(r, 3)) for r, k in enumerate("xyz")}
    return source.crossJoin(F.broadcast(row)).withColumns(place).drop("__m")


def matched(source: DataFrame, target: DataFrame, m: np.ndarray, cell: float, distance: float, cut: float, degrees: float, exploded: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The pairs that an iteration solves from: nearest, nearer than `distance`, trimmed, with normals that agree where the source has some; and the pairs that are kept in memory for it."""
    moved = moved_by(source, m)
    pairs = nearest(moved, target, cell, exploded, distance).filter(F.col("d2") < distance * distance)
    flat = trimmed(pairs.persist(), cut).select("sid", "x", "y", "z", *(F.col("t." + c).alias(n) for c, n in (("x", "qx"), ("y", "qy"), ("z", "qz"), ("nx", "nx"), ("ny", "ny"), ("nz", "nz"))))
    if "nx" in source.columns:
        turn = np.eye(4)
        turn[:3, :3] = m[:3, :3]
        own = source.select("sid", *(c.alias("s" + k) for c, k in zip(V.affine(turn, V.p("n")), "xyz", strict=True)))
        flat = flat.join(own, "sid").filter(F.abs(V.dot(V.p("n"), V.p("s"))) >= float(np.cos(np.radians(degrees)))).drop("sx", "sy", "sz")
    return flat, pairs


def final_rmse(source: DataFrame, target: DataFrame, m: np.ndarray) -> float:
    """Over all source points, moved, that have a target point in the cells around them."""
    moved = source.withColumns(dict(zip("xyz", V.rigid(m, V.p()), strict=True)))
    got = nearest(moved, target, FINAL_CELL).agg(F.avg("d2")).first()[0]
    return float("inf") if got is None else float(np.sqrt(got))


def icp(source: DataFrame, target: DataFrame, initial: np.ndarray | None = None, voxels=(0.2, 0.1, 0.05), iterations: int = 50, cut: float = 0.25, degenerate_over: float = 1e6, distance: float = 0.1, degrees: float = 45.0, stable=None) -> Alignment:
    """Point-to-plane ICP of source(sid, x, y, z[, nx, ny, nz]) onto target(tid, x, y, z, nx, ny, nz).

    A level of the pyramid keeps one point of each voxel; an iteration is one
    aggregate that brings 29 numbers to the driver, which solves 6x6 and steps.
    stable: a condition on target points that have not changed; one that none or all
    meet has no effect. Each level starts from the best transform of the one before.
    """
    m = np.eye(4) if initial is None else np.array(initial, float)
    if stable is not None:
        of, some = target.agg(F.count("*"), F.count_if(stable)).first()
        target = target.filter(stable) if 0 < some < of else target
    spent, best = 0, None
    for size in voxels:
        keys = [V.cell(F.col(c), size).alias("k" + c) for c in "xyz"]
        pick = lambda df, i: df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), i).alias("p")).select("p.*")  # noqa: B023,E731
        # Few points meet many: they stay in as many tasks as a shuffle has, however little there is of them.
        s, t = pick(source, "sid").repartition(int(source.sparkSession.conf.get("spark.sql.shuffle.partitions")), "sid").cache(), pick(target, "tid").cache()
        # The target does not move: its cells are dealt once, and each iteration deals the source alone. A voxel has one point, so no cell is crowded.
        cells = around(t, 2 * size).repartition("kx", "ky", "kz").cache()
        n_all, last, level = s.count(), np.inf, None
        for turn in range(iterations if min(n_all, t.count()) >= ENOUGH else 0):
            flat, held = matched(s, t, m, 2 * size, distance, cut, degrees, cells)
            row = normal_equations(flat).first()
            held.unpersist()
            if not row.n or row.n < 6:
                if best is None and turn == 0:
                    raise RegistrationError("insufficient correspondences")
                break
            spent += 1
            h = np.zeros((6, 6))
            for i in range(6):
                for k in range(i, 6):
                    h[i, k] = h[k, i] = row[f"h{i}{k}"]
            g = np.array([row[f"g{i}"] for i in range(6)])
            rmse = float(np.sqrt(row.e2 / row.n))
            if level is None or rmse < level[0]:
                level = (rmse, m, row.n / max(1, n_all), np.linalg.cond(h), min(1e7, np.trace(h) ** 2 / max(abs(np.linalg.det(h)), 1e-300)))
            if abs(last - rmse) < SETTLED or rmse > last * WORSE:
                break
            last = rmse
            step = -np.linalg.solve(h + max(DAMPING * np.trace(h) / 6, LEAST_DAMPING) * np.eye(6), g)
            shift, turned = step[:3], step[3:]
            shift *= min(1.0, distance / 2 / max(np.linalg.norm(shift), 1e-12))
            turned *= min(1.0, TURN / max(np.linalg.norm(turned), 1e-12))
            move = np.eye(4)
            move[:3, :3], move[:3, 3] = V.small_rotation(turned), shift
            m = move @ m
        for held in (cells, s, t):
            held.unpersist()
        if level is not None:
            if level[3] > degenerate_over:
                raise RegistrationError("degenerate geometry")
            best, m = level, level[1]
    if best is None:
        raise RegistrationError("insufficient correspondences")
    return Alignment(best[1], final_rmse(source, target, best[1]), best[0], spent, best[2], float(best[3]), float(best[4]))


# -------------------------------------------------------------------- change


def _least_distances(batches):
    """Of rows (vid, fid, point, corners) each batch's nearest face of each point. The distance's expression is too large to be compiled, so it is taken for a batch at once."""
    for batch in batches:
        vid, fid = (batch.column(k).to_numpy() for k in (0, 1))
        at = np.column_stack([batch.column(k).to_numpy() for k in range(2, 14)])
        d = V.triangle_distances(at[:, :3], at[:, 3:6], at[:, 6:9], at[:, 9:])
        order = np.lexsort((fid, np.abs(d), vid))
        first = order[np.concatenate(([True], vid[order][1:] != vid[order][:-1]))] if len(order) else order
        yield pa.RecordBatch.from_arrays([pa.array(x[first]) for x in (vid, fid, d)], names=["vid", "fid", "d"])


#: Cells of a reach in which a point looks for a corner that bounds its distance, fine ones first.
FINER = (32, 16, 8, 4)
#: Tasks over which the points of one cell are dealt.
DEALS = 8


def bounded_by_corners(points: DataFrame, tri: DataFrame, reach: float) -> DataFrame:
    """vid, x, y, z, r: no nearest face within reach is farther than r, as a corner in the point's own cell of some size is that near."""
    corner = tri.select(F.explode(F.array(*(F.struct(*(F.col(k + c).alias(c) for c in "xyz")) for k in "abc"))).alias("p")).select("p.*")
    out = points.select("vid", "x", "y", "z", F.lit(float(reach)).alias("r"))
    for fine in FINER:
        rep = corner.groupBy(*_cells(reach / fine)).agg(F.min(F.struct("x", "y", "z")).alias("rep"))
        off = [F.col(c) - F.col("rep." + c) for c in "xyz"]
        out = out.select("*", *_cells(reach / fine)).join(rep, ["kx", "ky", "kz"], "left").select("vid", "x", "y", "z", F.least("r", V.length(off) * (1 + 1e-6)).alias("r"))
    return out


def signed_distances(points: DataFrame, tri: DataFrame, reach: float) -> DataFrame:
    """vid, d: exact signed distance to the nearest face within reach; 0 where there is none.

    A face lies in the grid of its own scale: cells of reach * 2**level that are no
    smaller than it, so its bounds widened by reach touch few of them. A point is
    joined by its cell in each of the levels that occur; only pairs whose bounds and plane are as
    near as some corner is (see `bounded_by_corners`) meet the face's shape, in the task that joined them.
    """
    ends = {c: (F.least(*(F.col(k + c) for k in "abc")) - reach, F.greatest(*(F.col(k + c) for k in "abc")) + reach) for c in "xyz"}
    extent = F.greatest(*(hi - lo - 2 * reach for lo, hi in ends.values()))
    n = V.cross(V.sub(V.p("b"), V.p("a")), V.sub(V.p("c"), V.p("a")))
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(extent, F.lit(reach)) / reach))).cast("int").alias("level")
    corners = [k + c for k in "abc" for c in "xyz"]
    f = tri.select("fid", *corners, level)
    levels = sorted(r.level for r in f.select("level").distinct().collect())  # as many as the sizes have binary orders
    if not levels:
        return points.select("vid", "x", "y", "z", F.lit(0.0).alias("d"))
    size = F.pow(F.lit(2.0), F.col("level")) * reach
    for c in "xyz":
        f = f.withColumn("k" + c, F.explode(F.sequence(F.floor(ends[c][0] / size), F.floor(ends[c][1] / size))))
    q = bounded_by_corners(points, tri, reach).select("vid", "x", "y", "z", "r", F.explode(F.array(*map(F.lit, levels))).alias("level"))
    q = q.withColumns({"k" + c: F.floor(F.col(c) / size) for c in "xyz"})
    # Large faces lie in few cells: a cell's points are dealt over several tasks, each with the cell's faces, however few bytes they are.
    keys = ["level", "kx", "ky", "kz", "deal"]
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    q = q.withColumn("deal", F.pmod(F.hash("vid"), F.lit(DEALS))).repartition(tasks, *keys)
    f = f.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1)))).repartition(tasks, *keys)
    near = q.join(f, keys)
    for c in "xyz":
        near = near.filter(F.col(c).between(F.least(*(F.col(k + c) for k in "abc")) - F.col("r"), F.greatest(*(F.col(k + c) for k in "abc")) + F.col("r")))
    # Rounding: as the products are, not as their difference is.
    at = V.dot(V.p("a"), n)
    slack = 1e-9 * (reach * V.length(n) + F.abs(at))
    near = near.filter(F.abs(V.dot(V.p(), n) - at) <= F.col("r") * V.length(n) + slack).select("vid", "fid", "x", "y", "z", *corners)
    best = near.mapInArrow(_least_distances, "vid long, fid long, d double").groupBy("vid").agg(F.min_by("d", F.struct(F.abs("d"), "fid")).alias("d"))
    return points.select("vid", "x", "y", "z").join(best, "vid", "left").withColumn("d", F.when(F.abs("d") <= reach, F.col("d")).otherwise(0.0))


def noise_floor(rmse: float) -> float:
    return max(3 * rmse, 0.02)


def height_grid(points: DataFrame, size: float, up: str = "y") -> DataFrame:
    """i, j, h: the greatest height of each cell across the axis `up`."""
    a, b = (c for c in "xyz" if c != up)
    return points.groupBy(V.cell(F.col(a), size).alias("i"), V.cell(F.col(b), size).alias("j")).agg(F.max(up).alias("h"))


def grid_change(baseline: DataFrame, current: DataFrame, size: float, threshold: float, only_current: bool = True) -> DataFrame:
    """gained and lost volume between two height grids beyond a dead band.

    A cell that the current scan lacks has not changed; one only it has gains its
    height's size if only_current says so.
    """
    both = baseline.select("i", "j", F.col("h").alias("b")).join(current.select("i", "j", F.col("h").alias("c")), ["i", "j"], "full_outer")
    d = F.when(F.col("c").isNull(), 0.0).when(F.col("b").isNull(), F.abs("c") if only_current else F.lit(0.0)).otherwise(F.col("c") - F.col("b"))
    area = float(size) ** 2
    x = F.col("d")
    return both.select(d.alias("d")).agg((F.coalesce(F.sum(F.when(x > threshold, x)), F.lit(0.0)) * area).alias("gained"), (F.coalesce(F.sum(F.when(x < -threshold, -x)), F.lit(0.0)) * area).alias("lost"), F.count("*").alias("cells"))


def change_clusters(distances: DataFrame, threshold: float, size: float, least: int = 5) -> DataFrame:
    """Clusters of changed points: occupied cells of 3 * size joined with their 26 neighbours."""
    hot = distances.filter(F.abs("d") > threshold).withColumns({"k" + c: V.cell(F.col(c), 3 * size) for c in "xyz"})
    cell = F.struct("kx", "ky", "kz")
    cells = hot.select(cell.alias("node")).distinct()
    near = cells.select(F.col("node").alias("u"), "node.*")
    for k in ("kx", "ky", "kz"):
        near = near.withColumn("o", F.explode(F.array(*(F.lit(i) for i in (-1, 0, 1))))).withColumn(k, F.col(k) + F.col("o")).drop("o")
    edges = near.select("u", cell.alias("v")).join(cells.select(F.col("node").alias("v")), "v", "left_semi").filter(F.col("u") < F.col("v"))
    label = labelled(cells, edges)
    each = hot.withColumn("node", cell).join(label, "node")
    return each.groupBy("component").agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in "xyz"), (F.sum(F.abs("d")) * float(size) ** 2).alias("volume"), F.sum("d").alias("total")).filter(F.col("n") >= least).select("component", "n", "x", "y", "z", "volume", F.when(F.col("total") >= 0, "gained").otherwise("lost").alias("kind"))


class Change(dict):
    """distances, volumes, threshold and size of a change; clusters, which take jobs of their own, are sought once they are asked for."""

    def __missing__(self, key):
        if key != "clusters":
            raise KeyError(key)
        self[key] = change_clusters(self["distances"], self["threshold"], self["size"])
        return self[key]


def diff(baseline_points: DataFrame, baseline_tri: DataFrame, current: DataFrame, alignment: Alignment, size: float) -> Change:
    """Clusters and volumes of change of the current scan, put in place by its alignment."""
    moved = current.withColumns(dict(zip("xyz", V.rigid(alignment.transform, V.p()), strict=True)))
    floor = noise_floor(alignment.rmse)
    d = signed_distances(moved, baseline_tri, max(size, 3 * floor))
    volume = grid_change(height_grid(baseline_points, size), height_grid(moved, size), size, floor)
    return Change(distances=d, volumes=volume, threshold=floor, size=size)
