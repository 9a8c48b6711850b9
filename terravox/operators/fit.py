"""Plane and box fits: one aggregate of moments, then 3x3 algebra on what it returns."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import GeometryError, StratigraphyError
from ..functions import vectors as V

_PAIRS = ("xx", "xy", "xz", "yy", "yz", "zz")


def moments(points: DataFrame, *by: str) -> DataFrame:
    """n, centroid (mx, my, mz) and population covariance (cxx .. czz)."""
    return points.groupBy(*by).agg(F.count("*").alias("n"), *(F.avg(c).alias("m" + c) for c in "xyz"), *(F.covar_pop(a, b).alias(f"c{a}{b}") for a, b in _PAIRS))


def covariance(row) -> np.ndarray:
    xx, xy, xz, yy, yz, zz = (row["c" + k] for k in _PAIRS)
    return np.array([[xx, xy, xz], [xy, yy, yz], [xz, yz, zz]])


def axes(row) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and their unit vectors as rows, each with its largest part positive."""
    w, v = np.linalg.eigh(covariance(row))
    v = v[:, ::-1].T
    v *= np.sign(v[np.arange(3), np.abs(v).argmax(1)])[:, None]
    return w[::-1], v


def least_varying_axis(points: DataFrame, *by: str) -> DataFrame:
    """The coordinate of least variance; of equals the first."""
    v = points.groupBy(*by).agg(F.count("*").alias("n"), *(F.var_pop(c).alias("v" + c) for c in "xyz"))
    return v.withColumn("axis", F.when((F.col("vx") <= F.col("vy")) & (F.col("vx") <= F.col("vz")), "x").when(F.col("vy") <= F.col("vz"), "y").otherwise("z"))


def plane(points: DataFrame) -> dict:
    """Least-squares plane: point, unit normal (upward), rms, n."""
    row = moments(points).first()
    if row.n < 3:
        raise GeometryError("too few points")
    w, v = axes(row)
    if w[1] <= 1e-12 * max(w[0], 1e-300):
        raise GeometryError("points are colinear")
    n = v[2] if v[2][1] >= 0 else -v[2]
    return {"point": (row.mx, row.my, row.mz), "normal": tuple(n), "rms": float(np.sqrt(max(w[2], 0.0))), "n": row.n}


def planes(points: DataFrame, by: str) -> DataFrame:
    """A least-squares plane for each group, solved in batches of groups."""
    kind = dict(points.dtypes)[by]

    def solve(batches):
        for pdf in batches:
            out = []
            for _, r in pdf.iterrows():
                w, v = axes(r)
                n = v[2] if v[2][1] >= 0 else -v[2]
                out.append((r[by], r.n, *n, float(np.sqrt(max(w[2], 0.0)))))
            yield pd.DataFrame(out, columns=[by, "n", "nx", "ny", "nz", "rms"]).astype({by: pdf[by].dtype, "n": "int64"})

    return moments(points, by).mapInPandas(solve, f"{by} {kind}, n long, nx double, ny double, nz double, rms double")


def boxes(points: DataFrame, by: str, gravity_up: bool = False) -> DataFrame:
    """Principal-axis box of each group: centre between the extremes, half sizes, axes (row by row)."""
    kind = dict(points.dtypes)[by]

    def solve(batches):
        for pdf in batches:
            out = []
            for _, r in pdf.iterrows():
                v = axes(r)[1]
                if gravity_up:
                    up = np.array([0.0, 1.0, 0.0])
                    flat = v[0] - up * v[0][1]
                    u = flat / np.linalg.norm(flat) if np.linalg.norm(flat) > 1e-9 else np.array([1.0, 0.0, 0.0])
                    v = np.array([u, up, np.cross(u, up)])
                out.append((r[by], v.ravel().tolist()))
            yield pd.DataFrame(out, columns=[by, "axes"]).astype({by: pdf[by].dtype})

    ax = moments(points, by).mapInPandas(solve, f"{by} {kind}, axes array<double>")
    t = [F.col("x") * F.col("axes")[3 * k] + F.col("y") * F.col("axes")[3 * k + 1] + F.col("z") * F.col("axes")[3 * k + 2] for k in range(3)]
    span = points.join(ax, by).groupBy(by, "axes").agg(F.count("*").alias("n"), *(f(c).alias(f"{n}{k}") for k, c in enumerate(t) for f, n in ((F.min, "lo"), (F.max, "hi"))))
    mid = [(F.col(f"lo{k}") + F.col(f"hi{k}")) / 2 for k in range(3)]
    centre = [sum((mid[k] * F.col("axes")[3 * k + c] for k in range(3)), F.lit(0.0)).alias("c" + "xyz"[c]) for c in range(3)]
    return span.select(by, "n", *centre, *(((F.col(f"hi{k}") - F.col(f"lo{k}")) / 2).alias("h" + "xyz"[k]) for k in range(3)), "axes")


def segment_boxes(points: DataFrame, by: str, floor: float = 1e-3) -> DataFrame:
    """Centroid-centred box of each segment; half sizes reach the farthest point, `floor` at least; under three points a 1 cm cube."""
    kind = dict(points.dtypes)[by]

    def solve(batches):
        for pdf in batches:
            yield pd.DataFrame([(r[by], (axes(r)[1] if r.n >= 3 else np.eye(3)).ravel().tolist(), r.mx, r.my, r.mz) for _, r in pdf.iterrows()], columns=[by, "axes", "cx", "cy", "cz"]).astype({by: pdf[by].dtype})

    ax = moments(points, by).mapInPandas(solve, f"{by} {kind}, axes array<double>, cx double, cy double, cz double")
    d = [F.col(c) - F.col("c" + c) for c in "xyz"]
    t = [F.max(F.abs(sum((d[c] * F.col("axes")[3 * k + c] for c in range(3)), F.lit(0.0)))) for k in range(3)]
    n = F.count("*")
    return points.join(ax, by).groupBy(by, "axes", "cx", "cy", "cz").agg(n.alias("n"), *(F.when(n < 3, 5e-3).otherwise(F.greatest(c, F.lit(floor))).alias("h" + "xyz"[k]) for k, c in enumerate(t)))


def is_colinear(points: DataFrame, order: str, tolerance: float = 1e-3) -> bool:
    """Whether all points lie within tolerance times the extent of the line from the first to the point farthest from it."""
    first = points.agg(F.min_by(F.struct("x", "y", "z"), order).alias("p")).first().p
    d = V.sub(V.p(), V.lit3(first))
    far = points.agg(F.max_by(F.struct("x", "y", "z"), V.length(d)).alias("p"), F.max(V.length(d)).alias("e")).first()
    if not far.e:
        return True
    axis = (np.array(far.p) - np.array(first)) / far.e
    off = points.agg(F.max(V.length(V.cross(d, V.lit3(axis)))).alias("o")).first().o
    return off < tolerance * far.e


def plane_through(a, b, c):
    n = np.cross(np.subtract(b, a), np.subtract(c, a))
    size = np.linalg.norm(n)
    return None if size <= 1e-6 else (tuple(map(float, a)), tuple(n / size))


def scored(points: DataFrame, hypotheses: list[tuple], threshold: float) -> DataFrame:
    """Inliers and MSAC score of each hypothesis (hid, px, py, pz, nx, ny, nz): a stated, small set, exploded from a literal, over all points."""
    schema = "array<struct<hid:bigint,px:double,py:double,pz:double,nx:double,ny:double,nz:double>>"
    rows = json.dumps([dict(zip(("hid", "px", "py", "pz", "nx", "ny", "nz"), h, strict=True)) for h in hypotheses])
    each = points.select("x", "y", "z", F.explode(F.from_json(F.lit(rows), schema)).alias("h")).select("x", "y", "z", "h.*")
    d = F.abs(V.dot(V.sub(V.p(), V.p("p")), V.p("n")))
    t2 = float(threshold) ** 2
    return each.groupBy("hid").agg(F.sum((d <= threshold).cast("long")).alias("inliers"), F.sum(F.least(d * d, F.lit(t2))).alias("msac"))


def hypotheses(points: DataFrame, order: str, n: int, constraint: str = "none", tilt: float = 0.0, near=None, seed: int = 42) -> list[tuple]:
    """(hid, px, py, pz, nx, ny, nz) of those of n seeded draws that make a plane which meets the constraint.

    Triples are drawn from 3 * n points, those of the smallest md5 of seed and `order`.
    Where points have normals (nx, ny, nz), only those whose normal meets the
    constraint are drawn from, if there are three of them.
    """
    pool = points
    if "nx" in points.columns and constraint != "none":
        fits = points.filter(_column_meets(constraint, tilt, near))
        pool = fits if len(fits.limit(3).collect()) == 3 else points
    text = F.col(order).cast("string") if not isinstance(points.schema[order].dataType, StructType) else F.concat_ws(",", *(F.col(f"{order}.{f}").cast("string") for f in points.schema[order].dataType.names))
    drawn = pool.select("x", "y", "z", order).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), text)), order).limit(3 * n).collect()
    if len(drawn) < 3:
        raise GeometryError("too few points")
    draws = (V.splitmix64(seed, 3 * n) % np.uint64(len(drawn))).astype(np.int64).reshape(-1, 3)
    place = [(r.x, r.y, r.z) for r in drawn]
    out = []
    for i, (a, b, c) in enumerate(draws):
        made = plane_through(place[a], place[b], place[c]) if len({a, b, c}) == 3 else None
        if made and _meets(made[1], constraint, tilt, near):
            out.append((i, *map(float, made[0]), *map(float, made[1])))
    return out


#: Hypotheses that the first round scores; each round after it scores twice as many.
FIRST_ROUND = 32


def ransac_plane(points: DataFrame, order: str, iterations: int = 500, threshold: float = 0.02, least: int = 50, constraint: str = "none", tilt: float = 0.0, near=None, seed: int = 42, scoring: str = "msac", confidence: float | None = None) -> dict:
    """Plane of the best score among seeded hypotheses, refined by least squares on its inliers.

    scoring: msac, the least sum of squared distances cut at the threshold, or inliers,
    the greatest count; the first of equally good hypotheses wins. confidence: if given, draws end
    once as many were made as find a plane of the best one's share of inliers, w, with
    that chance: log(1 - confidence) / log(1 - w**3). Rounds score many hypotheses at once,
    in one job over all points each, and are then gone through in order, so the result is
    that of one after another.
    """
    if scoring not in ("msac", "inliers"):
        raise GeometryError(f"unknown scoring {scoring}")
    rows, total = hypotheses(points, order, iterations, constraint, tilt, near, seed), None
    best, share, until, done, size = None, 0.0, iterations, 0, FIRST_ROUND if confidence else len(rows)
    while done < len(rows) and rows[done][0] < until:
        batch = rows[done : done + size]
        got = {r.hid: r for r in scored(points, batch, threshold).collect()}
        if total is None and confidence:
            total = points.count()
            share = min(0.999, max(1, least) / total)
        for h in batch:
            if h[0] >= until:
                break
            r = got[h[0]]
            value = (r.msac if scoring == "msac" else -r.inliers, h[0])
            if best is None or value < best[0]:
                best = value, h, r
                if confidence:
                    share = max(share, r.inliers / total)
                    chance = np.log1p(-(share**3)) if share < 1 else -np.inf
                    until = min(iterations, max(1, int(np.log1p(-confidence) / chance))) if chance < 0 else iterations
        done, size = done + size, 2 * size
    if best is None or best[2].inliers < least:
        raise GeometryError("no consensus")
    _, raw, won = best
    inside = points.filter(F.abs(V.plane_distance(V.p(), raw[1:4], raw[4:7])) <= threshold)
    fine = plane(inside)
    if not _meets(fine["normal"], constraint, tilt, near):
        fine |= {"point": raw[1:4], "normal": raw[4:7]}
    return fine | {"inliers": won.inliers, "msac": won.msac, "hid": raw[0], "raw": raw[1:], "iterations": min(until, iterations)}


def _column_meets(constraint: str, tilt: float, near):
    """Whether a point's normal meets the constraint; a normal need not have length one."""
    n = V.normalized(V.p("n"))
    c, s = float(np.cos(np.radians(tilt))), float(np.sin(np.radians(tilt)))
    return {"horizontal": lambda: F.abs(n[1]) >= c, "vertical": lambda: F.abs(n[1]) <= s, "near": lambda: F.abs(V.dot(n, V.lit3(near))) >= c}[constraint]()


def _meets(n, constraint: str, tilt: float, near) -> bool:
    c, s = np.cos(np.radians(tilt)), np.sin(np.radians(tilt))
    return {"none": True, "horizontal": abs(n[1]) >= c, "vertical": abs(n[1]) <= s, "near": near is not None and abs(np.dot(n, near)) >= c}[constraint]


def ortho_raster(points: DataFrame, point, normal, per_metre: float = 200.0, basis=V.strike_basis) -> DataFrame:
    """col, row, height, n: the highest point of each pixel of the plane's picture and how many fell in it."""
    u, v, h = V.local(V.p(), point, normal, basis)
    flat = points.select(u.alias("u"), v.alias("v"), h.alias("h"))
    b = flat.agg(*(f(c).alias(n + c) for c in "uv" for f, n in ((F.min, "lo"), (F.max, "hi")))).first()
    if b.lou is None:
        raise GeometryError("no points")
    pixel = lambda c, lo, hi: F.least(F.floor((F.col(c) - lo) * per_metre), F.lit(max(0, int(np.ceil((hi - lo) * per_metre)) - 1))).cast("long")
    return flat.groupBy(pixel("u", b.lou, b.hiu).alias("col"), pixel("v", b.lov, b.hiv).alias("row")).agg(F.max("h").alias("height"), F.count("*").alias("n"))


def back_projected(marks: DataFrame, image: DataFrame, per_metre: float, lo: tuple[float, float], point, normal, basis=V.strike_basis) -> DataFrame:
    """Marks (col, row, ...) as places on the plane at pixel centres; marks without a pixel in the image drop out, and none left is an error."""
    u, v = basis(normal)
    hit = marks.join(image.select("col", "row"), ["col", "row"], "left_semi")
    if not hit.limit(1).count():
        raise StratigraphyError("no marks left")
    a, b = (F.col("col") + 0.5) / per_metre + lo[0], (F.col("row") + 0.5) / per_metre + lo[1]
    return hit.withColumns({c: F.lit(float(point[k])) + a * float(u[k]) + b * float(v[k]) for k, c in enumerate("xyz")})


