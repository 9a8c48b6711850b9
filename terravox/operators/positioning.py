"""GPS bursts, camera tracks and the frame of a site."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import GeoError
from ..functions import geodesy as G


def gated(fixes: DataFrame, most_horizontal: float = 10.0) -> DataFrame:
    """fixes with `reason` where a fix is rejected; none is dropped."""
    reason = F.when(F.col("horizontal_accuracy") <= 0, "accuracy unknown").when(F.col("horizontal_accuracy") > most_horizontal, "horizontal accuracy")
    return fixes.withColumn("reason", reason).withColumn("accepted", reason.isNull())


def weighted_median(fixes: DataFrame, value: str, by: str = "burst_id") -> DataFrame:
    """Lower weighted median, weights 1 / accuracy squared: the first value whose running weight reaches half."""
    w = 1.0 / (F.col("horizontal_accuracy") * F.col("horizontal_accuracy"))
    order = Window.partitionBy(by).orderBy(value, "ord")
    run = fixes.withColumn("w", w).withColumn("run", F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("all", F.sum("w").over(Window.partitionBy(by)))
    return run.filter(F.col("run") >= F.col("all") / 2).groupBy(by).agg(F.min_by(value, F.struct(value, "ord")).alias(value))


def verdicts(fixes: DataFrame, most_horizontal: float = 10.0, good: float = 15.0, by: str = "burst_id") -> DataFrame:
    """Chosen place, weighted means, dispersion and quality of each burst's accepted fixes."""
    ok = gated(fixes, most_horizontal).filter("accepted")
    w = 1.0 / (F.col("horizontal_accuracy") * F.col("horizontal_accuracy"))
    mean = lambda c: (F.sum(w * F.col(c)) / F.sum(w)).alias(c)
    place = weighted_median(ok, "latitude", by).join(weighted_median(ok, "longitude", by), by)
    stats = ok.groupBy(by).agg(F.count("*").alias("n"), mean("altitude"), mean("horizontal_accuracy"), mean("vertical_accuracy"))
    spread = dispersion(ok, place, by)
    out = place.join(stats, by).join(spread, by)
    return out.withColumn("quality", F.when(F.coalesce("dispersion", F.lit(0.0)) <= good, "good").otherwise("degraded"))


def dispersion(fixes: DataFrame, place: DataFrame, by: str = "burst_id") -> DataFrame:
    """Horizontal RMS metres about each burst's place; null for fewer than two fixes."""
    at = place.select(by, F.col("latitude").alias("lat0"), F.col("longitude").alias("lon0"))
    n, e = G.metres(F.col("latitude") - F.col("lat0"), F.col("longitude") - F.col("lon0"), F.col("lat0"))
    return fixes.join(at, by).groupBy(by).agg(F.when(F.count("*") >= 2, F.sqrt(F.avg(n * n + e * e))).alias("dispersion"))


def track_length(track: DataFrame, by: str = "burst_id") -> DataFrame:
    w = Window.partitionBy(by).orderBy("ts", "ord")
    d = [F.col(c) - F.lag(c).over(w) for c in ("tx", "ty", "tz")]
    step = track.withColumn("step", F.sqrt(sum((x * x for x in d), F.lit(0.0))))
    return step.groupBy(by).agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("length"), F.count("*").alias("n"))


def interpolated(track: DataFrame, fixes: DataFrame, values: tuple[str, ...] = ("latitude", "longitude"), by: str = "burst_id") -> DataFrame:
    """track with the fixes' values at its times: linear between the fixes around, held at either end.

    One union and two windows over (burst, time); no pair of a track point and a fix is ever a row.
    """
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    names = [c for c in track.columns if c != by]
    a = track.select(by, t.alias("t"), F.lit(1).alias("side"), F.struct(*names).alias("row"), F.lit(None).cast("struct<" + ",".join(f"{v}:double" for v in values) + ",t:bigint>").alias("fix"))
    b = fixes.select(by, t.alias("t"), F.lit(0).alias("side"), F.lit(None).cast(a.schema["row"].dataType).alias("row"), F.struct(*(F.col(v).cast("double").alias(v) for v in values), t.alias("t")).alias("fix"))
    order = Window.partitionBy(by).orderBy("t", "side")
    both = a.unionByName(b)
    # The fix behind is the last one of the reversed order, so that both frames grow row by row.
    back = Window.partitionBy(by).orderBy(F.desc("t"), F.desc("side"))
    both = both.withColumn("p", F.last("fix", True).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("q", F.last("fix", True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    gap = F.col("q.t") - F.col("p.t")
    share = F.when(gap > 0, (F.col("t") - F.col("p.t")) / gap).otherwise(0.0)
    value = lambda v: F.when(F.col("p").isNull(), F.col(f"q.{v}")).when(F.col("q").isNull(), F.col(f"p.{v}")).otherwise(F.col(f"p.{v}") + share * (F.col(f"q.{v}") - F.col(f"p.{v}"))).alias(v)
    return both.filter("side = 1").select(by, "row.*", *(value(v) for v in values))


def horn_yaw(pairs: DataFrame, by: str = "burst_id") -> DataFrame:
    """yaw (radians), sigma and n of the rotation that best takes (ax, ay) to (gx, gy), both about their means."""
    all_ = Window.partitionBy(by)
    # Windows, as joins back to the sums would work the pairs out again for each.
    c = pairs.select(by, F.count("*").over(all_).alias("n"), *((F.col(k) - F.avg(k).over(all_)).alias(k) for k in ("ax", "ay", "gx", "gy")))
    num, den = F.sum(F.col("ax") * F.col("gy") - F.col("ay") * F.col("gx")), F.sum(F.col("ax") * F.col("gx") + F.col("ay") * F.col("gy"))
    sums = c.withColumns({"num": num.over(all_), "den": den.over(all_), "radius": F.avg(F.sqrt(F.col("ax") ** 2 + F.col("ay") ** 2)).over(all_)})
    r = sums.filter((F.abs("den") > 1e-10) | (F.abs("num") > 1e-10)).withColumn("yaw", F.atan2("num", "den"))
    ex = F.cos("yaw") * F.col("ax") - F.sin("yaw") * F.col("ay") - F.col("gx")
    ey = F.sin("yaw") * F.col("ax") + F.cos("yaw") * F.col("ay") - F.col("gy")
    return r.groupBy(by, "yaw", "n", "radius").agg(F.sqrt(F.avg(ex * ex + ey * ey)).alias("rms")).select(by, "n", "yaw", (F.col("rms") / F.col("radius")).alias("sigma"))


def long_enough(track: DataFrame, least_length: float = 10.0, by: str = "burst_id") -> DataFrame:
    """Bursts of three track points or more and `least_length` metres, with length and n."""
    return track_length(track, by).filter((F.col("n") >= 3) & (F.col("length") >= least_length))


def framed(track: DataFrame, fixes: DataFrame, by: str = "burst_id") -> DataFrame:
    """Bursts that a site's frame can come from, with n, their track points: the place has a supported UTM zone and the track is long enough."""
    ok = gated(fixes).filter("accepted")
    place = weighted_median(ok, "latitude", by).join(weighted_median(ok, "longitude", by), by)
    return long_enough(track, by=by).select(by, "n").join(place.filter(G.fault(F.col("latitude"), F.col("longitude")).isNull()), by, "left_semi")


def yaw(track: DataFrame, fixes: DataFrame, least_length: float = 10.0, by: str = "burst_id") -> DataFrame:
    """Yaw of each burst of three track points or more and `least_length` metres."""
    long = long_enough(track, least_length, by).select(by)
    origin = fixes.groupBy(by).agg(F.avg("latitude").alias("lat0"), F.avg("longitude").alias("lon0"))
    at = interpolated(track, fixes, by=by).join(long, by, "left_semi").join(origin, by)
    n, e = G.metres(F.col("latitude") - F.col("lat0"), F.col("longitude") - F.col("lon0"), F.col("lat0"))
    return horn_yaw(at.select(by, F.col("tx").alias("ax"), (-F.col("tz")).alias("ay"), e.alias("gx"), n.alias("gy")), by)


def site_frame(track: DataFrame, fixes: DataFrame, burst) -> dict:
    """UTM origin, convergence, yaw and the 4x4 rotation of one burst."""
    own = fixes.filter(F.col("burst_id") == F.lit(burst))
    v = verdicts(own).first()
    if v is None:
        raise GeoError("no accepted fix")
    G.checked(own.sparkSession.createDataFrame([(v.latitude, v.longitude)], "latitude double, longitude double"))
    y = yaw(track.filter(F.col("burst_id") == F.lit(burst)), own).first()
    if y is None:
        raise GeoError("track too short")
    place = own.sparkSession.createDataFrame([(v.latitude, v.longitude)], "lat double, lon double")
    row = place.select(*(c.alias(n) for n, c in G.utm(F.col("lat"), F.col("lon")).items()), G.convergence(F.col("lat"), F.col("lon")).alias("convergence")).first()
    c, s = np.cos(y.yaw), np.sin(y.yaw)
    m = np.eye(4)
    m[:3, :3] = np.array([[c, 0, -s], [0, 1, 0], [s, 0, c]]).T
    return {"utm": row.asDict(), "quality": v.quality, "yaw": y.yaw, "sigma": y.sigma, "transform": m}
