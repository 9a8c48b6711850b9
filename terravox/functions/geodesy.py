"""WGS84 and UTM as column expressions."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import GeoError

#: Fixed values of WGS84 and UTM.
A, FLATTENING, K0 = 6378137.0, 1 / 298.257223563, 0.9996
E2 = 2 * FLATTENING - FLATTENING**2
EP2 = E2 / (1 - E2)
ZONES = (12, 18, 19)
METRES_A_DEGREE = 111_320.0


def zone(lon: Column) -> Column:
    return (F.floor((lon + 180.0) / 6.0) + 1).cast("int")


def _parts(lat: Column, lon: Column, zone_: Column):
    phi, dl = F.radians(lat), F.radians(lon - (6.0 * zone_ - 183.0))
    s, c, t2 = F.sin(phi), F.cos(phi), F.tan(phi) * F.tan(phi)
    return phi, dl, s, c, t2, EP2 * c * c


def meridian_arc(phi: Column) -> Column:
    a0 = 1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256
    a2 = 3 / 8 * (E2 + E2**2 / 4 + 15 * E2**3 / 128)
    a4 = 15 / 256 * (E2**2 + 3 * E2**3 / 4)
    a6 = 35 * E2**3 / 3072
    return A * (a0 * phi - a2 * F.sin(2 * phi) + a4 * F.sin(4 * phi) - a6 * F.sin(6 * phi))


def utm(lat: Column, lon: Column, zone_: Column | None = None) -> dict[str, Column]:
    """easting, northing, zone, is_north, epsg by the transverse Mercator series."""
    z = zone(lon) if zone_ is None else zone_
    phi, l, s, c, t, n2 = _parts(lat, lon, z)  # noqa: E741
    nu = A / F.sqrt(1 - E2 * s * s)
    x = c * l
    east = 5e5 + K0 * nu * (x + x**3 * (1 - t + n2) / 6 + x**5 * (5 - 18 * t + t * t + 72 * n2 - 58 * EP2) / 120 + x**7 * (61 - 479 * t + 179 * t * t - t * t * t) / 5040)
    up = nu * s / c * (x**2 / 2 + x**4 * (5 - t + 9 * n2 + 4 * n2 * n2) / 24 + x**6 * (61 - 58 * t + t * t + 600 * n2 - 330 * EP2) / 720)
    north = K0 * (meridian_arc(phi) + up) + F.when(lat < 0, 1e7).otherwise(0.0)
    return {"easting": east, "northing": north, "zone": z, "is_north": lat >= 0, "epsg": F.when(lat >= 0, 32600 + z).otherwise(32700 + z)}


def convergence(lat: Column, lon: Column, zone_: Column | None = None) -> Column:
    """Meridian convergence in degrees."""
    _, l, s, c, t, n2 = _parts(lat, lon, zone(lon) if zone_ is None else zone_)  # noqa: E741
    return F.degrees(l * s + l**3 * s * c**2 * (1 + 3 * n2 + 2 * n2 * n2) / 3 + l**5 * s * c**4 * (2 - t) / 15)


def geodetic(east: Column, north: Column, zone_: Column, is_north: Column) -> tuple[Column, Column]:
    """Latitude and longitude by the footpoint series, then two corrections through utm()'s own residual."""
    m = (north - F.when(is_north, 0.0).otherwise(1e7)) / K0
    mu = m / (A * (1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256))
    e1 = (1 - sqrt(1 - E2)) / (1 + sqrt(1 - E2))
    foot = mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + 151 * e1**3 / 96 * F.sin(6 * mu) + 1097 * e1**4 / 512 * F.sin(8 * mu)
    s, c, t = F.sin(foot), F.cos(foot), F.tan(foot) * F.tan(foot)
    c1, w = EP2 * c * c, 1 - E2 * s * s
    n1, r1 = A / F.sqrt(w), A * (1 - E2) / (w * F.sqrt(w))
    d = (east - 5e5) / (n1 * K0)
    lat = foot - n1 * F.tan(foot) / r1 * (d**2 / 2 - (5 + 3 * t + 10 * c1 - 4 * c1 * c1 - 9 * EP2) * d**4 / 24 + (61 + 90 * t + 298 * c1 + 45 * t * t - 252 * EP2 - 3 * c1 * c1) * d**6 / 720)
    lon = (d - (1 + 2 * t + c1) * d**3 / 6 + (5 - 2 * c1 + 28 * t - 3 * c1 * c1 + 8 * EP2 + 24 * t * t) * d**5 / 120) / c
    return F.degrees(lat), 6.0 * zone_ - 183.0 + F.degrees(lon)


def refined(df, east: str, north: str, zone_: str, is_north: str, rounds: int = 2):
    """df with lat and lon; each round takes the metres that the forward series is off."""
    lat, lon = geodetic(F.col(east), F.col(north), F.col(zone_), F.col(is_north))
    out = df.withColumn("lat", lat).withColumn("lon", lon)
    for _ in range(rounds):
        back = utm(F.col("lat"), F.col("lon"), F.col(zone_))
        out = out.withColumn("__dn", F.col(north) - back["northing"]).withColumn("__de", F.col(east) - back["easting"])
        out = out.withColumn("lon", F.col("lon") + F.degrees(F.col("__de") / (A * F.cos(F.radians("lat"))))).withColumn("lat", F.col("lat") + F.degrees(F.col("__dn") / A)).drop("__dn", "__de")
    return out


def fault(lat: Column, lon: Column) -> Column:
    """Why a fix has no UTM place here, or null."""
    return F.when((lat < -90) | (lat > 90), "latitude out of range").when((lon < -180) | (lon > 180), "longitude out of range").when(~zone(lon).isin(*ZONES), F.concat(F.lit("unsupported zone "), zone(lon)))


def checked(df, lat: str = "latitude", lon: str = "longitude"):
    """df, or GeoError if a row has no supported place."""
    bad = df.select(fault(F.col(lat), F.col(lon)).alias("f")).filter("f is not null").limit(1).collect()
    if bad:
        raise GeoError(bad[0].f)
    return df


def precision(value: Column, profile: Column) -> Column:
    """A coordinate as the profile exact / degraded / omitted shows it."""
    return F.when(profile == "exact", value).when(profile == "degraded", F.round(value / 100.0) * 100.0).otherwise(0.0)


def metres(dlat: Column, dlon: Column, at_lat: Column) -> tuple[Column, Column]:
    """North and east metres of small differences in degrees."""
    return dlat * METRES_A_DEGREE, dlon * METRES_A_DEGREE * F.cos(F.radians(at_lat))
