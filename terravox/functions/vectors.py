"""Vector algebra on flat columns, and small matrices on the driver.

A point is three columns named by a prefix: ``p("a")`` is (ax, ay, az). All of it
is plain arithmetic, so it stays inside generated code.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

V3 = tuple[Column, Column, Column]


def p(prefix: str = "") -> V3:
    return tuple(F.col(prefix + c) for c in "xyz")


def lit3(v) -> V3:
    return tuple(F.lit(float(c)) for c in v)


def sub(a: V3, b: V3) -> V3:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def dot(a: V3, b: V3) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: V3, b: V3) -> V3:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def length(a: V3) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: V3) -> V3:
    """Unit vector; zero if the length is 1e-12 or less."""
    n = length(a)
    return tuple(F.when(n > 1e-12, c / n).otherwise(F.lit(0.0)) for c in a)


def affine(m: np.ndarray, a: V3) -> V3:
    """4x4 matrix times point, as it is."""
    return tuple(sum((F.lit(float(m[r, c])) * a[c] for c in range(3)), F.lit(float(m[r, 3]))) for r in range(3))


def rigid(m: np.ndarray, a: V3) -> V3:
    """As affine(), with the rotation's columns made unit first."""
    n = np.array(m, float)
    n[:3, :3] /= np.maximum(np.linalg.norm(n[:3, :3], axis=0), 1e-12)
    return affine(n, a)


def plane_distance(a: V3, point, normal) -> Column:
    return dot(sub(a, lit3(point)), lit3(normal))


def oriented(n: V3, constraint: str, tilt_degrees: float = 0.0, near=None) -> Column:
    """Whether a unit normal, either way round, meets none / horizontal / vertical / near."""
    c, s = float(np.cos(np.radians(tilt_degrees))), float(np.sin(np.radians(tilt_degrees)))
    if constraint == "horizontal":
        return F.abs(n[1]) >= c
    if constraint == "vertical":
        return F.abs(n[1]) <= s
    if constraint == "near":
        return F.abs(dot(n, lit3(near))) >= c
    return F.lit(True)


def in_box(a: V3, centre, axes, half, tolerance: float = 1e-3) -> Column:
    """axes: three unit vectors, half: their half lengths."""
    d = sub(a, lit3(centre))
    out = F.lit(True)
    for axis, h in zip(axes, half, strict=True):
        out = out & (F.abs(dot(d, lit3(axis))) <= float(h) + tolerance)
    return out


def strike_basis(normal) -> tuple[np.ndarray, np.ndarray]:
    """In-plane axes by strike: up x n, or +X for a level plane."""
    n = np.array(normal, float)
    u = np.cross([0.0, 1.0, 0.0], n)
    u = u / np.linalg.norm(u) if np.linalg.norm(u) > 1e-6 else np.array([1.0, 0, 0])
    return u, np.cross(n, u)


def seeded_basis(normal) -> tuple[np.ndarray, np.ndarray]:
    """In-plane axes of the height fields: seeded by +X, or by +Y for a plane facing X."""
    n = np.array(normal, float)
    seed = np.array([0.0, 1.0, 0.0]) if abs(n[1]) < 0.9 else np.array([1.0, 0.0, 0.0])
    u = np.cross(seed, n)
    u /= np.linalg.norm(u)
    return u, np.cross(n, u)


def local(a: V3, point, normal, basis=seeded_basis) -> V3:
    """(u, v, h): place in the plane and height over it."""
    u, v = basis(normal)
    d = sub(a, lit3(point))
    return dot(d, lit3(u)), dot(d, lit3(v)), dot(d, lit3(normal))


def quadric_height(q, u: Column, v: Column) -> Column:
    """a u2 + b v2 + c uv + d u + e v + f."""
    a, b, c, d, e, f = map(float, q)
    return a * u * u + b * v * v + c * u * v + d * u + e * v + f


def cell(x: Column, size: float) -> Column:
    return F.floor(x / F.lit(float(size))).cast("long")


def rounded_cell(x: Column, size: float) -> Column:
    return F.round(x / F.lit(float(size))).cast("long")


def azimuth(dx: Column, dz: Column) -> Column:
    """Degrees clockwise from north (-Z); 0 for no offset."""
    return F.when((F.abs(dx) < 1e-12) & (F.abs(dz) < 1e-12), F.lit(0.0)).otherwise(F.pmod(F.degrees(F.atan2(dx, -dz)), F.lit(360.0)))


def dip(n: V3) -> tuple[Column, Column]:
    """Dip and dip direction in degrees of an upward unit normal."""
    flat = F.sqrt(n[0] * n[0] + n[2] * n[2])
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), n[1]))))
    return angle, F.when(flat <= 1e-6, F.lit(0.0)).otherwise(F.pmod(F.degrees(F.atan2(-n[0], n[2])), F.lit(360.0)))


def in_triangle(u: Column, v: Column, a, b, c) -> Column:
    """Boundary counts; either winding."""
    side = lambda m, n: (u - n[0]) * (m[1] - n[1]) - (m[0] - n[0]) * (v - n[1])
    s = [side(a, b), side(b, c), side(c, a)]
    return ~(((s[0] < 0) | (s[1] < 0) | (s[2] < 0)) & ((s[0] > 0) | (s[1] > 0) | (s[2] > 0)))


def plane_height(u: Column, v: Column, a, b, c) -> Column:
    """Height at (u, v) on the plane through three (u, v, h); null if they stand in line."""
    d = (b[0] - a[0]) * (c[1] - a[1]) - (c[0] - a[0]) * (b[1] - a[1])
    s = ((u - a[0]) * (c[1] - a[1]) - (c[0] - a[0]) * (v - a[1])) / F.nullif(d, F.lit(0.0))
    t = ((b[0] - a[0]) * (v - a[1]) - (u - a[0]) * (b[1] - a[1])) / F.nullif(d, F.lit(0.0))
    return F.when(F.abs(d) > 1e-12, a[2] + s * (b[2] - a[2]) + t * (c[2] - a[2]))


# ------------------------------------------------------------ driver matrices


def triangle_distances(q: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact distance of each row's point to its triangle, signed by the side of its normal."""
    n = np.cross(b - a, c - a)
    n2 = (n * n).sum(1)
    height = ((q - a) * n).sum(1)
    inside, edge = n2 > 0, np.full(len(q), np.inf)
    for m, o in ((a, b), (b, c), (c, a)):
        e, f = o - m, q - m
        inside &= (np.cross(e, f) * n).sum(1) >= 0
        e2 = (e * e).sum(1)
        t = np.clip(np.divide((f * e).sum(1), e2, out=np.zeros(len(q)), where=e2 > 0), 0, 1)
        edge = np.minimum(edge, ((f - t[:, None] * e) ** 2).sum(1))
    d = np.where(inside, np.abs(height) / np.sqrt(np.where(n2 > 0, n2, 1)), np.sqrt(edge))
    return np.where(height < 0, -d, d)


def matrix(translation, quaternion=(0.0, 0.0, 0.0, 1.0)) -> np.ndarray:
    """4x4 from a translation and a quaternion (x, y, z, w)."""
    x, y, z, w = np.array(quaternion, float) / np.linalg.norm(quaternion)
    m = np.eye(4)
    m[:3, :3] = [[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]]
    m[:3, 3] = translation
    return m


def rotation(axis, degrees: float) -> np.ndarray:
    half = np.radians(degrees) / 2
    return matrix((0, 0, 0), (*(np.array(axis, float) / np.linalg.norm(axis) * np.sin(half)), np.cos(half)))


def rigid_inverse(m: np.ndarray) -> np.ndarray:
    out = np.eye(4)
    out[:3, :3] = m[:3, :3].T
    out[:3, 3] = -m[:3, :3].T @ m[:3, 3]
    return out


def small_rotation(omega) -> np.ndarray:
    """I + [omega]x, made orthonormal."""
    x, y, z = omega
    q, r = np.linalg.qr(np.array([[1, -z, y], [z, 1, -x], [-y, x, 1]], float))
    return q * np.sign(np.diag(r))


def splitmix64(seed: int, n: int) -> np.ndarray:
    """The first n numbers of the SplitMix64 generator."""
    state = np.uint64(seed & (2**64 - 1)) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (state ^ (state >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))
