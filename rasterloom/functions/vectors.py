"""Vectors and rotations on structs of columns: frames, quaternions, rays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]

# The ellipsoid of the ray intersection, semi-minor axis rounded.
RAY_A, RAY_B = 6378137.0, 6356752.3


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def unit(a: Vec) -> Vec:
    """Null for the zero vector."""
    n = F.sqrt(dot(a, a))
    return tuple(F.try_divide(x, n) for x in a)


def orbital_frame(pos: Vec, vel: Vec) -> tuple[Vec, Vec, Vec]:
    """Axes: Z along the position, X along velocity x Z, Y = Z x X."""
    z = unit(pos)
    x = unit(cross(vel, z))
    return x, cross(z, x), z


def quaternion_matrix(w: Column, x: Column, y: Column, z: Column) -> list[Column]:
    """Rotation by rows of a quaternion of any length but 0."""
    n = F.sqrt(w * w + x * x + y * y + z * z)
    w, x, y, z = (F.try_divide(v, n) for v in (w, x, y, z))
    return [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w), 2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w), 2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]


def transposed(r: list[Column]) -> list[Column]:
    """Of nine numbers by rows."""
    return [r[3 * j + i] for i in range(3) for j in range(3)]


def opk_matrix(omega: Column, phi: Column, kappa: Column) -> list[Column]:
    """Rows of Rx(omega) Ry(phi) Rz(kappa), angles in radians."""
    so, co, sp, cp, sk, ck = F.sin(omega), F.cos(omega), F.sin(phi), F.cos(phi), F.sin(kappa), F.cos(kappa)
    return [cp * ck, -cp * sk, sp, co * sk + so * sp * ck, co * ck - so * sp * sk, -so * cp, so * sk - co * sp * ck, so * ck + co * sp * sk, co * cp]


def ray_ellipsoid(s: Vec, u: Vec, h: Column) -> Vec:
    """First point of the ray s + m u on the ellipsoid raised by h; null if it misses."""
    a, b = (F.lit(RAY_A) + h) * (F.lit(RAY_A) + h), (F.lit(RAY_B) + h) * (F.lit(RAY_B) + h)
    alpha = (u[0] * u[0] + u[1] * u[1]) / a + u[2] * u[2] / b
    beta = 2 * ((s[0] * u[0] + s[1] * u[1]) / a + s[2] * u[2] / b)
    gamma = (s[0] * s[0] + s[1] * s[1]) / a + s[2] * s[2] / b - 1
    disc = beta * beta - 4 * alpha * gamma
    m = F.when(disc >= 0, (-beta - F.sqrt(F.greatest(disc, F.lit(0.0)))) / (2 * alpha))
    return tuple(x + m * d for x, d in zip(s, u, strict=True))


def triangulate(p1: Vec, s1: Vec, p2: Vec, s2: Vec) -> tuple[Vec, Column]:
    """Midpoint and distance of the closest points of two lines; null for parallel ones or null inputs."""
    d = tuple(b - a for a, b in zip(p1, p2, strict=True))
    a, b, c, u, v = dot(s1, s1), dot(s1, s2), dot(s2, s2), dot(s1, d), dot(s2, d)
    den = a * c - b * b
    lam, mu = F.try_divide(c * u - b * v, den), F.try_divide(b * u - a * v, den)
    q1, q2 = (tuple(x + k * y for x, y in zip(p, s, strict=True)) for p, s, k in ((p1, s1, lam), (p2, s2, mu)))
    gap = tuple(y - x for x, y in zip(q1, q2, strict=True))
    return tuple((x + y) / 2 for x, y in zip(q1, q2, strict=True)), F.sqrt(dot(gap, gap))
