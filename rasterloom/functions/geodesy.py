"""WGS84 geodesy as column expressions: UTM both ways, earth-centred coordinates both ways."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 and UTM.
A, INV_F, K0, EAST0, SOUTH0 = 6378137.0, 298.257223563, 0.9996, 500000.0, 10000000.0
FLAT = 1 / INV_F
B = A * (1 - FLAT)
E2 = FLAT * (2 - FLAT)
E = math.sqrt(E2)
EP2 = E2 / (1 - E2)
N = FLAT / (2 - FLAT)
RADIUS = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64 + N**6 / 256)

# Coefficients of n, n^2, ... in Krueger's series of order 6.
_ALPHA = [[1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800], [13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360], [61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440], [49561 / 161280, -179 / 168, 6601661 / 7257600], [34729 / 80640, -3418889 / 1995840], [212378941 / 319334400]]
_BETA = [[1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800], [1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720], [17 / 480, -37 / 840, -209 / 4480, 5569 / 90720], [4397 / 161280, -11 / 504, -830251 / 7257600], [4583 / 161280, -108847 / 3991680], [20648693 / 638668800]]
ALPHA = [sum(c * N ** (j + k + 1) for k, c in enumerate(row)) for j, row in enumerate(_ALPHA)]
BETA = [sum(c * N ** (j + k + 1) for k, c in enumerate(row)) for j, row in enumerate(_BETA)]


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180.0) / 6.0) + 1).cast("int")


def utm_epsg(lon: Column, lat: Column) -> Column:
    """326zz north of the equator, 327zz on it and south of it."""
    return F.when(lat > 0, 32600).otherwise(32700) + utm_zone(lon)


def to_utm(lon: Column, lat: Column, zone: Column, north: Column) -> tuple[Column, Column]:
    """Easting and northing in metres, good to nanometres inside a zone."""
    s, d = F.sin(F.radians(lat)), F.radians(lon - (zone * 6 - 183).cast("double"))
    t = F.sinh(F.atanh(s) - F.lit(E) * F.atanh(s * E))
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(t * t + 1.0))
    x, y = eta, xi
    for j, a in enumerate(ALPHA, 1):
        x = x + F.lit(a) * F.cos(xi * (2.0 * j)) * F.sinh(eta * (2.0 * j))
        y = y + F.lit(a) * F.sin(xi * (2.0 * j)) * F.cosh(eta * (2.0 * j))
    return x * (K0 * RADIUS) + EAST0, y * (K0 * RADIUS) + F.when(north, 0.0).otherwise(SOUTH0)


def from_utm(east: Column, north_m: Column, zone: Column, north: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees."""
    eta, xi = (east - EAST0) / (K0 * RADIUS), (north_m - F.when(north, 0.0).otherwise(SOUTH0)) / (K0 * RADIUS)
    x, y = eta, xi
    for j, b in enumerate(BETA, 1):
        x = x - F.lit(b) * F.cos(xi * (2.0 * j)) * F.sinh(eta * (2.0 * j))
        y = y - F.lit(b) * F.sin(xi * (2.0 * j)) * F.cosh(eta * (2.0 * j))
    s = F.sin(y) / F.cosh(x)
    q = F.atanh(s)
    steps = F.transform(F.array(F.struct(q.alias("q"), s.alias("s"))), lambda v: F.aggregate(F.sequence(F.lit(1), F.lit(7)), v["s"], lambda acc, _: F.tanh(v["q"] + F.lit(E) * F.atanh(acc * E))))
    return F.degrees(F.atan2(F.sinh(x), F.cos(y))) + (zone * 6 - 183).cast("double"), F.degrees(F.asin(steps[0]))


def to_ecef(lon: Column, lat: Column, alt: Column) -> tuple[Column, Column, Column]:
    f, g = F.radians(lat), F.radians(lon)
    n = F.lit(A) / F.sqrt(F.lit(1.0) - F.lit(E2) * F.sin(f) * F.sin(f))
    return (n + alt) * F.cos(f) * F.cos(g), (n + alt) * F.cos(f) * F.sin(g), (n * (1 - E2) + alt) * F.sin(f)


def from_ecef(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Longitude, latitude, height: two rounds of Bowring's formula."""
    p = F.sqrt(x * x + y * y)

    def bowring(t: Column) -> Column:
        return F.atan2(z + F.lit(EP2 * B) * F.pow(F.sin(t), 3), p - F.lit(E2 * A) * F.pow(F.cos(t), 3))

    first = bowring(F.atan2(z * A, p * B))
    lat = bowring(F.atan2(F.sin(first) * B, F.cos(first) * A))
    h = p * F.cos(lat) + z * F.sin(lat) - F.lit(A) * F.sqrt(F.lit(1.0) - F.lit(E2) * F.sin(lat) * F.sin(lat))
    return F.degrees(F.atan2(y, x)), F.degrees(lat), h
