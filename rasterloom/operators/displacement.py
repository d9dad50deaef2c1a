"""3-D displacement from four images: lines of sight, triangulation before and after, difference in map coordinates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geodesy, vectors
from ..kernels import bspline
from .sensors import _mapped

NAMES = ("base", "pre", "post1", "post2")


def with_positions(df: DataFrame, line: str, positions: np.ndarray, prefix: str) -> DataFrame:
    """Adds the satellite's position at a fractional line (prefix x, y, z): cubic splines through its lines, in every task."""
    shared = df.sparkSession.sparkContext.broadcast(positions)  # three numbers a line
    at = np.arange(len(positions))

    def of(lines: np.ndarray) -> list[np.ndarray]:
        out = np.full((len(lines), 3), np.nan)
        ok = np.isfinite(lines)
        if ok.any():
            lo, hi = max(0, int(lines[ok].min()) - 8), min(len(at), int(lines[ok].max()) + 9)
            lo, hi = (max(0, len(at) - 4), len(at)) if hi - lo < 4 else (lo, hi)
            out[ok] = bspline.interpolate(at[lo:hi], shared.value[lo:hi], lines[ok], 3)
        return list(out.T)

    return _mapped(df, [line], [f"{prefix}{c}" for c in "xyz"], of)


def line_of_sight(lon: Column, lat: Column, alt: Column, position: vectors.Vec) -> tuple[vectors.Vec, vectors.Vec]:
    """A ground point in earth-centred coordinates, and the way from it to the satellite."""
    p = geodesy.to_ecef(lon, lat, alt)
    return p, tuple(s - x for s, x in zip(position, p, strict=True))


def displacement(df: DataFrame, positions: list[np.ndarray], epsg: int, inverted: bool = False) -> DataFrame:
    """(row, col, ew, ns, dz, gap_pre, gap_post) of pixels.

    df: row, col; x, y (map coordinates of the base pixel's centre); ew_i, ns_i
    for i of pre, post1, post2 (displacements from the base); h_i and line_i for
    all four images (heights of their points, and lines of the raw images).
    positions: of the four satellites by line. ``inverted``: the base was taken
    after the event. A missing value anywhere gives nulls. gap: distance of the
    two rays.
    """
    zone, north = F.lit(epsg % 100), F.lit(epsg < 32700)
    names = [(n, p) for n, p in zip(NAMES, positions, strict=True)]
    now = df
    for n, p in names:
        now = with_positions(now, f"line_{n}", p, f"_{n}_")
    points, sights = {}, {}
    for n, _ in names:
        x = F.col("x") + (F.col(f"ew_{n}") if n != "base" else 0.0)
        y = F.col("y") + (F.col(f"ns_{n}") if n != "base" else 0.0)
        lon, lat = geodesy.from_utm(x, y, zone, north)
        now = now.withColumns({f"_lon_{n}": lon, f"_lat_{n}": lat})
        points[n], sights[n] = line_of_sight(F.col(f"_lon_{n}"), F.col(f"_lat_{n}"), F.col(f"h_{n}"), tuple(F.col(f"_{n}_{c}") for c in "xyz"))
    mids = {}
    for when, (a, b) in {"pre": ("base", "pre"), "post": ("post1", "post2")}.items():
        mid, gap = vectors.triangulate(points[a], sights[a], points[b], sights[b])
        mids[when] = [f"_{when}_mx", f"_{when}_my", f"_{when}_mz"]
        now = now.withColumns(dict(zip([*mids[when], f"gap_{when}"], [*mid, gap], strict=True)))
    at = {}
    for when, cols in mids.items():
        lon, lat, alt = geodesy.from_ecef(*map(F.col, cols))
        now = now.withColumns({f"_{when}_lon": lon, f"_{when}_lat": lat, f"_{when}_alt": alt})
        e, n = geodesy.to_utm(F.col(f"_{when}_lon"), F.col(f"_{when}_lat"), zone, north)
        at[when] = (e, n, F.col(f"_{when}_alt"))
    sign = -1.0 if inverted else 1.0
    ew, ns, dz = (b - a for a, b in zip(at["pre"], at["post"], strict=True))
    return now.select("row", "col", (ew * sign).alias("ew"), (-ns).alias("ns"), (dz * sign).alias("dz"), "gap_pre", "gap_post")


def combination(maps: dict[str, DataFrame], transform: tuple[float, ...], elevation, lines: dict[str, DataFrame]) -> DataFrame:
    """The table that ``displacement`` takes: three maps (row, col, ew, ns) of one shape joined by pixel.

    elevation: adds a column height to a table with x, y. lines: by image
    (row, col, line) of the raw image under each map pixel; a point off its
    pixel takes the line there, changed by nothing, as lines vary slowly.
    """
    x0, dx, _, y0, _, dy = transform
    out = None
    for n in NAMES[1:]:
        m = maps[n].select("row", "col", F.col("ew").alias(f"ew_{n}"), F.col("ns").alias(f"ns_{n}"))
        out = m if out is None else out.join(m, ["row", "col"])
    out = out.withColumns({"x": F.lit(x0) + (F.col("col") + 0.5) * dx, "y": F.lit(y0) + (F.col("row") + 0.5) * dy})
    for n in NAMES:
        out = out.join(lines[n].select("row", "col", F.col("line").alias(f"line_{n}")), ["row", "col"])
        moved = out.withColumns({"_x": F.col("x"), "_y": F.col("y")}) if n == "base" else out.withColumns({"_x": F.col("x") + F.col(f"ew_{n}"), "_y": F.col("y") + F.col(f"ns_{n}")})
        out = elevation(moved).withColumnRenamed("height", f"h_{n}").drop("_x", "_y")
    return out
