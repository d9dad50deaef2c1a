"""Ground control points: from tie points, their patches, updates, and the refinement loop."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import checks, geodesy
from ..kernels.pushbroom import Sensor
from .ortho import with_elevation
from .pairs import merge_update
from .sensors import refinement
from .stats import best_loop, loop_report

COLUMNS = ["gcp_id", "lon", "lat", "alt", "xPix", "yPix", "weight", "opti", "dE", "dN", "dA", "x_map", "y_map", "epsg"]


def from_tie_points(tps: DataFrame, transform: tuple[float, ...], epsg: int, dem: tuple[DataFrame, tuple, int] | None = None) -> DataFrame:
    """Points (ref_x, ref_y, raw_x, raw_y) in a georeferenced image and a raw one as control points.

    Map coordinates are those of the pixel's outer corner plus its place; heights
    are 0 without an elevation raster or off it. Ids are hashes of the point.
    """
    x0, dx, _, y0, _, dy = transform
    x, y = F.lit(x0) + F.col("ref_x") * dx, F.lit(y0) + F.col("ref_y") * dy
    at = tps.select(F.sha2(F.concat_ws("|", "ref_x", "ref_y", "raw_x", "raw_y"), 256).alias("gcp_id"), x.alias("x_map"), y.alias("y_map"), F.col("raw_x").alias("xPix"), F.col("raw_y").alias("yPix"))
    lon, lat = geodesy.from_utm(F.col("x_map"), F.col("y_map"), F.lit(epsg % 100), F.lit(epsg < 32700)) if epsg != 4326 else (F.col("x_map"), F.col("y_map"))
    at = at.withColumns({"lon": lon, "lat": lat})
    at = with_elevation(at, *dem, ["gcp_id"]).withColumn("alt", F.coalesce("height", F.lit(0.0))) if dem else at.withColumn("alt", F.lit(0.0))
    ones, zeros = {c: F.lit(1.0) for c in ("weight", "opti")}, {c: F.lit(0.0) for c in ("dE", "dN", "dA")}
    return at.withColumns(ones | zeros | {"epsg": F.lit(epsg)}).select(*COLUMNS)


def patches(gcps: DataFrame, transform: tuple[float, ...], width: int, height: int, size: int) -> DataFrame:
    """Points with the window of the reference image about them (null if it leaves the image): columns, rows and sub-pixel shift."""
    x0, dx, _, y0, _, dy = transform
    w = checks.patch_window((F.col("x_map") - x0) / dx, (F.col("y_map") - y0) / dy, F.lit(width), F.lit(height), size)
    return gcps.withColumn("patch", w)


def moved(gcps: DataFrame, shifts: DataFrame, gsd: float) -> DataFrame:
    """Points with map coordinates changed by measured shifts (gcp_id, dx, dy in pixels, snr); their weight is the snr.

    Points whose shift has an snr of 0 or is missing stay in place.
    """
    x, y = checks.updated(F.col("x_map"), F.col("dx") * gsd, F.col("snr")), checks.updated(F.col("y_map"), -F.col("dy") * gsd, F.col("snr"))
    new = gcps.join(shifts, "gcp_id").select("gcp_id", x.alias("x_map"), y.alias("y_map"), F.col("snr").alias("weight"), "epsg")
    lon, lat = geodesy.from_utm(F.col("x_map"), F.col("y_map"), F.col("epsg") % 100, F.col("epsg") < 32700)
    return merge_update(gcps, new.select("gcp_id", "x_map", "y_map", "weight", lon.alias("lon"), lat.alias("lat")), "gcp_id", ["x_map", "y_map", "weight", "lon", "lat"])


def refine(gcps: DataFrame, lines: DataFrame, cols: DataFrame, model: str, measure: Callable[[DataFrame, np.ndarray, int], DataFrame], gsd: float, loops: int = 3, snr_th: float = 0.9) -> tuple[np.ndarray, DataFrame, DataFrame]:
    """(correction of the best loop, points, report by loop).

    A loop fits the model's correction to the points, measures with it the
    shift of each point's patch (``measure``: points, correction, loop to
    gcp_id, dx, dy, snr), and moves the points by it. Tables are cut with a
    checkpoint where the session has a folder for them.
    """
    sc = gcps.sparkSession.sparkContext
    cut = (lambda d: d.checkpoint()) if sc.getCheckpointDir() else (lambda d: d)
    found, seen, now = {}, None, gcps
    for loop in range(loops):
        named = now.withColumns({"model": F.lit(model), "xpix": F.col("xPix"), "ypix": F.col("yPix")})
        keep = ["model", "gcp_id", "lon", "lat", "alt", "weight"]
        row = refinement(named.select(*keep, F.col("xPix").alias("xpix"), F.col("yPix").alias("ypix")), lines, cols).first()
        found[loop] = np.array(row.correction, float).reshape(3, 3)
        shifts = cut(measure(now, found[loop], loop))
        seen = shifts.withColumn("loop", F.lit(loop)) if seen is None else seen.unionByName(shifts.withColumn("loop", F.lit(loop)))
        now = cut(moved(now, shifts, gsd))
    report = loop_report(seen, "loop", "dx", "dy", "snr", snr_th)
    best = best_loop(report).first()
    return found[best[0]], now, report


def rsm_shifts(gcps: DataFrame, m: Sensor, correction: np.ndarray, loop: int) -> DataFrame:
    """Shifts of points as the corrected model sees them: pixels between where it projects a point and where the point was picked."""
    from .sensors import to_pixel

    at = to_pixel(gcps, m, correction=correction)
    return at.select("gcp_id", (F.col("col") - F.col("xPix")).alias("dx"), (F.col("line") - F.col("yPix")).alias("dy"), F.when(F.col("col").isNotNull(), F.lit(1.0)).otherwise(0.0).alias("snr"))


def patch_grids(gcps: DataFrame, size: int, res: float) -> DataFrame:
    """(gcp_id, row, col, east, north, lon, lat, alt): the pixels' centres of a square patch of the map about each point."""
    i = F.sequence(F.lit(0), F.lit(size - 1))
    at = gcps.select("gcp_id", "x_map", "y_map", "alt", "epsg", F.explode(i).alias("row")).select("*", F.explode(i).alias("col"))
    at = at.withColumns({"east": F.col("x_map") + (F.col("col") - (size - 1) / 2) * res, "north": F.col("y_map") - (F.col("row") - (size - 1) / 2) * res})
    lon, lat = geodesy.from_utm(F.col("east"), F.col("north"), F.col("epsg") % 100, F.col("epsg") < 32700)
    return at.select("gcp_id", "row", "col", "east", "north", lon.alias("lon"), lat.alias("lat"), "alt")


def patch_orthos(gcps: DataFrame, m: Sensor, raw: DataFrame, size: int, res: float, correction: np.ndarray | None = None) -> DataFrame:
    """(gcp_id, row, col, value): patches of the raw image rectified by its model at the points' heights."""
    from .raster import bilinear
    from .sensors import to_pixel

    at = patch_grids(gcps, size, res).withColumnsRenamed({"row": "r", "col": "c"})
    placed = to_pixel(at, m, correction=correction)
    got = bilinear(placed.filter("col IS NOT NULL").select("gcp_id", "r", "c", F.col("col").alias("x"), F.col("line").alias("y")), raw, ["gcp_id", "r", "c"], "x", "y")
    return got.select("gcp_id", F.col("r").alias("row"), F.col("c").alias("col"), "value")


def reference_patches(gcps: DataFrame, ref: DataFrame, transform: tuple[float, ...], size: int, res: float) -> DataFrame:
    """(gcp_id, row, col, value): the same patches of the georeferenced image."""
    from .raster import bilinear

    x0, dx, _, y0, _, dy = transform
    at = patch_grids(gcps, size, res).select("gcp_id", F.col("row").alias("r"), F.col("col").alias("c"), ((F.col("east") - x0) / dx - 0.5).alias("x"), ((F.col("north") - y0) / dy - 0.5).alias("y"))
    return bilinear(at, ref, ["gcp_id", "r", "c"], "x", "y").select("gcp_id", F.col("r").alias("row"), F.col("c").alias("col"), "value")


def patch_shifts(gcps: DataFrame, m: Sensor, correction: np.ndarray | None, raw: DataFrame, ref: DataFrame, transform: tuple[float, ...], window: int, res: float) -> DataFrame:
    """(gcp_id, dx, dy, snr): shift of each point's raw patch against the reference, by correlation of windows; points whose patch has a hole have an snr of 0."""
    from .correlate import correlate

    base, target = (d.withColumnRenamed("value", n) for d, n in ((reference_patches(gcps, ref, transform, window, res), "base"), (patch_orthos(gcps, m, raw, window, res, correction), "target")))
    both = base.join(target, ["gcp_id", "row", "col"]).filter("base IS NOT NULL AND target IS NOT NULL")
    held = both.groupBy("gcp_id").agg(F.sort_array(F.collect_list(F.struct("row", "col", "base", "target"))).alias("p")).filter(F.size("p") == window * window)  # a window of pixels
    tiles = held.select(F.xxhash64("gcp_id").alias("pair_id"), F.lit(0).alias("row0"), F.lit(0).alias("col0"), F.lit(window).alias("height"), F.col("p.base").alias("base"), F.col("p.target").alias("target"))
    found = correlate(tiles, "frequency", window, window).select("pair_id", "dx", "dy", "snr")
    named = gcps.select("gcp_id", F.xxhash64("gcp_id").alias("pair_id")).join(found, "pair_id", "left")
    return named.select("gcp_id", "dx", "dy", F.coalesce("snr", F.lit(0.0)).alias("snr"))
