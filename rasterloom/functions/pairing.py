"""Geometry of an image pair as column expressions: common crop, output grid, borders, row tiles, georeference.

An image is a struct of columns x0, y0 (outer corner), dx, dy (both positive)
and its crop c0, c1, r0, r1 (inclusive pixels).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of pixels a row tile may take: 256 MB of 32 bits each.
TILE_BITS = 256 * 8 * 1024 * 1024


def crop_axis(base0: Column, base1: Column, target0: Column, target1: Column, at_base: Column, at_target: Column, step: Column) -> Column:
    """Struct b0, b1, t0, t1: pixel ranges of one axis cut to the shared interval.

    at_*: map coordinate of pixel 0, growing with the pixel by ``step``. Offsets
    are rounded half to even.
    """
    d0 = F.bround((at_target + target0 * step - at_base - base0 * step) / step).cast("long")
    b0, t0 = base0 + F.greatest(d0, F.lit(0)), target0 - F.least(d0, F.lit(0))
    d1 = F.bround((at_target + target1 * step - at_base - base1 * step) / step).cast("long")
    b1, t1 = base1 + F.least(d1, F.lit(0)), target1 - F.greatest(d1, F.lit(0))
    return F.struct(b0.alias("b0"), b1.alias("b1"), t0.alias("t0"), t1.alias("t1"))


def crop_pixels(base0: Column, base1: Column, target0: Column, target1: Column) -> Column:
    """Struct b0, b1, t0, t1 without georeference: the longer range is cut at its end."""
    n = F.least(base1 - base0, target1 - target0)
    return F.struct(base0.alias("b0"), (base0 + n).alias("b1"), target0.alias("t0"), (target0 + n).alias("t1"))


def grid_shift(origin: Column, c0: Column, pixel: Column, step: Column, window: Column, margin: Column, up: bool = False) -> Column:
    """Pixels to skip so that the first measure lies on a multiple of step pixels. up: the axis runs against the map's."""
    half = margin + window / 2
    at = origin - (c0 + half) * pixel if up else origin + (c0 + half) * pixel
    off = F.round(F.pmod(at, step * pixel) / pixel).cast("long")
    return F.when(off % step == 0, F.lit(0).cast("long")).otherwise(off if up else step - off)


def borders(orig0: Column, orig1: Column, c0: Column, c1: Column, window: Column, margin: Column, step: Column) -> Column:
    """Struct total, before, shift, n, after: measures of the whole axis and those of the crop, with empty ones at both ends."""
    whole = F.floor((orig1 - orig0) / step) + 1
    before = F.ceil((c0 - orig0 + window / 2 + margin) / step)
    shift = (before * step - (window / 2 + margin) - (c0 - orig0)).cast("long")
    n = F.floor((c1 - c0 + 1 - window - margin * 2) / step) + 1
    return F.struct(whole.alias("total"), before.alias("before"), shift.alias("shift"), n.alias("n"), (whole - before - n).alias("after"))


def row_tiles(cols: Column, rows: Column, window: Column, step: Column) -> Column:
    """Array of (tile, row0, row1): overlapping row ranges (inclusive) that a tile's memory allows; measures don't depend on them."""
    most = F.least(F.floor(F.lit(float(TILE_BITS)) / (cols * 32)), rows)
    per = F.greatest(F.floor((most - window) / step) + 1, F.lit(1))
    total = F.greatest(F.floor((rows - window) / step) + 1, F.lit(0))
    i = F.when(total > 0, F.sequence(F.lit(0).cast("long"), F.ceil(total / per) - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(i, lambda k: F.struct(k.alias("tile"), (k * per * step).alias("row0"), ((F.least((k + 1) * per, total) - 1) * step + window - 1).alias("row1")))


def georeference(x0: Column, y0: Column, dx: Column, dy: Column, c0: Column, r0: Column, step: Column, gridded: Column, window: Column, margin: Column) -> Column:
    """Geotransform (x, dx, 0, y, 0, dy) of the measures."""
    half = F.when(gridded, margin + window / 2).otherwise(F.lit(0.0))
    return F.array(x0 + (c0 + half) * dx, dx * step, F.lit(0.0), y0 - (r0 + half) * dy, F.lit(0.0), -dy * step)


def strips(width: Column, height: Column, bytes_: int, bands: int = 3) -> Column:
    """Array of (strip, row0, rows) of an output image whose strips of 32-bit bands take at most so many bytes."""
    per = F.greatest(F.floor(F.lit(float(bytes_)) / (width * 4 * bands)), F.lit(1))
    i = F.sequence(F.lit(0).cast("long"), F.ceil(height / per) - 1)
    return F.transform(i, lambda k: F.struct(k.alias("strip"), (k * per).alias("row0"), F.least(per, height - k * per).alias("rows")))


def extent(x0: Column, y0: Column, dx: Column, dy: Column, width: Column, height: Column) -> Column:
    """Struct minx, miny, maxx, maxy of a raster; dy is the signed row step."""
    x1, y1 = x0 + width * dx, y0 + height * dy
    return F.struct(F.least(x0, x1).alias("minx"), F.least(y0, y1).alias("miny"), F.greatest(x0, x1).alias("maxx"), F.greatest(y0, y1).alias("maxy"))


def resampling_distance(step_row: Column, step_col: Column, step_diagonal: Column, kernel: Column) -> Column:
    """Pixels about a sample that a sinc kernel may need: the largest average step times kernel, 10 and 1.15, rounded up."""
    return F.ceil(F.greatest(F.abs(step_row), F.abs(step_col), F.abs(step_diagonal)) * kernel * 10 * 1.15)
