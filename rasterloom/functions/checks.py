"""Predicates and decisions on image pairs, patches, sensors and parameters, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sensor names by the builder that makes their model.
SENSORS = {
    "spot15": ["Spot1", "Spot2", "Spot3", "Spot4", "Spot5"],
    "spot67": ["Spot6", "Spot7"],
    "dg": ["WV1", "WV2", "WV3", "WV4", "GE", "QB"],
}
RESAMPLERS, CORRELATORS = ("sinc", "bilinear"), ("frequency", "spatial")


def projection_flags(valid1: Column, valid2: Column, epsg1: Column, epsg2: Column, overlap: Column, pixel_based: bool = False) -> Column:
    """Struct: are both georeferenced, in one projection, do they overlap; map_mode if all hold and no pixel mode is asked for."""
    maps = valid1 & valid2 & F.lit(not pixel_based)
    same = F.coalesce(epsg1 == epsg2, F.lit(False))
    return F.struct(maps.alias("valid_maps"), same.alias("same_projection"), overlap.alias("overlap"), (maps & same & overlap).alias("map_mode"))


def map_resolution(map_mode: Column, pixel: Column) -> Column:
    """The pixel's size in map mode, else 1."""
    return F.when(map_mode, F.abs(pixel)).otherwise(F.lit(1.0))


def any_missing(*values: Column) -> Column:
    """Is one of the values null or NaN?"""
    out = F.lit(False)
    for v in values:
        out = out | v.isNull() | F.coalesce(F.isnan(v), F.lit(False))
    return out


def vector_missing(v: Column) -> Column:
    """Has an array a null or NaN? A null array has."""
    return F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x)), F.lit(True))


def patch_window(x: Column, y: Column, width: Column, height: Column, size: int, tol: float = 1e-3) -> Column:
    """Struct c0, c1, r0, r1 (inclusive) of a window about a pixel and its sub-pixel shift dx, dy; null if it leaves the image."""
    c0, r0 = F.floor(x) - size // 2, F.floor(y) - size // 2
    inside = (c0 >= 0) & (r0 >= 0) & (c0 + size <= width) & (r0 + size <= height)
    part = lambda v: F.when(v - F.floor(v) > tol, v - F.floor(v)).otherwise(F.lit(0.0))
    s = F.struct(c0.alias("c0"), (c0 + size - 1).alias("c1"), r0.alias("r0"), (r0 + size - 1).alias("r1"), part(x).alias("dx"), part(y).alias("dy"))
    return F.when(inside, s)


def subset_extent(lo: Column, hi: Column, size: Column, margin: int) -> Column:
    """Struct lo, hi of floor(lo) - margin to ceil(hi) + margin, clamped to an axis of ``size`` pixels; null if nothing is left."""
    a, b = F.greatest(F.floor(lo) - margin, F.lit(0)), F.least(F.ceil(hi) + margin, size - 1)
    return F.when(a <= b, F.struct(a.alias("lo"), b.alias("hi")))


def box_inside(lo: Column, hi: Column, size: Column, margin: int) -> Column:
    """Is an interval with its margin inside an axis of ``size`` pixels?"""
    return (F.floor(lo) - margin >= 0) & (F.ceil(hi) + margin <= size - 1)


def subset_of_bounds(lo: Column, hi: Column, origin: Column, pixel: Column, size: Column, margin: int) -> Column:
    """Struct lo, hi: pixels of an axis that map bounds with a margin cover, clamped to it; null if they lie beside it. pixel: the signed step."""
    a, b = (lo - origin) / pixel, (hi - origin) / pixel
    return subset_extent(F.least(a, b), F.greatest(a, b), size, margin)


def builder(sensor: Column) -> Column:
    """The model builder of a sensor, null if there is none."""
    out = F.lit(None).cast("string")
    for name, sensors in SENSORS.items():
        out = F.when(F.lower(sensor).isin([s.lower() for s in sensors]), F.lit(name)).otherwise(out)
    return out


def resampler(name: Column, kernel: Column) -> Column:
    """Struct method, kernel: an unknown method is sinc, a kernel that is even or below 1 is 15."""
    low = F.lower(name)
    return F.struct(F.when(low.isin(*RESAMPLERS), low).otherwise(F.lit("sinc")).alias("method"), F.when((kernel > 0) & (kernel % 2 == 1), kernel).otherwise(F.lit(15)).alias("kernel"))


def window_fault(window: Column, step: Column, method: Column) -> Column:
    """Why a correlation's parameters can't be used, or null."""
    power = (window > 0) & (window.bitwiseAND(window - 1) == 0)
    return (
        F.when(~F.lower(method).isin(*CORRELATORS), F.lit("unknown method"))
        .when(window <= 0, F.lit("window not positive"))
        .when((F.lower(method) == "frequency") & ~power, F.lit("window not a power of two"))
        .when(step <= 0, F.lit("step not positive"))
    )


def updated(value: Column, shift: Column, snr: Column) -> Column:
    """value - shift where the shift was measured (snr not 0, shift not missing), else the value."""
    return F.when((snr != 0) & ~any_missing(shift), value - shift).otherwise(value)


def margins(method: Column, window: Column, search: Column) -> Column:
    """Pixels that a correlation loses at each border: half the window, or the search range of the spatial one."""
    return F.when(F.lower(method) == "spatial", search).otherwise(F.floor(window / 2)).cast("long")


def output_size(n: Column, window: Column, margin: Column, step: Column) -> Column:
    """Measures along an axis of n pixels; 0 if no window fits."""
    return F.greatest(F.floor((n - (window + margin * 2)) / step) + 1, F.lit(0))
