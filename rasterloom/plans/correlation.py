"""Correlation of an image pair from checks to georeferenced displacements, and tie points by correlation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks, pairing
from ..operators.correlate import correlate, halo_tiles


@dataclass(frozen=True)
class Params:
    """method frequency or spatial; window, step and search range in pixels; gridded: measures on multiples of the step."""

    method: str = "frequency"
    window: int = 64
    step: int = 8
    search: int = 10
    gridded: bool = False
    pixel_based: bool = False

    @property
    def margin(self) -> int:
        return self.search if self.method == "spatial" else 0


@dataclass(frozen=True)
class Image:
    """Place and shape of a raster: outer corner, pixel (positive), size, projection."""

    width: int
    height: int
    x0: float = 0.0
    y0: float = 0.0
    dx: float = 1.0
    dy: float = 1.0
    epsg: int | None = None

    @property
    def valid(self) -> bool:
        return self.epsg is not None


def plan(spark: SparkSession, base: Image, target: Image, p: Params) -> dict:
    """What a correlation does: map or pixel mode, the common crop, the output's size and georeference, as one row of expressions."""
    row = spark.range(1)
    lit = lambda v: F.lit(v).cast("long")
    at = {"x": (base.x0, target.x0, base.dx, base.width, target.width), "y": (-base.y0, -target.y0, base.dy, base.height, target.height)}
    same_gsd = abs(base.dx / target.dx - 1) <= 1e-3 and abs(base.dy / target.dy - 1) <= 1e-3
    flags = checks.projection_flags(F.lit(base.valid), F.lit(target.valid), F.lit(base.epsg), F.lit(target.epsg), F.lit(True), p.pixel_based)
    fault = checks.window_fault(F.lit(p.window), F.lit(p.step), F.lit(p.method))
    crops = {a: pairing.crop_axis(lit(0), lit(nb - 1), lit(0), lit(nt - 1), F.lit(float(b)), F.lit(float(t)), F.lit(float(d))) for a, (b, t, d, nb, nt) in at.items()}
    plain = {a: pairing.crop_pixels(lit(0), lit(v[3] - 1), lit(0), lit(v[4] - 1)) for a, v in at.items()}
    got = row.select(flags.alias("f"), fault.alias("fault"), *[c.alias(a) for a, c in crops.items()], *[c.alias("p" + a) for a, c in plain.items()]).first()
    if got.fault:
        raise ValueError(got.fault)
    map_mode = got.f.map_mode and same_gsd
    x, y = (got.x, got.y) if map_mode else (got.px, got.py)
    c0, r0 = x.b0, y.b0
    if map_mode and p.gridded:
        first = row.select(pairing.grid_shift(F.lit(base.x0), lit(c0), F.lit(base.dx), lit(p.step), lit(p.window), lit(p.margin)).alias("c"), pairing.grid_shift(F.lit(base.y0), lit(r0), F.lit(base.dy), lit(p.step), lit(p.window), lit(p.margin), True).alias("r")).first()
    else:
        first = None
    dc, dr = (first.c, first.r) if first else (0, 0)
    width, height = x.b1 - x.b0 + 1 - dc, y.b1 - y.b0 + 1 - dr
    if width < p.window + 2 * p.margin or height < p.window + 2 * p.margin:
        raise ValueError("the images don't overlap by a window")
    half = p.margin + p.window / 2
    res = (base.dx, base.dy) if map_mode else (1.0, 1.0)
    corner = (base.x0 + (c0 + dc + half) * base.dx, base.y0 - (r0 + dr + half) * base.dy) if map_mode else (0.0, 0.0)
    size = lambda n: (n - p.window - 2 * p.margin) // p.step + 1
    return {
        "map_mode": map_mode, "base": (c0 + dc, r0 + dr), "target": (x.t0 + dc, y.t0 + dr), "width": width, "height": height, "cols": size(width), "rows": size(height), "res": res, "epsg": base.epsg if map_mode else 4326,
        "transform": (corner[0], res[0] * p.step, 0.0, corner[1], 0.0, -res[1] * p.step) if map_mode else (0.0, 1.0, 0.0, 0.0, 0.0, -1.0),
    }


def run(spark: SparkSession, base: DataFrame, base_image: Image, target: DataFrame, target_image: Image, p: Params, pair: int = 0) -> tuple[dict, DataFrame]:
    """The plan, and (row, col, ew, ns, snr): measures numbered from 0, displacements in map units, north positive. base, target: (row, col, value)."""
    d = plan(spark, base_image, target_image, p)

    def cropped(px: DataFrame, at: tuple[int, int], name: str) -> DataFrame:
        c, r = at
        inside = F.col("col").between(c, c + d["width"] - 1) & F.col("row").between(r, r + d["height"] - 1)
        return px.filter(inside).select((F.col("row") - r).cast("int").alias("row"), (F.col("col") - c).cast("int").alias("col"), F.coalesce("value", F.lit(0.0)).alias(name))

    both = cropped(base, d["base"], "base").join(cropped(target, d["target"], "target"), ["row", "col"]).withColumn("pair_id", F.lit(pair).cast("long"))
    size = -(-max(p.window, 128) // p.step) * p.step
    tiles = halo_tiles(both, size, p.margin, p.window - p.step)
    found = correlate(tiles, p.method, p.window, p.step, p.search)
    at = lambda c: F.floor((F.col(c) - p.margin) / p.step).cast("int")
    out = found.select(at("row").alias("row"), at("col").alias("col"), (F.col("dx") * d["res"][0]).alias("ew"), (-F.col("dy") * d["res"][1]).alias("ns"), "snr")
    return d, out.dropDuplicates(["row", "col"])


def with_borders(found: DataFrame, rows: int, cols: int, before: tuple[int, int]) -> DataFrame:
    """Measures on the grid of the whole base image; those that the crop and the windows leave out are null."""
    from ..operators.raster import fill_grid

    r, c = before
    moved = found.withColumns({"row": F.col("row") + r, "col": F.col("col") + c})
    return fill_grid(moved, rows, cols)


def tie_points(base: DataFrame, target: DataFrame, window: int = 32, step: int = 32, search: int = 12, snr: float = 0.9) -> DataFrame:
    """(ref_x, ref_y, raw_x, raw_y, snr): centres of the windows of two overlapping images of one scale that match well.

    A detector by correlation: images that differ in scale or turn by more
    than a few degrees need points from elsewhere.
    """
    both = base.select("row", "col", F.col("value").alias("base")).join(target.select("row", "col", F.col("value").alias("target")), ["row", "col"]).withColumn("pair_id", F.lit(0).cast("long"))
    found = correlate(halo_tiles(both, -(-128 // step) * step, search, max(0, window - step)), "spatial", window, step, search).dropDuplicates(["row", "col"])
    x, y = F.col("col") + (window - 1) / 2, F.col("row") + (window - 1) / 2
    return found.filter(F.col("snr") >= snr).select(x.alias("ref_x"), y.alias("ref_y"), (x + F.col("dx")).alias("raw_x"), (y + F.col("dy")).alias("raw_y"), "snr")
