"""Rasters as tables of pixels (raster_id, band, row, col, value): windows, tiles, masks, mosaics, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def window(px: DataFrame, c0: int, c1: int, r0: int, r1: int) -> DataFrame:
    """Pixels of an inclusive window; the limits reach the scan as filters."""
    return px.filter(F.col("row").between(r0, r1) & F.col("col").between(c0, c1))


def tile_extents(width: Column, height: Column, size: int) -> Column:
    """Array of tiles (tile, c0, c1, r0, r1), rows outer, ragged at the far edges."""
    nx, ny = F.ceil(width / size).cast("int"), F.ceil(height / size).cast("int")
    i = F.sequence(F.lit(0), nx * ny - 1)
    return F.transform(i, lambda k: F.struct(k.alias("tile"), (k % nx * size).alias("c0"), F.least((k % nx + 1) * size, width).cast("int").alias("c1"), (F.floor(k / nx) * size).cast("int").alias("r0"), F.least((F.floor(k / nx) + 1) * size, height).cast("int").alias("r1")))


def valid_everywhere(px: DataFrame, bands: int, limit: float | None = None) -> DataFrame:
    """(row, col) with a value, not NaN and within the limit, in every band."""
    return valid_at_least(px, bands, limit)


def valid_at_least(px: DataFrame, least: int, limit: float | None = None) -> DataFrame:
    """(row, col) with at least so many valid values."""
    v = F.col("value")
    ok = v.isNotNull() & ~F.isnan(v) & (F.lit(True) if limit is None else F.abs(v) <= limit)
    return px.groupBy("row", "col").agg(F.count_if(ok).alias("_n")).filter(F.col("_n") >= least).drop("_n")


def mosaic(tiles: DataFrame, order: str) -> DataFrame:
    """(row, col, value): of overlapping tiles the first with a value wins; aggregated before the shuffle."""
    return tiles.filter("value IS NOT NULL").groupBy("row", "col").agg(F.min_by("value", order).alias("value"))


def stack(px: DataFrame, masked: list[float], nodata: float | None) -> DataFrame:
    """Masked values become nodata (null by default); band names join stem and number."""
    v = F.when(F.col("value").isin(masked), F.lit(nodata).cast("double")).otherwise(F.col("value")) if masked else F.col("value")
    return px.withColumn("value", v).withColumn("band_name", F.concat(F.lit("Band"), F.col("band").cast("string"), F.lit("_"), F.col("raster_id").cast("string")))


def fill_grid(px: DataFrame, rows: int, cols: int) -> DataFrame:
    """All pixels of a grid; those that ``px`` lacks are null."""
    spark = px.sparkSession
    grid = spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))
    return grid.join(px, ["row", "col"], "left")


def nearest(points: DataFrame, px: DataFrame, x: str, y: str) -> DataFrame:
    """Adds the value of the pixel nearest to fractional pixel-centre coordinates; null outside."""
    at = points.withColumns({"col": F.floor(F.col(x) + 0.5).cast("int"), "row": F.floor(F.col(y) + 0.5).cast("int")})
    return at.join(px.select("row", "col", "value"), ["row", "col"], "left").drop("row", "col")


def bilinear(points: DataFrame, px: DataFrame, key: list[str], x: str, y: str) -> DataFrame:
    """(key, value): four neighbours weighted by nearness; points that lack one of them are null.

    Each point becomes four rows that meet pixels in one equi-join, and the
    weighted sum is combined before its shuffle. A weight of 0 needs no pixel.
    """
    fx, fy = F.col(x) - F.floor(x), F.col(y) - F.floor(y)
    four = F.array(*[F.struct((F.floor(x) + i).cast("int").alias("col"), (F.floor(y) + j).cast("int").alias("row"), ((fx if i else 1 - fx) * (fy if j else 1 - fy)).alias("w")) for i in (0, 1) for j in (0, 1)])
    near = points.select(*key, F.explode(F.filter(four, lambda s: s["w"] > 0)).alias("s")).select(*key, "s.*")
    met = near.join(px.select("row", "col", "value"), ["row", "col"], "left")
    total = F.when(F.count("*") == F.count("value"), F.sum(F.col("w") * F.col("value")))
    return met.groupBy(*key).agg(total.alias("value"))


def stacked(parts: list[tuple[DataFrame, int]]) -> DataFrame:
    """Tiles one under the other: each with a number added to its rows."""
    out = None
    for px, offset in parts:
        moved = px.select((F.col("row") + offset).alias("row"), "col", "value")
        out = moved if out is None else out.unionByName(moved)
    return out


def mean_where_missing(df: DataFrame, value: str) -> DataFrame:
    """Missing values replaced by the mean of all others: one number, joined to every row."""
    mean = df.agg(F.avg(value).alias("_mean"))
    return df.crossJoin(F.broadcast(mean)).withColumn(value, F.coalesce(value, "_mean")).drop("_mean")  # a single row
