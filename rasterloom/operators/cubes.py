"""Cubes of pixels in time (row, col, t, value): masks, compaction, objectives, successive values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def compact(mask: DataFrame) -> DataFrame:
    """(row, col, i): row-major number of each pixel of a mask.

    Counts by row, as many as the image has rows, are summed in one window;
    numbers inside a row need only that row.
    """
    rows = mask.groupBy("row").agg(F.count("*").alias("n"))
    before = rows.select("row", (F.sum("n").over(Window.orderBy("row")) - F.col("n")).alias("_b"))
    at = F.row_number().over(Window.partitionBy("row").orderBy("col")) - 1
    return mask.withColumn("i", at).join(before, "row").select("row", "col", (F.col("i") + F.col("_b")).cast("long").alias("i"))


def expand(vector: DataFrame, places: DataFrame, rows: int, cols: int) -> DataFrame:
    """A vector (i, value) back on its grid by the places of ``compact``; null elsewhere."""
    spark = vector.sparkSession
    grid = spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))
    return grid.join(places.join(vector, "i").drop("i"), ["row", "col"], "left")


def flatten(px: DataFrame, times: list[int]) -> DataFrame:
    """(row, col, values): the cube's pixels as arrays over the given times."""
    at = {t: i for i, t in enumerate(times)}
    found = px.filter(F.col("t").isin(times)).groupBy("row", "col").agg(F.map_from_entries(F.collect_list(F.struct("t", "value"))).alias("m"))  # at most one entry a time
    return found.select("row", "col", F.array(*[F.col("m")[t] for t in at]).alias("values"))


def unflatten(flat: DataFrame, times: list[int]) -> DataFrame:
    """(row, col, t, value) from arrays over times."""
    names = F.array(*[F.lit(t) for t in times])
    return flat.select("row", "col", F.posexplode("values").alias("_i", "value")).select("row", "col", F.element_at(names, F.col("_i") + 1).alias("t"), "value")


def chi2(px: DataFrame, value: Column, model: Column, weight: Column, by: list[str]) -> DataFrame:
    """By group: sum of weighted squared residuals, and that over the number of values; missing values don't count."""
    r = model - value
    s, n = F.sum(weight * r * r), F.count(value)
    return px.groupBy(*by).agg(s.alias("chi2"), F.when(n > 0, s / n).alias("chi2_norm"))


def filled(px: DataFrame, by: list[str]) -> DataFrame:
    """Missing values replaced by the mean of their group, or 0 if it has none."""
    return px.withColumn("value", F.coalesce("value", F.avg("value").over(Window.partitionBy(*by)), F.lit(0.0)))


def successive_ratio(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Adds ``diff``, the next value less this one, and ``ratio``, the size of that change over this value squared, of squared values."""
    after = F.lead(value).over(Window.partitionBy(*by).orderBy(order))
    v2 = F.col(value) * F.col(value)
    return df.withColumns({"diff": after - F.col(value), "ratio": F.when(v2 != 0, F.abs(v2 - after * after) / v2)})


def band_mean(px: DataFrame, by: list[str]) -> DataFrame:
    """Mean over the bands of each component's pixels."""
    return px.groupBy(*by).agg(F.avg("value").alias("value"))


def bounding_box(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*by).agg(F.min(x).alias("minx"), F.min(y).alias("miny"), F.max(x).alias("maxx"), F.max(y).alias("maxy"))


def equalised(px: DataFrame, bins: int = 256) -> DataFrame:
    """(row, col, value): histogram equalisation, the share of pixels in bins up to a pixel's own. Bins go between min and max, the last closed.

    Counts by bin are combined before the shuffle, and the sums are over the
    bins alone.
    """
    lim = px.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    b = F.least(F.floor((F.col("value") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0) * bins), F.lit(bins - 1)).cast("int")
    dealt = px.filter("value IS NOT NULL").crossJoin(F.broadcast(lim)).withColumn("b", b).drop("lo", "hi")  # one row
    n = dealt.groupBy("b").agg(F.count("*").alias("n"))
    cdf = n.select("b", (F.sum("n").over(Window.orderBy("b")) / F.sum("n").over(Window.partitionBy())).alias("v"))  # a row a bin
    return dealt.join(F.broadcast(cdf), "b").select("row", "col", F.col("v").alias("value"))


def composite(px: DataFrame, red: int, green: int, blue: int) -> DataFrame:
    """(row, col, r, g, b) from three bands; pixels that a band lacks are null there."""
    pick = lambda n: F.max(F.when(F.col("band") == n, F.col("value")))
    return px.filter(F.col("band").isin(red, green, blue)).groupBy("row", "col").agg(pick(red).alias("r"), pick(green).alias("g"), pick(blue).alias("b"))


def neighbourhood(points: DataFrame, px: DataFrame, key: list[str], x: str, y: str, reach: int, rows: int, cols: int) -> DataFrame:
    """(key, row, col, value): the pixels at most ``reach`` from each point's pixel, as far as the image goes."""
    around = lambda c, n: F.explode(F.sequence(F.greatest(F.floor(c) - reach, F.lit(0)), F.least(F.floor(c) + reach, F.lit(n - 1))))
    inside = (F.col(x) >= -reach) & (F.col(x) < cols + reach) & (F.col(y) >= -reach) & (F.col(y) < rows + reach)
    at = points.filter(inside).select(*key, x, around(F.col(y), rows).alias("row")).select(*key, "row", around(F.col(x), cols).alias("col"))
    at = at.select(*key, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"))
    return at.join(px.select("row", "col", "value"), ["row", "col"]).select(*key, "row", "col", "value")

