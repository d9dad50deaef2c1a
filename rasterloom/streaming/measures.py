"""Statistics of measures as they arrive, and arriving images against those known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.pairs import overlapping


def windowed_stats(stream: DataFrame, ts: str, value: str, by: list[str], every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """By time window and group: n, mean, population sigma, min, max; rows later than ``late`` are dropped by the watermark.

    Sums combine in the state, which holds a row a window and group and is
    cleared as the watermark passes.
    """
    at = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return at.groupBy(F.window(ts, every), *by).agg(F.count(value).alias("n"), F.avg(value).alias("mu"), F.stddev_pop(value).alias("sigma"), F.min(value).alias("min_v"), F.max(value).alias("max_v"))


def arriving_overlaps(stream: DataFrame, known: DataFrame, cell: float, least: float | None = None) -> DataFrame:
    """Pairs of arriving images (l_) and known ones (r_) whose boxes touch: a stream joined to a table by grid cells."""
    return overlapping(stream, known, cell, least)


def gram_updates(stream: DataFrame, pixel: list[str], t: str, value: str) -> DataFrame:
    """Running sums (t1, t2, g) of products of values by pairs of times, from arriving pixels with all their times at once (arrays of t and value)."""
    both = F.zip_with(t, value, lambda a, b: F.struct(a.alias("t"), b.alias("v")))
    pairs = stream.withColumn("_a", F.explode(both)).withColumn("_b", F.explode(both))
    return pairs.groupBy(F.col("_a.t").alias("t1"), F.col("_b.t").alias("t2")).agg(F.sum(F.col("_a.v") * F.col("_b.v")).alias("g"))
