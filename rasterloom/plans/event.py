"""An event's study from its image catalogue: pairs, correlation jobs, sets and 3-D combinations as tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import batch, pairs
from ..operators.sequences import latest
from ..sources.text_tables import correlation_name


@dataclass(frozen=True)
class Study:
    """pre and post: images by side. jobs: correlations to run. sets: pre pairs with post pairs. combos: ordered triples of products."""

    pre: DataFrame
    post: DataFrame
    jobs: DataFrame
    sets: DataFrame
    combos: DataFrame


def catalogue(images: DataFrame, event: str) -> DataFrame:
    """Named images (name, date, minx, miny, maxx, maxy), the first of each name in falling order of all columns, with their side of the event."""
    ordered = [F.col(c).desc() for c in images.columns]
    return batch.split_by_date(latest(images.filter("name IS NOT NULL"), ["name"], ordered), "name", "date", event)


def study(images: DataFrame, event: str, cell: float, least: float | None = None, both_ways: bool = False, method: str = "frequency", window: int = 64, step: int = 8) -> Study:
    """cell: about the size of a footprint. least: percent that two footprints share at least. Jobs have the name of their product."""
    c = catalogue(images, event).withColumnRenamed("name", "id")
    pre, post = (c.filter(F.col("side") == s).drop("side") for s in ("pre", "post"))
    met = pairs.overlapping(pre, post, cell, least)
    jobs = pairs.correlation_jobs(met.select(F.col("l_id").alias("b"), F.col("r_id").alias("t")), "b", "t", both_ways)
    jobs = jobs.withColumn("product", correlation_name(F.col("base"), F.col("target"), method, window, step))

    def within(d: DataFrame) -> DataFrame:
        m = pairs.overlapping(d, d, cell, least).filter("l_id < r_id")
        return m.select(F.col("l_id").alias("i"), F.col("r_id").alias("j"), *[f("l_" + k, "r_" + k).alias(k) for k, f in (("minx", F.greatest), ("miny", F.greatest), ("maxx", F.least), ("maxy", F.least))]).filter("minx < maxx AND miny < maxy")

    sets = batch.pair_sets(within(pre), within(post), cell, least)
    four = [F.struct(F.col(a).alias("i0"), F.col(b).alias("i1"), F.col(x).alias("i2"), F.col(y).alias("i3")) for (a, b), (x, y) in ((("pre_i", "pre_j"), ("post_i", "post_j")), (("pre_j", "pre_i"), ("post_i", "post_j")), (("post_i", "post_j"), ("pre_i", "pre_j")), (("post_j", "post_i"), ("pre_i", "pre_j")))]
    combos = sets.select("pre_i", "pre_j", "post_i", "post_j", F.inline(F.array(*four)))
    return Study(pre, post, jobs, sets, combos)
