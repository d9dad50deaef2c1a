"""Ordered sequences by key: smoothing, integration, bracketing and interpolation, sampling."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def smooth3(df: DataFrame, key: str, t: str, v: str) -> DataFrame:
    """Adds ``smooth``: 1/6, 2/3, 1/6 over neighbours; end points stay."""
    w = Window.partitionBy(key).orderBy(t)
    a, b = F.lag(v).over(w), F.lead(v).over(w)
    return df.withColumn("smooth", F.coalesce(a / 6 + F.col(v) * (2 / 3) + b / 6, F.col(v)))


def integrate(df: DataFrame, key: str, t: str, rate: str, start: float = 0.0) -> DataFrame:
    """Adds ``integral``: start plus the running sum of rate times the step to it."""
    w = Window.partitionBy(key).orderBy(t)
    step = df.withColumn("_step", F.coalesce(F.col(rate) * (F.col(t) - F.lag(t).over(w)), F.lit(0.0)))
    return step.withColumn("integral", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.lit(start)).drop("_step")


def bracket(points: DataFrame, samples: DataFrame, key: str, t: str, v: str) -> DataFrame:
    """Each point (key, t) with the samples around it: t0, v0, t1, v1.

    A point before the first sample takes the first pair, one after the last
    the last pair; keys with fewer than two samples give nulls. One sort by
    key and time of both tables, no join of ranges.
    """
    w = Window.partitionBy(key).orderBy(t)
    seg = samples.select(key, t, v).withColumns({"t1": F.lead(t).over(w), "v1": F.lead(v).over(w)}).filter("t1 IS NOT NULL")
    s = F.struct(F.col(t).alias("t0"), F.col(v).alias("v0"), "t1", "v1")
    both = seg.select(key, F.col(t).alias("_t"), F.lit(0).alias("_p"), s.alias("_s")).unionByName(points.select(key, F.col(t).alias("_t"), F.lit(1).alias("_p")).withColumn("_s", F.lit(None).cast(seg.select(s.alias("s")).schema["s"].dataType)))
    order = Window.partitionBy(key).orderBy("_t", "_p")
    last = F.last("_s", True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    first = F.min_by("_s", F.when(F.col("_p") == 0, F.col("_t"))).over(Window.partitionBy(key))  # the key's first pair
    return both.withColumn("_b", F.coalesce(last, first)).filter("_p = 1").select(key, F.col("_t").alias(t), "_b.*")


def interpolate(points: DataFrame, samples: DataFrame, key: str, t: str, v: str) -> DataFrame:
    """(key, t, v) on the line through the bracketing samples, carried on beyond the ends."""
    b = bracket(points, samples, key, t, v)
    return b.select(key, t, (F.col("v0") + F.try_divide((F.col("v1") - F.col("v0")) * (F.col(t) - F.col("t0")), F.col("t1") - F.col("t0"))).alias(v))


def trim(df: DataFrame, key: str, t: str, lo, hi, keep: int = 4) -> DataFrame:
    """Samples from lo to hi, with the ``keep`` last ones before and the ``keep`` first after."""
    side = F.when(F.col(t) < lo, -1).when(F.col(t) > hi, 1).otherwise(0)
    dealt = df.withColumn("_side", side)
    near = Window.partitionBy(key, "_side").orderBy(F.when(F.col("_side") < 0, -F.col(t)).otherwise(F.col(t)))
    return dealt.withColumn("_r", F.row_number().over(near)).filter((F.col("_side") == 0) | (F.col("_r") <= keep)).drop("_side", "_r")


def direction(df: DataFrame, key: str, t: str, v: str, tol: float = 1e-9) -> DataFrame:
    """(key, direction): 1 rising, -1 falling, 0 neither or fewer than two rows."""
    w = Window.partitionBy(key).orderBy(t)
    d = df.withColumn("_d", F.lead(v).over(w) - F.col(v)).groupBy(key)
    up, down = F.bool_and(F.col("_d") > -tol) & F.bool_or(F.col("_d") > tol), F.bool_and(F.col("_d") < tol) & F.bool_or(F.col("_d") < -tol)
    return d.agg(F.when(up, 1).when(down, -1).otherwise(0).alias("direction"))


def every_kth(df: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """Rows 0, k, 2k, ... of each key, k the whole part of rows / most; all rows if k is 1 or less."""
    w = Window.partitionBy(key)
    k = F.greatest(F.floor(F.count("*").over(w) / most), F.lit(1))
    return df.withColumns({"_r": F.row_number().over(w.orderBy(*order)) - 1, "_k": k}).filter("_r % _k = 0").drop("_r", "_k")


def latest(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_r = 1").drop("_r")


def pad_ends(df: DataFrame, key: str, t: str, v: str, lo: float, hi: float, step: float = 1e-3) -> DataFrame:
    """Adds a sample a step outside [lo, hi] where a key's samples begin after lo or end before hi, with the mean of its two nearest values."""
    a, b = Window.partitionBy(key).orderBy(F.col(t)), Window.partitionBy(key).orderBy(F.col(t).desc())
    ends = df.select(key, t, v).withColumns({"_a": F.row_number().over(a), "_b": F.row_number().over(b)}).filter("_a <= 2 OR _b <= 2")
    sums = ends.groupBy(key).agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"), F.avg(F.when(F.col("_a") <= 2, F.col(v))).alias("_va"), F.avg(F.when(F.col("_b") <= 2, F.col(v))).alias("_vb"))
    first = sums.filter(F.col("_lo") > lo).select(key, F.lit(lo - step).alias(t), F.col("_va").alias(v))
    last = sums.filter(F.col("_hi") < hi).select(key, F.lit(hi + step).alias(t), F.col("_vb").alias(v))
    return df.select(key, t, v).unionByName(first).unionByName(last)


def lagrange(points: DataFrame, samples: DataFrame, key: str, t: str, v: str, most: int = 16) -> DataFrame:
    """(key, t, v) by the polynomial through all samples of the key; meant for the eight that ``trim`` leaves. A key with more than ``most`` is an error."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(t))
    several = F.when(place <= most, F.col(v)).otherwise(F.raise_error(F.lit("too many samples for a polynomial")).cast("double"))
    nodes = samples.withColumn(v, several).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(t).alias("t"), F.col(v).alias("v")))).alias("_n"))
    basis = lambda x: lambda p: F.aggregate(F.filter("_n", lambda q: q["t"] != p["t"]), p["v"].cast("double"), lambda acc, q: acc * (x - q["t"]) / (p["t"] - q["t"]))
    return points.join(nodes, key).select(key, t, F.aggregate(F.transform("_n", basis(F.col(t))), F.lit(0.0), lambda acc, x: acc + x).alias(v))


def repair(df: DataFrame, key: str, t: str, v: str, bad: str) -> DataFrame:
    """(key, t, v): flagged values replaced by linear interpolation between the nearest valid ones, the end values beyond them, 0 if a key has none."""
    w = Window.partitionBy(key).orderBy(t)
    good = F.when(~F.col(bad), F.struct(F.col(t).alias("t"), F.col(v).alias("v")))
    before = F.last(good, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.last(good, True).over(Window.partitionBy(key).orderBy(F.col(t).desc()).rowsBetween(Window.unboundedPreceding, 0))
    got = df.select(key, t, v, bad, before.alias("_a"), after.alias("_b"))
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col(t) - F.col("_a.t")) / (F.col("_b.t") - F.col("_a.t"))
    made = F.when(F.col("_a").isNull() & F.col("_b").isNull(), F.lit(0.0)).when(F.col("_a").isNull(), F.col("_b.v")).when(F.col("_b").isNull(), F.col("_a.v")).otherwise(line)
    return got.select(key, t, F.when(F.col(bad), made).otherwise(F.col(v)).alias(v))


def at_fraction(points: DataFrame, samples: DataFrame, key: str, i: str, v: str, at: str) -> DataFrame:
    """Points with the value at a fractional place of their key's samples (numbered by i); beyond the last pair the last value. An equi-join on the whole part."""
    w = Window.partitionBy(key).orderBy(i)
    seg = samples.select(key, F.col(i).cast("long").alias("_i"), F.col(v).alias("_v0"), F.lead(v).over(w).alias("_v1"))
    met = points.withColumn("_i", F.floor(at)).join(seg, [key, "_i"])
    return met.withColumn(v, F.col("_v0") + F.coalesce(F.col("_v1") - F.col("_v0"), F.lit(0.0)) * (F.col(at) - F.col("_i"))).drop("_i", "_v0", "_v1")


def line_time(start, i, period):
    """Time of scan line i; a negative period for reverse scans."""
    return start + i * period


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``i``, each row's place from 1 in a total order: rows are sorted by ranges, and numbers inside a range begin after the rows of those before.

    The rows of each range are counted on the driver, one number a partition.
    The ranges come from a sample, so the dealt rows are kept on disk for both
    passes; lost ones are dealt again by the same ranges.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = df.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()).persist(StorageLevel.DISK_ONLY)
    sizes = {r["_p"]: r["n"] for r in part.groupBy("_p").agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for k in range(n):
        before.append(F.lit(total).cast("long"))
        total += sizes.get(k, 0)
    at = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return part.withColumn("i", at + F.element_at(F.array(*before), F.col("_p") + 1)).drop("_p")
