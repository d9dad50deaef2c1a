"""Aggregations: robust statistics, error reports, least squares by sums, stretches and histograms.

All but exact quantiles are sums that combine before the shuffle, so a group of
any size is fine; quantiles are found in the one bin of a histogram that holds
them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Confidence factors of a normal distribution, and the factor from MAD to sigma.
CE = {"ce68": 0.994458, "ce90": 1.644854, "ce95": 1.959964, "ce99": 2.575829}
NMAD = 1.4826


def exact_quantiles(df: DataFrame, value: str, by: list[str], shares: dict[str, float], bins: int = 4096) -> DataFrame:
    """By group the quantiles by linear interpolation, named as in ``shares``; null and NaN don't count.

    A first pass counts values by bins of each group's range, and only the
    bins that hold a wanted rank are looked at again, as different values with
    their counts; so neither a large group nor a frequent value is gathered.
    """
    v = F.nanvl(F.col(value).cast("double"), F.lit(None))
    rows = df.select(*by, v.alias("_v")).filter("_v IS NOT NULL")
    key = [F.col(c) for c in by]
    lim = rows.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n"))
    on = lambda d: d.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], *[c for c in d.columns if c not in by])
    same = [key[i].eqNullSafe(F.col(f"_g{i}")) for i in range(len(by))]
    meet = lambda left, right: (left.join(on(right), same) if by else left.crossJoin(right)).drop(*[f"_g{i}" for i in range(len(by))])  # noqa: E731, a row a group
    wide = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0)
    binned = meet(rows, lim).select(*by, "_v", "_n", F.least(F.floor((F.col("_v") - F.col("_lo")) / wide * bins), F.lit(bins - 1)).alias("_b"))
    counts = binned.groupBy(*by, "_b").agg(F.count("*").alias("_c"), F.max("_n").alias("_n"))
    upto = counts.withColumn("_end", F.sum("_c").over(Window.partitionBy(*by).orderBy("_b")))  # a row a bin
    ranks = [f((F.col("_n") - 1) * p) for p in shares.values() for f in (F.floor, F.ceil)]
    holds = upto.filter(F.exists(F.array(*ranks), lambda r: (r >= F.col("_end") - F.col("_c")) & (r < F.col("_end")))).select(*by, "_b", (F.col("_end") - F.col("_c")).alias("_before"))
    names = holds.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], F.col("_b").alias("_hb"), "_before")
    near = binned.join(names, [*same, F.col("_b") == F.col("_hb")])
    values = near.groupBy(*by, "_b", "_v").agg(F.count("*").alias("_c"), F.max("_before").alias("_before"), F.max("_n").alias("_n"))
    end = F.col("_before") + F.sum("_c").over(Window.partitionBy(*by, "_b").orderBy("_v"))
    placed = values.withColumn("_end", end)
    at = lambda f, p: F.max(F.when((f((F.col("_n") - 1) * p) >= F.col("_end") - F.col("_c")) & (f((F.col("_n") - 1) * p) < F.col("_end")), F.col("_v")))
    got = placed.groupBy(*by).agg(F.max("_n").alias("_n"), *[at(f, p).alias(f"_{k}{i}") for k, p in shares.items() for i, f in enumerate((F.floor, F.ceil))])
    part = lambda p: (F.col("_n") - 1) * p - F.floor((F.col("_n") - 1) * p)
    return got.select(*by, *[(F.col(f"_{k}0") + (F.col(f"_{k}1") - F.col(f"_{k}0")) * part(p)).alias(k) for k, p in shares.items()])


def robust_stats(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """By group: n, mu, sigma (population), rmse over values that aren't 0, min, max, median, mad, nmad and the intervals. Null and NaN don't count."""
    v = F.nanvl(F.col(value).cast("double"), F.lit(None))
    valid = df.select(*by, v.alias("v")).filter("v IS NOT NULL")
    first = valid.groupBy(*by).agg(F.count("v").alias("n"), F.avg("v").alias("mu"), F.stddev_pop("v").alias("sigma"), F.sqrt(F.avg(F.when(F.col("v") != 0, F.col("v") * F.col("v")))).alias("rmse"), F.min("v").alias("min_v"), F.max("v").alias("max_v"))
    named = lambda d, c: d.select(*[F.col(b).alias(f"_{b}") for b in by], c)
    same = [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by]
    meet = lambda left, right: (left.join(right, same) if by else left.crossJoin(right)).drop(*[f"_{b}" for b in by])  # noqa: E731, one row a group
    mids = exact_quantiles(valid, "v", by, {"median_v": 0.5})
    away = meet(valid, named(mids, "median_v")).select(*by, F.abs(F.col("v") - F.col("median_v")).alias("v"))
    mads = exact_quantiles(away, "v", by, {"mad": 0.5})
    out = meet(meet(first, named(mids, "median_v")), named(mads, "mad"))
    return out.select(*by, "n", "mu", "sigma", "rmse", "min_v", "max_v", "median_v", "mad", (F.col("mad") * NMAD).alias("nmad"), *[(F.col("mu") + F.col("sigma") * z).alias(k) for k, z in CE.items()])


def loop_report(df: DataFrame, loop: str, dx: str, dy: str, snr: str, snr_th: float = 0.9) -> DataFrame:
    """By loop: mean errors, rmse of the spread, size of the mean error, points without and with a good match."""
    return df.groupBy(F.col(loop).alias("loop")).agg(
        F.avg(dx).alias("mean_dx"), F.avg(dy).alias("mean_dy"), F.sqrt(F.var_pop(dx) + F.var_pop(dy)).alias("rmse"), F.sqrt(F.avg(dx) * F.avg(dx) + F.avg(dy) * F.avg(dy)).alias("avg_error"), F.count_if(F.col(snr) == 0).alias("n_zero"), F.count_if(F.col(snr) > snr_th).alias("n_good")
    )


def best_loop(report: DataFrame) -> DataFrame:
    """The loop with the smallest mean error, the first on ties."""
    return report.agg(F.min_by("loop", F.struct("avg_error", "loop")).alias("loop"), F.min("avg_error").alias("avg_error"))


def solve3(m: list[Column], r: list[Column]) -> list[Column]:
    """Solution of a symmetric 3 x 3 system (m: xx, xy, x, yy, y, one) by Cramer's rule; null if singular."""
    a, b, c, d, e, f = m
    det = a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c)
    x = r[0] * (d * f - e * e) - b * (r[1] * f - e * r[2]) + c * (r[1] * e - d * r[2])
    y = a * (r[1] * f - r[2] * e) - r[0] * (b * f - e * c) + c * (b * r[2] - r[1] * c)
    z = a * (d * r[2] - e * r[1]) - b * (b * r[2] - r[1] * c) + r[0] * (b * e - d * c)
    return [F.try_divide(v, det) for v in (x, y, z)]


def plane_fit(df: DataFrame, x: Column, y: Column, w: Column, obs: Column, by: list[str]) -> DataFrame:
    """By group a, b, c of obs = a x + b y + c, weighted by w squared."""
    rows = df.select(*by, (w * w).alias("q"), x.alias("x"), y.alias("y"), obs.alias("o"))
    q, x, y, o = (F.col(c) for c in "qxyo")
    sums = rows.groupBy(*by).agg(*[F.sum(e).alias(f"s{i}") for i, e in enumerate([q * x * x, q * x * y, q * x, q * y * y, q * y, q, q * x * o, q * y * o, q * o])])
    s = [F.col(f"s{i}") for i in range(9)]
    return sums.select(*by, *[c.alias(n) for c, n in zip(solve3(s[:6], s[6:]), "abc", strict=True)])


def robust_plane_fit(df: DataFrame, x: str, y: str, obs: str, rounds: int = 5) -> tuple[float, float, float]:
    """Plane with Cauchy weights 1 / (1 + r^2) by iterated sums; a row of sums a round goes to the driver."""
    fit = (0.0, 0.0, 0.0)
    for i in range(rounds):
        r = F.col(obs) - (F.col(x) * fit[0] + F.col(y) * fit[1] + fit[2])
        w = F.lit(1.0) if i == 0 else F.sqrt(F.lit(1.0) / (F.lit(1.0) + r * r))
        fit = tuple(plane_fit(df, F.col(x), F.col(y), w, F.col(obs), []).first())
    return fit


def robust_affine_fit(df: DataFrame, col: str, row: str, x: str, y: str, rounds: int = 5) -> tuple[float, ...]:
    """Six numbers of x = a0 col + a1 row + a2, y = b0 col + b1 row + b2; as the loss is of each residual, the axes are fitted apart."""
    return (*robust_plane_fit(df, col, row, x, rounds), *robust_plane_fit(df, col, row, y, rounds))


def affine_fit(df: DataFrame, col: str, row: str, x: str, y: str, by: list[str]) -> DataFrame:
    """By group the six numbers of x = a0 col + a1 row + a2, y = b0 col + b1 row + b2."""
    one = F.lit(1.0)
    a = plane_fit(df, F.col(col), F.col(row), one, F.col(x), by).withColumnsRenamed({"a": "a0", "b": "a1", "c": "a2"})
    b = plane_fit(df, F.col(col), F.col(row), one, F.col(y), by).withColumnsRenamed({"a": "b0", "b": "b1", "c": "b2"})
    return a.join(b, by) if by else a.crossJoin(b)  # a row a group


def histogram(df: DataFrame, value: str, bins: int, by: list[str]) -> DataFrame:
    """bin (0 to bins - 1) and n over each group's range, the last bin closed; bins without rows are left out."""
    ends = df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    both = df.join(ends, by) if by else df.crossJoin(ends)  # a row a group
    at = F.floor(F.try_divide((F.col(value) - F.col("_lo")) * bins, F.col("_hi") - F.col("_lo")))
    return both.filter(F.col(value).isNotNull()).groupBy(*by, F.coalesce(F.least(at, F.lit(bins - 1)), F.lit(0)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def percentile_stretch(df: DataFrame, value: str, by: list[str], lo: float = 0.02, hi: float = 0.98) -> DataFrame:
    """Adds ``stretched``: values between two percentiles of their group brought to 0 to 1, those beyond at the ends."""
    cuts = exact_quantiles(df, value, by, {"_p0": lo, "_p1": hi})
    both = df.join(cuts, by) if by else df.crossJoin(cuts)  # a row a group
    share = F.try_divide(F.col(value) - F.col("_p0"), F.col("_p1") - F.col("_p0"))
    return both.withColumn("stretched", F.greatest(F.least(share, F.lit(1.0)), F.lit(0.0))).drop("_p0", "_p1")


def minmax(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Adds ``scaled``, 0 to 1 over each group, null where all are equal."""
    ends = df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    both = df.join(ends, by) if by else df.crossJoin(ends)
    return both.withColumn("scaled", F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo"))).drop("_lo", "_hi")


def explained_variance(df: DataFrame, s: str, order: str) -> DataFrame:
    """Percent of the squares of singular values, and their running sum; a table of as many rows as components."""
    sq = F.col(s) * F.col(s)
    w = Window.orderBy(order)
    pct = F.round(F.lit(100.0) * sq / F.sum(sq).over(Window.partitionBy(F.lit(0))), 2)
    return df.withColumn("pct", pct).withColumn("cum", F.sum("pct").over(w.rowsBetween(Window.unboundedPreceding, 0)))
