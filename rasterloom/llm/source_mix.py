"""Mixing sources to target weights by a time-varying curriculum (operator 1).

Each source has a schedule of weights over training time 0 to 1, a line
through knots. Its share of the mix is the integral of its weight; targets
that would repeat a source more than ``max_passes`` times stop there, and the
excess is shared among the others by weight. Demand for a source up to time t
is its target times the part of its integral up to t, so a document that
starts at a cumulative count of c words of its source is trained on at the
time where demand reaches c: the inverse of the cumulative demand, a square
root on a piece of the schedule. Sorting by this position gives the order.

Inside a source documents stand in the order of a hash of their id, the same
in every run. A pass takes all documents; the last pass may end inside one,
or (``mixed_documents``) takes whole documents only.

Running sums are taken in two steps: sums by source and hash range first, a
small table of a bounded number of rows a source, then inside a range. So a
source with a third of all rows is spread over all tasks.

Defined results: a null text has size 0; a source of no words has target 0.
Null sources come last in the order of code points. Null ids are allowed;
rows that are alike in id, source and size are interchangeable, and each gets
its own share. Very long texts are counted whole and taken as any other. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, partitions

Knots = list[tuple[float, float]]


def sizes(df: DataFrame, text_col: str = "text") -> Column:
    """Words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(df[text_col], F.lit(WORD)), F.lit(0)).cast("long")


def integral(knots: Knots) -> float:
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))


def by_place(values: list[Column]) -> Column:
    """The value for a source by its place in the order of sources, in turn."""
    return F.element_at(F.array(*values), (F.col("place") % len(values) + 1).cast("int"))


def targets(sized: DataFrame, weights: list[float], volume: float = 1.5, max_passes: float = 2.0) -> DataFrame:
    """(source, source_size, place, target) of a table (source, size); one row a source.

    Water filling in closed form: with sources by cap / weight, the level that
    the rest would reach is (volume - caps so far) / (weights left), and a
    source stops at its cap if that level is above its own ratio.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = per.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("w", by_place([F.lit(float(w)) for w in weights]))
    cap = F.col("source_size") * F.lit(float(max_passes))
    order = Window.orderBy((F.col("cap") / F.col("w")), "place")
    all_rows = Window.partitionBy(F.lit(0))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = order.rowsBetween(0, Window.unboundedFollowing)
    filled = placed.withColumn("cap", cap)
    filled = filled.withColumn("level", (F.sum("source_size").over(all_rows) * F.lit(float(volume)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(left))
    filled = filled.withColumn("stops", F.col("cap") / F.col("w") <= F.col("level"))
    open_level = F.min_by("level", F.when(~F.col("stops"), F.struct(F.col("cap") / F.col("w"), F.col("place")))).over(all_rows)
    return filled.withColumn("open", open_level).select("source", "source_size", "place", F.when(F.col("stops"), F.col("cap")).otherwise(F.col("w") * F.col("open")).alias("target"))


def placed(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """Adds the source's figures and ``start``: the words of its documents before this one in hash order.

    sized: a table (doc_id, source, size, ...). goals: as of ``targets``.
    """
    h = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    by = ["_z", "_s", "_r"]  # of a null source too, so that window and join deal rows alike and wide rows move once
    named = lambda d: d.withColumns({"_z": F.col("source").isNull(), "_s": F.coalesce("source", F.lit(""))})
    keyed = named(sized).withColumn("h", h).withColumn("_r", F.substring("h", 1, 3))
    sums = keyed.groupBy(*by).agg(F.sum("size").alias("n"))
    before = Window.partitionBy("_z", "_s").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n").join(named(goals).drop("source"), ["_z", "_s"])
    inner = Window.partitionBy(*by).orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    joined = keyed.withColumn("inside", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(base, by)
    return joined.withColumn("start", F.col("base") + F.col("inside")).drop(*by, "base", "inside")


def position(share: Column, knots: Knots) -> Column:
    """Time at which a schedule has used the given share of its integral."""
    total, done = integral(knots), 0.0
    pieces = []
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        slope = (w1 - w0) / (t1 - t0)
        area = F.greatest(share * total - done, F.lit(0.0))
        # w0 x + slope x^2 / 2 = area, solved in the form that also holds for slope 0
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * area, F.lit(0.0)))
        x = F.coalesce(F.lit(2.0) * area / F.nullif(F.lit(w0) + root, F.lit(0.0)), F.lit(0.0))
        done += (t1 - t0) * (w0 + w1) / 2
        pieces.append((done, F.least(F.lit(float(t0)) + x, F.lit(float(t1)))))
    out = F.lit(float(knots[-1][0]))
    for end, at in reversed(pieces):
        out = F.when(share * total <= end, at).otherwise(out)
    return out


def _passes(df: DataFrame) -> DataFrame:
    """Adds passes, the whole passes over the source, and rest, the words of the pass after them."""
    out = df.withColumn("passes", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long"))
    return out.withColumn("rest", F.floor(F.col("target") - F.col("passes") * F.col("source_size")).cast("long"))


def mix(df: DataFrame, schedules: list[Knots], volume: float = 1.5, max_passes: float = 2.0) -> DataFrame:
    """What the mix takes of each row of a table (doc_id, source, text), to the word.

    schedules: of the sources in the order of code points, in turn. taken:
    passes * size and what the last pass takes. position: the training time of
    the document's first word, null if nothing of it is taken.
    """
    sized = cut(df.select("doc_id", "source", sizes(df).alias("size")))
    all_ = _passes(placed(sized, targets(sized, [integral(k) for k in schedules], volume, max_passes)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start")))
    taken = all_.withColumn("taken", F.col("passes") * F.col("size") + part)
    share = F.try_divide(F.col("start").cast("double"), F.col("target"))
    at = F.when(F.col("taken") > 0, by_place([position(share, k) for k in schedules]))
    return taken.select("doc_id", "source", "size", "source_size", "target", "passes", "taken", at.alias("position"), "h")


def mixed_documents(df: DataFrame, schedules: list[Knots], volume: float = 1.5, max_passes: float = 2.0) -> DataFrame:
    """The documents of the mix, all columns, range-sorted by training position.

    A document comes once for each pass that takes it. The last pass takes
    whole documents: those of which it would take the larger part.
    """
    sized = df.select(F.struct("*").alias("row"), F.col("doc_id"), F.col("source"), sizes(df).alias("size"))
    narrow = cut(sized.groupBy("source").agg(F.sum("size").alias("size")))
    goals = targets(narrow, [integral(k) for k in schedules], volume, max_passes)
    all_ = _passes(placed(sized, goals))
    copies = F.col("passes") + (2 * F.col("start") + F.col("size") <= 2 * F.col("rest")).cast("int")
    repeated = all_.withColumn("copies", copies).filter("copies > 0").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    share = F.try_divide((F.col("pass") * F.col("source_size") + F.col("start")).cast("double"), F.col("target"))
    at = repeated.select("row", "h", F.coalesce(by_place([position(share, k) for k in schedules]), F.lit(1.0)).alias("position"))
    return ordered(at).select("row.*")


def ordered(mixed: DataFrame) -> DataFrame:
    """Range-sorted by position, documents that aren't taken last."""
    by = [F.col("position").asc_nulls_last(), F.col("h")]
    return mixed.repartitionByRange(partitions(mixed.sparkSession), *by).sortWithinPartitions(*by)
