"""Joins that make jobs and sets of an image catalogue from lists, names and tiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pairs import BOX, UNIT_TASKS, overlapping, serial_pairs
from .sequences import latest

#: Lists of images that a job crosses are broadcast below this number of rows.
BROADCAST_ROWS = 100_000
#: Names that texts are searched for are broadcast below this number, and met by a shuffle beyond.
BROADCAST_NAMES = 1_000_000
#: Characters of the pieces that a text is cut to; a piece goes on by a name's length.
PIECE = 256


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if it has at most so many rows; counting stops beyond."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def all_pairs(base: DataFrame, target: DataFrame, params: DataFrame | None = None) -> DataFrame:
    """Every base with every target, and with every set of parameters: each is a job, so the product is the result."""
    out = base.crossJoin(small(target))
    return out if params is None else out.crossJoin(small(params))


def batch_jobs(base: DataFrame, target: DataFrame, mode: str, name: str, params: DataFrame | None = None) -> DataFrame:
    """(base, target) jobs of a batch by the images' names.

    one_to_one: the i-th with the i-th, unequal numbers are an error;
    one_to_many: every base with every target; many_to_many: all i < j of the
    names of both lists. Crossed with the different parameters, if any.
    """
    if mode == "one_to_one":
        key = F.lit(0).alias("_k")
        met = serial_pairs(base.select(key, name), target.select(key, name), ["_k"], [name], name)
        fault = F.raise_error(F.lit("the lists have unequal numbers of images"))
        jobs = met.select(F.coalesce("base", fault.cast("string")).alias("base"), F.coalesce("target", fault.cast("string")).alias("target"))
    elif mode == "one_to_many":
        jobs = base.select(F.col(name).alias("base")).crossJoin(small(target.select(F.col(name).alias("target"))))
    elif mode == "many_to_many":
        both = base.select(name).union(target.select(name)).distinct()
        jobs = both.select(F.col(name).alias("base")).join(small(both.select(F.col(name).alias("target"))), F.col("base") < F.col("target"))
    else:
        raise ValueError("mode is one_to_one, one_to_many or many_to_many")
    return jobs if params is None else jobs.crossJoin(small(params.distinct()))


def band_pairs(bands: Column, asked: Column | None = None) -> Column:
    """Array of (i, j) of an image with so many bands: all i < j, or those that a text like ``1,2;3,4`` asks for; null below two bands."""
    i = F.sequence(F.lit(1), bands)
    every = F.flatten(F.transform(i, lambda a: F.transform(F.filter(i, lambda b: b > a), lambda b: F.struct(a.alias("i"), b.alias("j")))))
    out = every
    if asked is not None:
        out = F.when(asked.isNull() | (F.trim(asked) == ""), every).otherwise(band_list(asked))
    return F.when(bands >= 2, out)


def band_list(text: Column) -> Column:
    """Array of (i, j) from ``1,2;3,4``."""
    part = lambda x, k: F.trim(F.element_at(F.split(x, ","), k)).cast("int")
    return F.transform(F.filter(F.split(text, ";"), lambda x: F.trim(x) != ""), lambda x: F.struct(part(x, 1).alias("i"), part(x, 2).alias("j")))


def pair_sets(pre: DataFrame, post: DataFrame, cell: float, least: float | None = None) -> DataFrame:
    """Pre-event pairs with post-event pairs (i, j, and the box they share) whose boxes touch: pre_i, pre_j, post_i, post_j, shared box, overlap percent."""
    met = overlapping(pre, post, cell, least)
    box = [F.greatest("l_minx", "r_minx"), F.greatest("l_miny", "r_miny"), F.least("l_maxx", "r_maxx"), F.least("l_maxy", "r_maxy")]
    return met.select(F.col("l_i").alias("pre_i"), F.col("l_j").alias("pre_j"), F.col("r_i").alias("post_i"), F.col("r_j").alias("post_j"), *[b.alias(n) for b, n in zip(box, BOX, strict=True)], "overlap")


def shared_box(df: DataFrame, by: list[str]) -> DataFrame:
    """By group the box that all boxes share, null columns if there is none; touching boxes share a line."""
    lo = [F.max("minx"), F.max("miny")]
    hi = [F.min("maxx"), F.min("maxy")]
    got = df.groupBy(*by).agg(*[a.alias(n) for a, n in zip([*lo, *hi], BOX, strict=True)])
    ok = (F.col("minx") <= F.col("maxx")) & (F.col("miny") <= F.col("maxy"))
    return got.select(*by, *[F.when(ok, F.col(n)).alias(n) for n in BOX])


def lookup(df: DataFrame, catalogue: DataFrame, key: str, order: list, columns: list[str]) -> DataFrame:
    """Rows with columns of the first entry of the catalogue with their key, null without one."""
    first = latest(catalogue.filter(F.col(key).isNotNull()), [key], order).select(key, *columns)
    return df.join(first, key, "left")


def complete_sets(wanted: DataFrame, existing: DataFrame, set_key: str, name: str, size: int) -> DataFrame:
    """Sets whose every product exists: keys with ``size`` wanted names among the existing ones."""
    met = wanted.select(set_key, name).distinct().join(existing.select(name).distinct(), name)
    return met.groupBy(set_key).agg(F.count("*").alias("_n")).filter(F.col("_n") == size).select(set_key)


def found_in(texts: DataFrame, text: str, names: DataFrame, name: str) -> DataFrame:
    """Distinct texts, by hash of the text in many tasks, with each row of the names that they contain.

    Parts of a text as long as a name meet the names by an equi-join, so the
    work is the texts' length times the number of lengths that names have, and
    not the number of names. Long texts are cut first, as a part is found by
    counting characters.
    """
    lengths = sorted(r[0] for r in names.select(F.length(name)).distinct().collect() if r[0] is not None)
    if not lengths:
        return texts.select(text).filter("false").crossJoin(names)
    step, last = F.lit(PIECE), F.greatest(F.length(text) - 1, F.lit(0))
    piece = F.transform(F.sequence(F.lit(0), F.floor(last / step).cast("int")), lambda k: F.substring(F.col(text), k * step + 1, F.lit(PIECE + lengths[-1] - 1)))
    cut = texts.select(text).repartition(UNIT_TASKS, text).distinct().select(text, F.explode(piece).alias("_x"))
    at = cut.withColumn("_at", F.explode(F.sequence(F.lit(1), F.greatest(F.length("_x"), F.lit(1))))).withColumn("_len", F.explode(F.array(*map(F.lit, lengths))))
    parts = at.filter(F.col("_at") + F.col("_len") - 1 <= F.length("_x")).select(text, F.substring(F.col("_x"), F.col("_at"), F.col("_len")).alias(name))
    return parts.join(small(names, BROADCAST_NAMES), name)


def named_in(df: DataFrame, text: str, names: DataFrame, name: str, order: str) -> DataFrame:
    """Adds the last name, by ``order``, that a row's text contains, null without one. The last match is kept where the text is."""
    key = df.withColumn("_t", F.col(text))
    listed = names.groupBy(F.col(name).alias("_name")).agg(F.max(order).alias("_o"))
    last = found_in(key, "_t", listed, "_name").groupBy("_t").agg(F.max_by("_name", "_o").alias(name + "_found"))
    return key.join(last, "_t", "left").drop("_t")


def unmentioned(files: DataFrame, name: str, lines: DataFrame, line: str) -> DataFrame:
    """Files whose name no line contains: the names that are found in lines are taken off by an equi-join."""
    met = found_in(lines.select(F.col(line).alias("_t")), "_t", files.select(F.col(name).alias("_n")).distinct(), "_n")
    return files.join(met.select(F.col("_n").alias(name)).distinct(), name, "left_anti")


def zip_tiles(tables: list[DataFrame], tile: str) -> DataFrame:
    """Tables of one row a tile side by side; a tile that one lacks is an error."""
    names = [[c for c in d.columns if c != tile] for d in tables]
    parts = [d.withColumn(f"_h{i}", F.lit(1)) for i, d in enumerate(tables)]
    met = reduce(lambda a, b: a.join(b, tile, "full"), parts)
    whole = reduce(lambda a, b: a & b, [F.col(f"_h{i}").isNotNull() for i in range(len(tables))])
    checked = met.withColumn(tile, F.when(whole, F.col(tile)).otherwise(F.raise_error(F.concat(F.lit("a list lacks tile "), F.col(tile).cast("string"))).cast(dict(met.dtypes)[tile])))
    return checked.select(tile, *[c for n in names for c in n])


def same_shape(df: DataFrame, by: list[str], height: str, width: str) -> DataFrame:
    """By group: have all rasters one shape?"""
    a, b = F.min(F.struct(height, width)), F.max(F.struct(height, width))
    return df.groupBy(*by).agg((a == b).alias("same_shape"))


def tie_point_table(tps: DataFrame, pairs: DataFrame, ref: str = "ref", raw: str = "raw") -> DataFrame:
    """Tie points of the asked pairs of images: an equi-join on both names."""
    return tps.join(pairs.select(ref, raw).distinct(), [ref, raw])


def tie_points_meeting(tps: DataFrame, refs: DataFrame, raws: DataFrame, key: str, ref: str = "ref", raw: str = "raw") -> DataFrame:
    """Tie points of the pairs of images that have a key in common. The pairs, as many as the product of a key's images, aren't written out: each point gets its two images' keys."""
    of = lambda d, image, c: d.filter(F.col(key).isNotNull()).groupBy(image).agg(F.collect_set(key).alias(c))
    met = tps.join(of(refs, ref, "_ref_keys"), ref).join(of(raws, raw, "_raw_keys"), raw)
    return met.filter(F.arrays_overlap("_ref_keys", "_raw_keys")).select(*tps.columns)


def upserted(df: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """A catalogue with columns that only the updates have added, and the updates' values in rows with their key."""
    added = [c for c in updates.columns if c not in df.columns]
    u = updates.select(*[F.col(c).alias(f"_u_{c}") for c in updates.columns]).withColumn("_hit", F.lit(True))
    met = df.join(u, F.col(key) == F.col(f"_u_{key}"), "left")
    old = [F.when(F.col("_hit"), F.col(f"_u_{c}")).otherwise(F.col(c)).alias(c) if c in updates.columns and c != key else F.col(c) for c in df.columns]
    return met.select(*old, *[F.col(f"_u_{c}").alias(c) for c in added])


def split_by_date(df: DataFrame, name: str, date: str, event: str) -> DataFrame:
    """Named images with ``side``: pre before the event's date, post from it on."""
    return df.filter(F.col(name).isNotNull()).withColumn("side", F.when(F.col(date) < F.lit(event).cast("timestamp_ntz"), "pre").otherwise("post"))
