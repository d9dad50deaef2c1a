"""Joins of an image catalogue: overlapping pairs, combinations, jobs, updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grid import overlap

BOX = ("minx", "miny", "maxx", "maxy")


#: Tasks that share the units of a join; more than the cores of any cluster at hand, so that they come out even.
UNIT_TASKS = 384
#: Most boxes in a part of a cell; a unit compares two parts.
PART_BOXES = 4096


def _cells(df: DataFrame, cell: tuple[float, float]) -> DataFrame:
    span = lambda a, b, c: F.sequence(F.floor(F.col(a) / c), F.floor(F.col(b) / c))
    return df.withColumn("_cx", F.explode(span("minx", "maxx", cell[0]))).withColumn("_cy", F.explode(span("miny", "maxy", cell[1])))


def _sides(left: DataFrame, right: DataFrame, cell: float) -> tuple[float, float]:
    """Sides of a cell: the root mean square of the boxes' sides, so that all boxes cover at most four cells each on average, but no longer than ``cell``."""
    spans = [d.select((F.col("maxx") - F.col("minx")).cast("double").alias("w"), (F.col("maxy") - F.col("miny")).cast("double").alias("h")) for d in (left, right)]
    got = spans[0].unionAll(spans[1]).agg(*[F.sqrt(F.avg(F.col(c) * F.col(c))) for c in "wh"]).first()
    return tuple(v if v is not None and 0 < v < cell else cell for v in got)


def _box_parts(df: DataFrame, cell: tuple[float, float], p: str) -> DataFrame:
    """The boxes of each cell in parts of bounded number, by their left edge: ``_<p>s`` structs, and the box about each part."""
    known = [c for c, kind in df.dtypes if "map<" not in kind]
    w = Window.partitionBy("_cx", "_cy").orderBy("minx", F.xxhash64(*known))
    box = F.struct(*df.columns, F.floor(F.col("minx") / cell[0]).alias("_fx"), F.floor(F.col("miny") / cell[1]).alias("_fy")).alias("_b")
    dealt = _cells(df, cell).select("_cx", "_cy", box, F.floor((F.row_number().over(w) - 1) / PART_BOXES).alias(f"_{p}p"))
    about = [f(f"_b.{c}").alias(f"_{p}{c}") for f, c in ((F.min, "minx"), (F.min, "miny"), (F.max, "maxx"), (F.max, "maxy"))]
    return dealt.groupBy("_cx", "_cy", f"_{p}p").agg(F.collect_list("_b").alias(f"_{p}s"), *about)


def overlapping(left: DataFrame, right: DataFrame, cell: float, least: float | None = None) -> DataFrame:
    """Pairs (l.*, r.* with prefixes l_ and r_, overlap percent) of boxes that touch.

    Boxes are dealt to the grid cells that they cover and meet there by an
    equi-join; a pair is kept only in the first cell that both have, so it
    comes once. ``cell`` should be near the usual size of a box; cells of a
    table are made smaller if its boxes are. Not boxes but parts of a cell's
    boxes are joined, and the units of two parts go to all tasks, which write
    out their pairs without holding them. A stream joins box by box.
    """
    if left.isStreaming or right.isStreaming:
        return _overlapping_boxes(left, right, cell, least)
    sides = _sides(left, right, cell)
    units = _box_parts(left, sides, "l").join(_box_parts(right, sides, "r"), ["_cx", "_cy"])
    units = units.filter("_lmaxx >= _rminx AND _rmaxx >= _lminx AND _lmaxy >= _rminy AND _rmaxy >= _lminy")
    units = units.repartition(UNIT_TASKS, "_cx", "_cy", "_lp", "_rp").select("_cx", "_cy", F.explode("_ls").alias("_l"), "_rs")
    # coalesce ends the generated code, which holds all rows that one row of its input makes
    met = units.coalesce(UNIT_TASKS).select("_cx", "_cy", "_l", F.explode("_rs").alias("_r"))
    touch, percent = overlap(*({k: F.col(f"{p}.{k}") for k in BOX} for p in ("_l", "_r")))
    once = (F.greatest("_l._fx", "_r._fx") == F.col("_cx")) & (F.greatest("_l._fy", "_r._fy") == F.col("_cy"))
    out = met.filter(once & touch).select(*[F.col(f"_l.{c}").alias("l_" + c) for c in left.columns], *[F.col(f"_r.{c}").alias("r_" + c) for c in right.columns], percent.alias("overlap"))
    return out if least is None else out.filter(F.col("overlap") >= least)


def _overlapping_boxes(left: DataFrame, right: DataFrame, cell: float, least: float | None) -> DataFrame:
    l, r = (_cells(d, (cell, cell)).select(*[F.col(c).alias(p + c) for c in d.columns], "_cx", "_cy") for d, p in ((left, "l_"), (right, "r_")))
    a, b = ({k: F.col(p + k) for k in BOX} for p in ("l_", "r_"))
    touch, percent = overlap(a, b)
    once = (F.col("_cx") == F.floor(F.greatest(a["minx"], b["minx"]) / cell)) & (F.col("_cy") == F.floor(F.greatest(a["miny"], b["miny"]) / cell))
    out = l.join(r, ["_cx", "_cy"]).filter(touch & once).drop("_cx", "_cy").withColumn("overlap", percent)
    return out if least is None else out.filter(F.col("overlap") >= least)


def self_pairs(df: DataFrame, by: list[str], order: str, columns: list[str]) -> DataFrame:
    """Pairs i < j of the rows of a key: key columns, and the columns with suffixes _i and _j."""
    i, j = (df.select(*by, *[F.col(c).alias(c + s) for c in dict.fromkeys([order, *columns])]) for s in ("_i", "_j"))
    return i.join(j, by).filter(F.col(order + "_i") < F.col(order + "_j"))


#: Most names in a part of a set, by place in the combination: a unit of parts makes at most 16 x 128 x 128 x 128 rows.
PARTS = (16, 128, 128, 128)


def _parts(df: DataFrame, by: str, name: str, at: int) -> DataFrame:
    """The names of each set in parts of bounded length: set, ``_n<at>`` array, ``_p<at>`` number of the part."""
    w = Window.partitionBy(by).orderBy(name)
    numbered = df.filter(F.col(name).isNotNull()).select(by, F.col(name).alias("_v"), F.floor((F.row_number().over(w) - 1) / PARTS[at]).alias(f"_p{at}"))
    return numbered.groupBy(by, f"_p{at}").agg(F.collect_list("_v").alias(f"_n{at}"))


def three_d_combinations(pre: DataFrame, post: DataFrame, set_col: str, name: str) -> DataFrame:
    """Of each set the ordered pairs of one side with the unordered pairs of the other, both ways: base, pre, post1, post2.

    The rows grow with the fourth power of a set. Parts of its names meet
    instead of the names, and the units of four parts go to all tasks, which
    write out their rows without holding them.
    """

    def one(a: DataFrame, b: DataFrame) -> DataFrame:
        units = _parts(a, set_col, name, 0).join(_parts(a, set_col, name, 1), set_col).join(_parts(b, set_col, name, 2), set_col).join(_parts(b, set_col, name, 3), set_col)
        units = units.filter(F.array_min("_n2") < F.array_max("_n3")).repartition(UNIT_TASKS, set_col, *[f"_p{k}" for k in range(4)])
        for k, (i, kept) in enumerate((("i0", None), ("i1", "i0 <> i1"), ("i2", None), ("i3", "i2 < i3"))):
            units = units.withColumn(i, F.explode(f"_n{k}"))
            units = units.filter(kept) if kept else units
            if i == "i1":
                units = units.coalesce(UNIT_TASKS)  # ends the generated code, which holds all rows that one row of its input makes
        return units.select(set_col, "i0", "i1", "i2", "i3")

    return one(pre, post).unionByName(one(post, pre))


def correlation_jobs(pairs: DataFrame, base: str, target: str, both_ways: bool) -> DataFrame:
    """(base, target); with ``both_ways`` also the reversed jobs, duplicates kept."""
    there = pairs.select(F.col(base).alias("base"), F.col(target).alias("target"))
    return there.unionByName(there.select(F.col("target").alias("base"), F.col("base").alias("target"))) if both_ways else there


def serial_pairs(a: DataFrame, b: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """The i-th of a with the i-th of b inside each key; a rest without partner has a null."""
    w = Window.partitionBy(*by).orderBy(*order)
    x = a.select(*by, F.row_number().over(w).alias("i"), F.col(name).alias("base"))
    y = b.select(*by, F.row_number().over(w).alias("i"), F.col(name).alias("target"))
    return x.join(y, [*by, "i"], "full")


def merge_update(df: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with the updates' non-null values; keys that only the updates have are not added."""
    u = updates.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = df.join(u, F.col(key) == F.col("_k"), "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in df.columns])


def missing(df: DataFrame, done: DataFrame, on: Column | list[str]) -> DataFrame:
    """Rows without a partner in ``done``; repeated rows stay. Keys of ``done`` count once, so a frequent one costs a row; Spark splits its rows of ``df``."""
    if isinstance(on, list):
        done = done.select(*on).distinct()
    return df.join(done, on, "left_anti")
