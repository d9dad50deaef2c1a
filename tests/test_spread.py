"""Jobs whose work once stood in few tasks or grew faster than the tables."""

import re
from itertools import combinations, permutations

import numpy as np
from pyspark.sql import functions as F

from rasterloom.functions import grid
from rasterloom.operators import batch, correlate, pairs
from rasterloom.plans import relations


def largest_share(df):
    """Share of the rows that the largest task makes."""
    n = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(n) / sum(n)


def test_combinations_come_from_many_tasks(spark):
    """Whole sets, with more names than a part holds and names twice, from tasks of which none has much."""
    names = {0: (range(0, 21), range(100, 105)), 1: (range(5, 8), [*range(200, 240), 203])}
    side = lambda k: spark.createDataFrame([(g, v) for g, s in names.items() for v in s[k]] + [(None, 7), (0, None)], "g int, v long")
    got = pairs.three_d_combinations(side(0), side(1), "g", "v")
    want = sorted((g, i, j, *sorted(kl)) for g, s in names.items() for a, b in (s, s[::-1]) for i, j in permutations(a, 2) if i != j for kl in combinations(b, 2) if kl[0] != kl[1])
    assert sorted(map(tuple, got.collect())) == want
    even = spark.range(320).select((F.col("id") % 4).alias("g"), F.col("id").alias("v"))
    assert largest_share(pairs.three_d_combinations(even.filter("v < 160"), even.filter("v >= 160"), "g", "v")) < 0.15


def boxes(spark, n, seed, wide=10.0):
    at = [(F.rand(seed + k) * 100).alias(c) for k, c in enumerate(("minx", "miny"))]
    b = spark.range(n).select("id", *at)
    sides = spark.createDataFrame(b.collect(), b.schema)
    return sides.select("id", "minx", "miny", (F.col("minx") + wide + F.col("id") % 3).alias("maxx"), (F.col("miny") + F.col("id") % 5 + 1).alias("maxy"))


def test_boxes_meet_in_parts_of_cells(spark, monkeypatch):
    """Every pair once, though cells are cut in parts, some boxes cover many cells."""
    monkeypatch.setattr(pairs, "PART_BOXES", 8)
    l, r = boxes(spark, 150, 1), boxes(spark, 90, 5, 40.0)
    x, y = l.collect(), r.collect()
    want = sorted((a.id, b.id) for a in x for b in y if min(a.maxx, b.maxx) >= max(a.minx, b.minx) and min(a.maxy, b.maxy) >= max(a.miny, b.miny))
    for cell in (7.0, 500.0):
        assert sorted((p.l_id, p.r_id) for p in pairs.overlapping(l, r, cell).collect()) == want


def test_overlaps_of_one_place_come_from_many_tasks(spark):
    """Boxes that are much smaller than the asked cell all lay in one, and one task compared them all."""
    b = boxes(spark, 1500, 9, 3.0)
    assert largest_share(pairs.overlapping(b, b, 500.0).filter("l_id < r_id")) < 0.1


def test_quick_round_is_round(spark):
    v = [0.0, -0.0, 1.0000005, 2.0000015, -2.5000005, 0.1234564999999, 99.9999995, 1e9, 123456.7890125, -1e-7, 5e300, float("inf"), float("nan"), None] + [k / 7e5 - 3 for k in range(2000)] + [k / 2e6 for k in range(2000)]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    assert df.filter(~F.round("v", 6).eqNullSafe(grid.quick_round(F.col("v")))).count() == 0


def rows_met(df):
    """The join operators of a plan that test all rows against all."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [w for w in ("BroadcastNestedLoopJoin", "CartesianProduct") if w in plan]


def test_tie_points_without_the_product_of_images(spark):
    tps = spark.createDataFrame([(r, w, 10 * r + w) for r in (1, 2, 3, 9) for w in (5, 6, 7, 8)] * 2, "ref long, raw long, n long")
    refs = spark.createDataFrame([(1, 0), (1, 4), (2, 1), (3, None), (3, 2)], "ref long, k int")
    raws = spark.createDataFrame([(5, 4), (5, 0), (6, 1), (7, None), (8, 2), (8, 2)], "raw long, k int")
    got = batch.tie_points_meeting(tps, refs, raws, "k")
    assert sorted((r.ref, r.raw) for r in got.collect()) == [(1, 5)] * 2 + [(2, 6)] * 2 + [(3, 8)] * 2
    assert got.columns == tps.columns


def test_tie_point_query_groups_images_not_pairs(spark, sf):
    """The asked pairs, as many as the product of a key's images, were joined and made distinct."""
    plan = relations.tie_point_pairs(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "arrays_overlap" in plan


def test_names_meet_texts_by_their_parts(spark):
    """Names within names, empty ones, null ones, and names over the cut of a long text."""
    long = "ä" * (batch.PIECE - 2) + "r12.tif" + "b" * 900 + "tail"
    texts = spark.createDataFrame([(1, "keep r1.tif"), (2, long), (3, ""), (4, None), (5, "keep r1.tif"), (6, "r12.ti")], "id int, x string")
    names = spark.createDataFrame([("r1.tif", 1), ("r12.tif", 2), ("12.tif", 3), ("tail", 0), ("r1", -1), (None, 9), ("äär", 1), ("r1.tif", 0)], "n string, o int")
    got = batch.named_in(texts, "x", names, "n", "o")
    assert {r.id: r.n_found for r in got.collect()} == {1: "r1.tif", 2: "12.tif", 3: None, 4: None, 5: "r1.tif", 6: "r1"}
    assert not rows_met(got)
    files = names.select("n")
    left = batch.unmentioned(files, "n", texts.filter("id = 6"), "x")
    assert not rows_met(left)
    assert sorted(str(r.n) for r in left.collect()) == ["12.tif", "None", "r1.tif", "r1.tif", "r12.tif", "tail", "äär"]
    assert [r.n for r in batch.unmentioned(files.filter("n = 'tail'").unionAll(spark.createDataFrame([("",)], "n string")), "n", texts.filter("x = ''"), "x").collect()] == ["tail"]
    assert batch.named_in(texts, "x", names.filter("false"), "n", "o").filter("n_found IS NULL").count() == 6


def test_shifts_of_a_window_are_not_moved(spark):
    """Rows are moved by window only, not by shift, and a window's best shift is that of plain sums."""
    rng = np.random.default_rng(4)
    base, target = rng.normal(size=(2, 17, 18))
    px = spark.createDataFrame([(r, c, float(base[r, c]), float(target[r, c])) for r in range(17) for c in range(18)], "row int, col int, base double, target double")
    got = correlate.ncc_table(px, 8, 2)
    assert not re.search(r"hashpartitioning\([^)]*dx#", got._jdf.queryExecution().executedPlan().toString())
    want = {}
    for wr, wc in ((0, 0), (0, 1), (1, 0), (1, 1)):
        r, c = 8 * wr, 8 * wc
        scores = {(dx, dy): np.corrcoef(base[r : r + 8, c : c + 8].ravel(), target[r + dy : r + dy + 8, c + dx : c + dx + 8].ravel())[0, 1] for dx in range(-2, 3) for dy in range(-2, 3) if 0 <= r + dy <= 9 and 0 <= c + dx <= 10}
        want[wr, wc] = max((v, k) for k, v in scores.items())
    rows = {(r.wr, r.wc): (r.score, (r.dx, r.dy)) for r in got.collect()}
    assert set(rows) == set(want) and all(rows[k][1] == v[1] and abs(rows[k][0] - v[0]) < 1e-9 for k, v in want.items())
