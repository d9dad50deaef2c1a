"""Queries and operators whose job once stopped short."""

from pyspark.sql import functions as F

from rasterloom.operators import correlate


def test_windows_of_the_whole_image(spark):
    """Corners every step, floor((n - (window + 2 margin)) / step) + 1 on a side; images that tiles don't fill, and one less than a tile."""
    window, step, reach = 16, 8, 4
    for rows, cols in ((61, 40), (50, 24), (48, 33)):
        px = spark.range(rows * cols).select(F.lit(7).cast("long").alias("pair_id"), F.floor(F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"), F.rand(1).alias("base"), F.rand(2).alias("target"))
        got = [(r.row, r.col) for r in correlate.correlate(correlate.halo_tiles(px, 16, reach, window - step), "spatial", window, step, reach).collect()]
        count = lambda n: (n - (window + 2 * reach)) // step + 1
        assert sorted(got) == [(reach + step * i, reach + step * j) for i in range(count(rows)) for j in range(count(cols))]


def test_ncc_subpixel_grid(spark, sf):
    from rasterloom.plans import catalogue

    height = catalogue.pixels(spark, sf).agg(F.max("row")).first()[0] + 1
    got = {(r.row, r.col) for r in catalogue.ncc_subpixel(spark, sf).collect()}
    assert got == {(4 + 8 * i, 4 + 8 * j) for i in range((height - 24) // 8 + 1) for j in range(6)}


def test_grid_and_pixel_count_grow_with_the_table(spark, tmp_path):
    from rasterloom.plans import catalogue

    days = spark.range(3 * 420).select((F.col("id") % 420).alias("user_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.floor(F.col("id") / 420) * 86400).alias("ts"), F.col("id").cast("double").alias("value"))
    days.filter("user_id < 400 OR ts < timestamp_seconds(1700000000 + 86400)").write.parquet(f"{tmp_path}/events.parquet")
    kept = catalogue.border_fill(spark, str(tmp_path)).filter("value IS NOT NULL")
    assert kept.count() == catalogue.cube(spark, str(tmp_path)).count() == 1220
    assert sorted(r.n_missing for r in catalogue.slice_weights(spark, str(tmp_path)).collect()) == [0, 20, 20]
