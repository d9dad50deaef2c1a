"""Command line, event studies, streams, text sinks and configurations."""

import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom import cli
from rasterloom.kernels import tiff
from rasterloom.operators import batch, cubes
from rasterloom.plans import event
from rasterloom.sources import text_sinks, text_tables
from rasterloom.sources.sample_rpc import RPC_TEXT
from rasterloom.streaming import measures


def test_transform_there_and_back(tmp_path, capsys):
    (tmp_path / "m.txt").write_text(RPC_TEXT)
    got = cli.main(["transform", "0,1000", "[0,500]", str(tmp_path / "m.txt")])
    assert got["lons"] == pytest.approx([30.52895296, 30.65688292], abs=1e-7) and got["lats"] == pytest.approx([41.24090926, 41.16826844], abs=1e-7)
    back = cli.main(["transform", ",".join(map(str, got["lons"])), ",".join(map(str, got["lats"])), str(tmp_path / "m.txt"), "--inv"])
    assert back["cols"] == pytest.approx([0, 1000], abs=1e-4) and json.loads(capsys.readouterr().out.strip().split("\n")[0])["alts"] == pytest.approx([1102.49239388] * 2)


def images(folder):
    rng = np.random.default_rng(1)
    f = np.fft.fftfreq(120)
    fx, fy = np.meshgrid(f, f)
    image = np.fft.ifft2(np.fft.fft2(rng.normal(size=(120, 120))) * np.exp(-40 * (fx * fx + fy * fy))).real.astype("float32")
    for name, r, c in (("a", 5, 5), ("b", 7, 8)):
        part = image[r : r + 100, c : c + 100]
        (folder / f"{name}.tif").write_bytes(tiff.encode([part, part[::-1].copy()], (1000.0, 2.0, 0.0, 5000.0, 0.0, -2.0), 32636))


def test_correlate_batch_and_bands(spark, tmp_path):
    images(tmp_path)
    out = cli.main(["correlate", str(tmp_path / "a.tif"), str(tmp_path / "b.tif"), str(tmp_path / "out"), "--method", "spatial", "--window", "16", "--step", "8", "--search", "6"])
    assert out.endswith("a_VS_b_spatial_wz_16_step_8.tif")
    with open(out, "rb") as f:
        h = tiff.header(f)
        ew = tiff.read_window(f, h, 1, 0, h.height, 0, h.width)
        assert h.descriptions == ["East/West", "North/South", "SNR"] and h.epsg == 32636 and h.transform[1] == 16.0
        assert np.median(ew) == pytest.approx(-6.0, abs=0.3) and np.median(tiff.read_window(f, h, 2, 0, h.height, 0, h.width)) == pytest.approx(4.0, abs=0.3)
    (tmp_path / "list.txt").write_text(f"{tmp_path}/a.tif\n\n{tmp_path}/b.tif\n")
    many = cli.main(["batch", str(tmp_path / "list.txt"), f"{tmp_path}/b.tif", str(tmp_path / "many"), "--mode", "many_to_many", "--window", "16", "--method", "spatial", "--search", "4"])
    assert len(many) == 1
    bands = cli.main(["multiband", str(tmp_path / "a.tif"), str(tmp_path / "bands"), "--window", "16", "--method", "spatial", "--search", "4"])
    assert len(bands) == 1 and "_bands_1_2" in bands[0]


def test_ortho_command(spark, tmp_path):
    (tmp_path / "m.txt").write_text(RPC_TEXT)
    (tmp_path / "raw.tif").write_bytes(tiff.encode([np.full((300, 300), 7, "uint16")]))
    (made,) = cli.main(["ortho", str(tmp_path / "raw.tif"), str(tmp_path / "m.txt"), str(tmp_path / "o"), "--gsd", "100", "--resampling", "bilinear"])
    with open(made, "rb") as f:
        h = tiff.header(f)
        got = tiff.read_window(f, h, 1, 0, h.height, 0, h.width)
    assert h.epsg == 32636 and h.transform[0] % 100 == 0 and h.nodata == 0 and set(np.unique(got)) == {0, 7}


def test_batch_faults(spark):
    a, b = spark.createDataFrame([("x",), ("y",)], "name string"), spark.createDataFrame([("z",)], "name string")
    assert sorted(map(tuple, batch.batch_jobs(a, b, "one_to_many", "name").collect())) == [("x", "z"), ("y", "z")]
    with pytest.raises(Exception, match="unequal"):
        batch.batch_jobs(a, b, "one_to_one", "name").collect()
    with pytest.raises(ValueError):
        batch.batch_jobs(a, b, "other", "name")
    with pytest.raises(Exception, match="lacks tile"):
        batch.zip_tiles([a.select(F.col("name").alias("t"), F.lit(1).alias("u")), b.select(F.col("name").alias("t"), F.lit(2).alias("v"))], "t").collect()


def test_event_study(spark):
    rows = [("a", "2020-01-01", 0, 0, 10, 10), ("b", "2020-02-01", 1, 1, 11, 11), ("c", "2021-01-01", 2, 0, 12, 10), ("d", "2021-02-01", 1, 2, 9, 12), ("e", "2021-03-01", 90, 90, 99, 99), ("a", "2019-01-01", 0, 0, 1, 1), (None, "2020-01-01", 0, 0, 1, 1)]
    df = spark.createDataFrame(rows, "name string, date string, minx int, miny int, maxx int, maxy int").withColumn("date", F.col("date").cast("timestamp_ntz"))
    s = event.study(df, "2020-06-01", 8.0, both_ways=True)
    assert {r.id for r in s.pre.collect()} == {"a", "b"} and {r.id for r in s.post.collect()} == {"c", "d", "e"}
    assert s.jobs.count() == 8 and s.sets.count() == 1 and s.combos.count() == 4


def test_streams(spark, tmp_path):
    at = tmp_path / "in"
    px = spark.range(100).select((F.col("id") % 2).alias("g"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.col("id").cast("double").alias("v"), F.array(F.lit(1), F.lit(2)).alias("t"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vs"))
    px.write.parquet(str(at))
    stream = spark.readStream.schema(px.schema).parquet(str(at))

    def run(df, mode, name):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
        return spark.table(name)

    got = run(measures.windowed_stats(stream, "ts", "v", ["g"]), "complete", "stats")
    assert got.count() == 4 and got.agg(F.sum("n")).first()[0] == 100
    g = {(r.t1, r.t2): r.g for r in run(measures.gram_updates(stream, ["g"], "t", "vs"), "complete", "gram").collect()}
    assert g[1, 1] == sum(i * i for i in range(100)) and g[1, 2] == sum(range(100)) and g[2, 2] == 100
    box = lambda d: d.select(F.col("id"), F.col("id").cast("double").alias("minx"), F.lit(0.0).alias("miny"), (F.col("id") + 0.5).alias("maxx"), F.lit(1.0).alias("maxy"))
    box(spark.range(5)).write.parquet(str(tmp_path / "boxes"))
    boxes = spark.readStream.schema(box(spark.range(1)).schema).parquet(str(tmp_path / "boxes"))
    assert run(measures.arriving_overlaps(boxes, box(spark.range(2, 9)), 2.0), "append", "met").count() == 3


def test_text_sinks(spark, tmp_path):
    tps = spark.createDataFrame([(1.0, 2.5, 3.0, 4.0)], "ref_x double, ref_y double, raw_x double, raw_y double")
    lines = [r.value for r in text_sinks.tie_point_lines(tps, "a", "b").orderBy("i").collect()]
    assert len(lines) == 5 and lines[0].startswith(";") and lines[-1] == "1.000000\t2.500000\t3.000000\t4.000000"
    cols = {c.split()[0]: F.lit(1.0 if "double" in c else 3 if "int" in c else "x") for c in text_sinks.GCP_SCHEMA.split(", ")}
    text_sinks.write_gcps(spark.range(2).withColumns(cols), str(tmp_path / "g"))
    back = text_tables.read_gcps(spark, str(tmp_path / "g"))
    assert back.count() == 2 and back.columns == list(cols)
    assert np.loadtxt(text_sinks.correction_text(np.arange(9)).split("\n")).tolist() == np.arange(9.0).reshape(3, 3).tolist()
    assert json.dumps({"a": np.float64(1.5), "b": np.arange(2)}, default=text_sinks.plain) == '{"a": 1.5, "b": [0, 1]}'
    m = text_sinks.matrix_lines(spark.createDataFrame([(0, [1.0, -2.0])], "i int, v array<double>"), "i", "v").first().value
    assert m.split() == [f"{1:.25f}", f"{-2:.25f}"]


def test_configs_listings_and_archives(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("opt: # loops\n  nb_loops: 4\n  snr_th: 0.9\n  names: [a, 'b']\n  on: true\nlist:\n  - 1\n  - two\nempty: ''\n")
    c = text_sinks.read_config(str(tmp_path / "c.yaml"))
    assert c == {"opt": {"nb_loops": 4, "snr_th": 0.9, "names": ["a", "b"], "on": True}, "list": [1, "two"], "empty": None}
    assert text_sinks.at(c, "opt.nb_loops") == 4 and text_sinks.at(c, "opt.none", 7) == 7
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for n in ("b.tif", "a.tif", "a.tif.aux.xml", "deep/c.tif"):
        (tmp_path / "in" / n).write_text("x")
    names = lambda df: [r.path.rsplit("/", 1)[-1] for r in df.collect()]
    assert names(text_sinks.listing(spark, str(tmp_path / "in"), ["*.tif"])) == ["a.tif", "b.tif"]
    assert names(text_sinks.listing(spark, str(tmp_path / "in"), suffixes=[".tif"], deep=True)) == ["a.tif", "b.tif", "c.tif"]
    assert names(text_sinks.listing(spark, str(tmp_path / "in"), without=["aux", "b."])) == ["a.tif"]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("x/y.txt", "hi")
    assert text_sinks.archive_members(str(tmp_path / "z.zip")) == ["x/y.txt"] and open(text_sinks.extract(str(tmp_path / "z.zip"), str(tmp_path / "out"))[0]).read() == "hi"
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../y.txt", "hi")
    with pytest.raises(ValueError):
        text_sinks.extract(str(tmp_path / "bad.zip"), str(tmp_path / "out"))


def test_masks_there_and_back(spark):
    mask = spark.createDataFrame([(0, 3), (2, 1), (2, 0)], "row int, col int")
    places = cubes.compact(mask)
    assert sorted(map(tuple, places.collect())) == [(0, 3, 0), (2, 0, 1), (2, 1, 2)]
    out = cubes.expand(places.select("i", (F.col("i") * 2.0).alias("value")), places, 3, 4)
    assert out.count() == 12 and {(r.row, r.col): r.value for r in out.filter("value IS NOT NULL").collect()} == {(0, 3): 0.0, (2, 0): 2.0, (2, 1): 4.0}
