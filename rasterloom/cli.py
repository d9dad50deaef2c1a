"""Command line: ``python -m rasterloom.cli transform|ortho|correlate|batch|multiband|study``."""

from __future__ import annotations

import argparse
import json
import os

import numpy as np

from .functions import rfm
from .kernels import tiff
from .operators import batch, ortho
from .plans import correlation, event
from .sources import metadata, rasters
from .sources.rpc import load_rfm
from .sources.text_sinks import expand_images
from .sources.text_tables import correlation_name


def numbers(text: str) -> list[float]:
    """Of a comma separated list, in brackets or not."""
    return [float(v) for v in text.strip("[] ").split(",") if v.strip()]


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("rasterloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rasterloom")
    sub = p.add_subparsers(dest="module", required=True)
    t = sub.add_parser("transform", help="pixels to the ground, or ground to pixels with --inv")
    t.add_argument("x", type=numbers)
    t.add_argument("y", type=numbers)
    t.add_argument("model", help="RPC text file")
    t.add_argument("--alt", type=numbers)
    t.add_argument("--inv", action="store_true")
    o = sub.add_parser("ortho", help="orthorectify raw images by a model")
    o.add_argument("image")
    o.add_argument("model", help="RPC text or scene metadata")
    o.add_argument("out")
    o.add_argument("--sensor", help="for scene metadata")
    o.add_argument("--dem")
    o.add_argument("--gsd", type=float)
    o.add_argument("--resampling", choices=["bilinear", "sinc"], default="sinc")
    for name in ("correlate", "batch", "multiband"):
        c = sub.add_parser(name)
        c.add_argument("base", help="image, list or .txt file")
        if name != "multiband":
            c.add_argument("target")
        c.add_argument("out")
        c.add_argument("--base-band", type=int, default=1)
        c.add_argument("--target-band", type=int, default=1)
        c.add_argument("--method", choices=["frequency", "spatial"], default="frequency")
        c.add_argument("--window", type=int, default=64)
        c.add_argument("--step", type=int, default=8)
        c.add_argument("--search", type=int, default=10)
        c.add_argument("--grid", action="store_true")
        c.add_argument("--pixel-based", action="store_true")
        if name == "batch":
            c.add_argument("--mode", choices=["one_to_one", "one_to_many", "many_to_many"], default="one_to_many")
        if name == "multiband":
            c.add_argument("--bands", help="pairs like 1,2;3,4; all without it")
    s = sub.add_parser("study", help="jobs of an event from a catalogue of images in CSV")
    s.add_argument("catalogue")
    s.add_argument("event", help="date")
    s.add_argument("out")
    s.add_argument("--cell", type=float, required=True)
    s.add_argument("--overlap", type=float)
    return p


def transform(a) -> dict:
    m = load_rfm(a.model)
    x, y = np.array(a.x), np.array(a.y)
    alt = np.array(a.alt) if a.alt else np.full(len(x), m.scalars["HEIGHT_OFF"])
    if a.inv:
        lat, lon, h = rfm.normalised(m, x, y, alt)
        s = m.scalars
        c, r = rfm.polynomial(m.samp_num, lat, lon, h) / rfm.polynomial(m.samp_den, lat, lon, h), rfm.polynomial(m.line_num, lat, lon, h) / rfm.polynomial(m.line_den, lat, lon, h)
        return {"cols": (c * s["SAMP_SCALE"] + s["SAMP_OFF"]).tolist(), "lines": (r * s["LINE_SCALE"] + s["LINE_OFF"]).tolist()}
    lon, lat = rfm.invert(m, x, y, alt)
    return {"lons": lon.tolist(), "lats": lat.tolist(), "alts": alt.tolist()}


def image_of(path: str) -> tuple[correlation.Image, tiff.Header]:
    with open(path, "rb") as f:
        h = tiff.header(f)
    if h.transform:
        x0, dx, _, y0, _, dy = h.transform
        return correlation.Image(h.width, h.height, x0, y0, abs(dx), abs(dy), h.epsg), h
    return correlation.Image(h.width, h.height), h


def _pixels(spark, path: str, band: int):
    return rasters.pixels(rasters.read_tiles(spark, path, bands=[band])).select("row", "col", "value")


def _correlated(spark, a, base: str, target: str, bands: tuple[int, int], suffix: str = "") -> str:
    p = correlation.Params(a.method, a.window, a.step, a.search, a.grid, a.pixel_based)
    d, out = correlation.run(spark, _pixels(spark, base, bands[0]), image_of(base)[0], _pixels(spark, target, bands[1]), image_of(target)[0], p)
    row = spark.range(1).select(correlation_name(_lit(base), _lit(target), a.method, a.window, a.step).alias("n")).first()
    name = row.n.removesuffix(".tif") + suffix
    from pyspark.sql import functions as F

    three = out.select(F.lit(name).alias("raster_id"), "row", "col", F.posexplode(F.array("ew", "ns", "snr")).alias("b", "value")).select("raster_id", (F.col("b") + 1).alias("band"), "row", "col", "value")
    written = rasters.write_rasters(rasters.tiles_of(three, 256), a.out, "float32", d["transform"], d["epsg"], None, ["East/West", "North/South", "SNR"])
    return written.first().path


def _lit(v):
    from pyspark.sql import functions as F

    return F.lit(v)


def main(argv: list[str] | None = None) -> object:
    a = parser().parse_args(argv)
    if a.module == "transform":
        got = transform(a)
        print(json.dumps(got))
        return got
    spark = session()
    from pyspark.sql import functions as F

    if a.module == "ortho":
        dem = None
        if a.dem:
            im, h = image_of(a.dem)
            dem = (_pixels(spark, a.dem, 1), h.transform, h.epsg or 4326)
        made = []
        for path in expand_images(a.image):
            raw, (im, _) = _pixels(spark, path, 1), image_of(path)
            if a.sensor:
                g, px = ortho.ortho_rsm(spark, raw, metadata.build(a.model, a.sensor), a.gsd, dem, method=a.resampling)
            else:
                g, px = ortho.ortho_rfm(spark, raw, load_rfm(a.model), im.width, im.height, a.gsd, dem, method=a.resampling)
            name = f"ORTHO_{os.path.splitext(os.path.basename(path))[0]}"
            out = px.select(F.lit(name).alias("raster_id"), F.lit(1).alias("band"), "row", "col", "value")
            made.append(rasters.write_rasters(rasters.tiles_of(out, 256), a.out, "uint16", g.transform, g.epsg, 0).first().path)
        return made
    if a.module == "study":
        images = spark.read.option("header", True).option("inferSchema", True).csv(a.catalogue)
        s = event.study(images.withColumn("date", F.col("date").cast("timestamp_ntz")), a.event, a.cell, a.overlap)
        for name in ("jobs", "sets", "combos"):
            getattr(s, name).write.mode("overwrite").option("header", True).csv(f"{a.out}/{name}")
        return a.out
    if a.module == "multiband":
        n = image_of(a.base)[1].bands
        pairs = spark.range(1).select(F.explode(batch.band_pairs(F.lit(n), F.lit(a.bands))).alias("p")).select("p.*").collect()
        if not pairs:
            raise ValueError("an image of two bands at least is needed")
        return [_correlated(spark, a, a.base, a.base, (p.i, p.j), f"_bands_{p.i}_{p.j}") for p in pairs]
    bases, targets = expand_images(a.base), expand_images(a.target)
    if a.module == "correlate":
        return _correlated(spark, a, bases[0], targets[0], (a.base_band, a.target_band))
    frame = lambda x: spark.createDataFrame([(v,) for v in x], "name string")
    jobs = batch.batch_jobs(frame(bases), frame(targets), a.mode, "name").collect()
    return [_correlated(spark, a, j.base, j.target, (a.base_band, a.target_band)) for j in jobs]


if __name__ == "__main__":
    main()
