"""Queries of the spline, sensor, elevation, correlation and displacement operators, each with SQL for the same rows.

Where an operator has no form in SQL, its input is made so that the result is
known: splines through polynomials, models there and back, a known shift.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import functions as F

from ..functions import geodesy, vectors
from ..kernels import pushbroom
from ..operators import displacement, gcps, ortho, sensors, splines
from ..sources import rasters
from . import correlation
from .catalogue import LAT, LON, MODEL, PX, _series, pixels, points, query, rounded, t

CUBIC = "(1 + 0.5e0 * {x} - 0.02e0 * {x} * {x} + 0.001e0 * {x} * {x} * {x})"
SQUARE = "(2 - 0.3e0 * {x} + 0.05e0 * {x} * {x})"
AT = "(p_partkey % 97 * 0.37e0 - 2)"


def _samples(spark, sf, formula: str):
    """Ten samples of a polynomial for each nation, at uneven places."""
    n = t(spark, sf, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i"))
    x = n.withColumn("x", F.col("i") * 3.3 + F.col("n_nationkey") * 0.01 + (F.col("i") % 2) * 0.4)
    return x.select(F.col("n_nationkey").alias("k"), "x", F.expr(formula.format(x="x")).alias("v"))


def _asked(spark, sf):
    return t(spark, sf, "part").select((F.col("p_partkey") % 25).cast("int").alias("k"), F.expr(AT).alias("x"))


def _spline(spark, sf, formula: str, degree: int):
    out = splines.spline(_asked(spark, sf), _samples(spark, sf, formula), "k", "x", ["v"], degree, chunks=4)
    return rounded(out, 6, x=F.col("x"), v=F.col("v"))


@query(f"SELECT CAST(p_partkey % 25 AS INT) AS k, round({AT}, 6) AS x, round({SQUARE.format(x=AT)}, 6) AS v FROM part")
def quadratic_spline(spark, sf):
    return _spline(spark, sf, SQUARE, 2)


@query(f"SELECT CAST(p_partkey % 25 AS INT) AS k, round({AT}, 6) AS x, round({CUBIC.format(x=AT)}, 6) AS v FROM part")
def cubic_spline(spark, sf):
    return _spline(spark, sf, CUBIC, 3)


_F = "greatest(0e0, least(1e0, (s_suppkey % 40) / 39e0))"


@query(f"SELECT s_suppkey AS k, round(sin(0.4e0 * {_F} * (1 + s_nationkey % 3)), 6) AS z, round(cos(0.4e0 * {_F} * (1 + s_nationkey % 3)), 6) AS w FROM supplier")
def slerp(spark, sf):
    """A turn about one axis: the quaternion's angle grows evenly."""
    s = t(spark, sf, "supplier")
    turn = 0.4 * (1 + s.s_nationkey % 3)
    ends = s.select(F.col("s_suppkey").alias("k"), F.explode(F.array(F.struct(F.lit(0.0).alias("x"), F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(2.0)).alias("q")), F.struct(F.lit(39.0).alias("x"), F.array(F.lit(0.0), F.lit(0.0), F.sin(turn), F.cos(turn)).alias("q")))).alias("e")).select("k", "e.*")
    at = s.select(F.col("s_suppkey").alias("k"), (s.s_suppkey % 40).cast("double").alias("x"))
    out = splines.slerp(at, ends, "k", "x", "q")
    return out.select("k", F.round(F.col("q")[2], 6).alias("z"), F.round(F.col("q")[3], 6).alias("w"))


_SURFACE = "(1 + 0.01e0 * {y} - 0.02e0 * {x} + 0.0003e0 * {x} * {y} + 0.0001e0 * {y} * {y})"
_X, _Y = "(s_suppkey * 0.73e0 % 60)", "(s_acctbal / 25)"


@query(f"SELECT s_suppkey, round({_SURFACE.format(x=_X, y=_Y)}, 4) AS value FROM supplier WHERE {_Y} BETWEEN 0 AND (SELECT max(vec_id) FROM embeddings)")
def image_spline(spark, sf):
    px = pixels(spark, sf).withColumn("value", F.expr(_SURFACE.format(x="col", y="row")))
    at = t(spark, sf, "supplier").select("s_suppkey", F.expr(_X).alias("x"), F.expr(_Y).alias("y"))
    out = splines.image_spline(at, px, ["s_suppkey"], "x", "y").filter("value IS NOT NULL")
    return rounded(out, 4, value=F.col("value"))


@query(f"WITH {PX} SELECT row, col, round(value, 5) AS value FROM px WHERE row BETWEEN 7 AND (SELECT max(row) FROM px) - 7 AND col BETWEEN 7 AND 56")
def sinc_resample(spark, sf):
    """At whole pixels the windowed sinc gives the pixels themselves."""
    px = pixels(spark, sf)
    at = px.select(F.col("row").alias("r"), F.col("col").alias("c"), F.col("row").cast("double").alias("y"), F.col("col").cast("double").alias("x"))
    out = ortho.sinc_sample(at, px, ["r", "c"], "x", "y", 15, tile=64).filter("value IS NOT NULL")
    return out.select(F.col("r").alias("row"), F.col("c").alias("col"), F.round("value", 5).alias("value"))


_EX, _EY = "((s_suppkey * 0.0137e0 % 0.8e0 + 30.01e0 - 30e0) / 0.0125e0 - 0.5e0)", "((41e0 - (41e0 - s_acctbal / 3000)) / 0.01e0 - 0.5e0)"


@query(f"WITH {PX}, p AS (SELECT s_suppkey, {_EX} AS x, {_EY} AS y FROM supplier), n AS (SELECT s_suppkey, (CASE WHEN i=0 THEN 1 - (x - floor(x)) ELSE x - floor(x) END) * (CASE WHEN j=0 THEN 1 - (y - floor(y)) ELSE y - floor(y) END) AS w, value FROM p, unnest([0,1]) AS a(i), unnest([0,1]) AS b(j) LEFT JOIN px ON px.row = floor(y) + j AND px.col = floor(x) + i) SELECT s_suppkey, round(CASE WHEN count(*) = count(value) THEN sum(w * value) END, 5) AS height FROM n GROUP BY 1")
def dem_bilinear(spark, sf):
    """Heights at lon, lat in a raster in geographic coordinates."""
    s = t(spark, sf, "supplier")
    at = s.select("s_suppkey", (s.s_suppkey * 0.0137 % 0.8 + 30.01).alias("lon"), (F.lit(41.0) - s.s_acctbal / 3000).alias("lat"))
    out = ortho.with_elevation(at, pixels(spark, sf), (30.0, 0.0125, 0.0, 41.0, 0.0, -0.01), 4326, ["s_suppkey"])
    return out.select("s_suppkey", F.round("height", 5).alias("height"))


@query(f"WITH {PX} SELECT row - 24 AS row, col - 5 AS col, round(value, 6) AS value FROM px WHERE 100 + (col + 0.5e0) * 2 BETWEEN 110 AND 160 AND 500 - (row + 0.5e0) * 2 BETWEEN 300 AND 452")
def crop_map(spark, sf):
    transform, px = ortho.crop(pixels(spark, sf), (100.0, 2.0, 0.0, 500.0, 0.0, -2.0), 110.0, 452.0, 160.0, 300.0)
    return rounded(px, value=F.col("value"))


_Q = [f"CAST(embedding[{i}] AS DOUBLE)" for i in (1, 2, 3, 4)]


@query(f"WITH q AS (SELECT vec_id, {_Q[0]} AS x, {_Q[1]} AS y, {_Q[2]} AS z, {_Q[3]} AS w FROM embeddings), n AS (SELECT *, x*x + y*y + z*z + w*w AS n FROM q) SELECT vec_id, round(2*(x*y - z*w)/n, 6) AS r01, round(2*(x*y + z*w)/n, 6) AS turned01, round(1 - 2*(y*y + z*z)/n, 6) AS r00, round(x / sqrt(x*x + y*y + z*z), 6) AS unit_x FROM n")
def quat_conventions(spark, sf):
    """Vendors that turn axes instead of vectors have the transposed matrix; rows brought to unit length."""
    e = t(spark, sf, "embeddings")
    x, y, z, w = (e.embedding[i].cast("double") for i in range(4))
    r = vectors.quaternion_matrix(w, x, y, z)
    return e.select("vec_id", F.round(r[1], 6).alias("r01"), F.round(vectors.transposed(r)[1], 6).alias("turned01"), F.round(r[0], 6).alias("r00"), F.round(vectors.unit((x, y, z))[0], 6).alias("unit_x"))


UTM36 = f"""p AS (SELECT c_custkey, {LON} AS lon, {LAT} AS lat FROM customer),
s AS (SELECT *, radians(lon - 33) AS d, sinh(atanh(sin(radians(lat))) - {geodesy.E!r}::DOUBLE * atanh({geodesy.E!r}::DOUBLE * sin(radians(lat)))) AS tt FROM p),
u AS (SELECT *, atan2(tt, cos(d)) AS xi, atanh(sin(d) / sqrt(1 + tt * tt)) AS eta FROM s),
m AS (SELECT *, {geodesy.K0 * geodesy.RADIUS!r}::DOUBLE * (eta{_series(geodesy.ALPHA, ('cos', 'sinh'))}) + 500000 AS east, {geodesy.K0 * geodesy.RADIUS!r}::DOUBLE * (xi{_series(geodesy.ALPHA, ('sin', 'cosh'))}) AS north FROM u)"""


@query(f"WITH {UTM36} SELECT c_custkey, round(lon, 8) AS lon, round(lat, 8) AS lat, 0e0 AS alt, round(east, 3) AS x_map, round(north, 3) AS y_map, c_custkey * 0.5e0 AS xPix, 32636 AS epsg, 1e0 AS weight FROM m")
def tie_points_to_gcps(spark, sf):
    """Control points of tie points in a georeferenced image: the places that were projected into it."""
    p = points(spark, sf)
    e, n = geodesy.to_utm(p.lon, p.lat, F.lit(36), F.lit(True))
    tps = p.select(((e - 298475.0) / 10).alias("ref_x"), ((F.lit(4550925.0) - n) / 10).alias("ref_y"), (p.c_custkey * 0.5).alias("raw_x"), F.lit(0.0).alias("raw_y"))
    out = gcps.from_tie_points(tps, (298475.0, 10.0, 0.0, 4550925.0, 0.0, -10.0), 32636)
    return out.select((F.col("xPix") * 2).cast("long").alias("c_custkey"), F.round("lon", 8).alias("lon"), F.round("lat", 8).alias("lat"), "alt", F.round("x_map", 3).alias("x_map"), F.round("y_map", 3).alias("y_map"), "xPix", "epsg", "weight")


@query(f"WITH {UTM36} SELECT c_custkey, round(east, 3) AS east, round(north, 3) AS north FROM m")
def polygon_reproject(spark, sf):
    p = points(spark, sf)
    ring = F.array(F.struct(p.lon.alias("lon"), p.lat.alias("lat")))
    out = p.select("c_custkey", ortho.reprojected(ring, 36, True)[0].alias("q"))
    return out.select("c_custkey", F.round("q.east", 3).alias("east"), F.round("q.north", 3).alias("north"))


@cache
def model(lines: int = 400, cols: int = 300, tilt: float = 0.0) -> pushbroom.Sensor:
    """A circular orbit over the tables' region, looking down or tilted across the track."""
    t_ = np.arange(lines) * 0.0015
    a, r = np.radians(41) + 1.05e-3 * t_, 6378137 + 8e5
    lon = np.radians(31 + tilt * 8)
    p = r * np.stack([np.cos(a) * np.cos(lon), np.cos(a) * np.sin(lon), np.sin(a)], axis=1)
    v = r * 1.05e-3 * np.stack([-np.sin(a) * np.cos(lon), -np.sin(a) * np.sin(lon), np.cos(a)], axis=1)
    look = np.stack([np.linspace(-0.002, 0.002, cols) + tilt, np.zeros(cols), -np.ones(cols)], axis=1)
    return pushbroom.Sensor(p, np.repeat(np.eye(3)[None], lines, axis=0), pushbroom.orbital_frame(p, v), pushbroom.unit(look), v)


@query("SELECT p_partkey, round(p_partkey * 0.37e0 % 299, 3) AS col, round(p_retailprice % 399, 3) AS line, round(p_size * 10e0, 2) AS alt FROM part")
def rsm_round_trip(spark, sf):
    """Pixels to the ground at a height and back through a push-broom model: the pixels themselves."""
    p = t(spark, sf, "part").select("p_partkey", F.expr("p_partkey * 0.37e0 % 299").alias("x"), F.expr("p_retailprice % 399").alias("y"), F.expr("p_size * 10e0").alias("h"))
    ground = sensors.to_ground(p, model(), "x", "y", "h")
    back = sensors.to_pixel(ground.withColumnRenamed("alt", "found"), model(), alt="h")
    return back.select("p_partkey", F.round("col", 3).alias("col"), F.round("line", 3).alias("line"), F.round("h", 2).alias("alt"))


@query("SELECT s_suppkey, round((s_suppkey % 30) * 0.1e0 - 1, 3) AS ew, round((s_nationkey % 7) * -0.2e0, 3) AS ns, round((s_suppkey % 11) * 0.3e0, 3) AS dz FROM supplier")
def displacement_3d(spark, sf):
    """Points that moved by known amounts, seen from four orbits: east, north (its sign turned) and up."""
    s = t(spark, sf, "supplier")
    place = s.select("s_suppkey", F.col("s_suppkey").cast("int").alias("row"), F.lit(0).alias("col"), (F.lit(330000.0) + s.s_suppkey * 7).alias("x"), (F.lit(4560000.0) + s.s_nationkey * 11).alias("y"), F.expr("(s_suppkey % 30) * 0.1e0 - 1").alias("e"), F.expr("(s_nationkey % 7) * 0.2e0").alias("n"), F.expr("(s_suppkey % 11) * 0.3e0").alias("u"))
    df = place.select("row", "col", "x", "y", F.lit(0.0).alias("ew_pre"), F.lit(0.0).alias("ns_pre"), *[F.col(c).alias(f"{k}_{i}") for i in ("post1", "post2") for c, k in (("e", "ew"), ("n", "ns"))], *[F.lit(500.0).alias(f"h_{i}") for i in ("base", "pre")], *[(F.col("u") + 500.0).alias(f"h_{i}") for i in ("post1", "post2")], *[(F.col("row") % 390 + 0.5).alias(f"line_{i}") for i in displacement.NAMES])
    out = displacement.displacement(df, [model(tilt=v).position for v in (0.0, 0.3, -0.2, 0.25)], 32636)
    return out.select(F.col("row").cast("long").alias("s_suppkey"), F.round("ew", 3).alias("ew"), F.round("ns", 3).alias("ns"), F.round("dz", 3).alias("dz"))


@query("SELECT CAST(i AS INT) AS row, CAST(j AS INT) AS col, -6e0 AS ew, 3e0 AS ns FROM unnest(range(0, (SELECT (max(vec_id) - 32 - 8) // 8 + 1 FROM embeddings))) AS a(i), unnest(range(0, (62 - 32 - 8) // 8 + 1)) AS b(j)")
def corr_pipeline(spark, sf):
    """Two images in one projection, the second moved by whole pixels: shifts in map units at every measure."""
    px = pixels(spark, sf)
    rows = (px.agg(F.max("row").alias("r")).first().r or 0) + 1
    base = px.filter("row >= 1 AND col >= 2").withColumns({"row": F.col("row") - 1, "col": F.col("col") - 2})
    p = correlation.Params("spatial", 32, 8, 4)
    place = {"x0": 300000.0, "y0": 4600000.0, "dx": 3.0, "dy": 3.0, "epsg": 32636}
    _, out = correlation.run(spark, px, correlation.Image(64, rows, **place), base, correlation.Image(62, rows - 1, **place), p)
    return out.select("row", "col", F.round("ew", 0).alias("ew"), F.round("ns", 0).alias("ns"))


@query()
def ortho_rfm(spark, sf):
    """An ortho image of the sample scene's model: places of output pixels in the raw image, and their values."""
    raw = pixels(spark, sf)
    g, out = ortho.ortho_rfm(spark, raw, MODEL, 6000, 6000, 600.0)
    return rounded(out, 4, x=F.col("x"), y=F.col("y"), value=F.col("value"))


def _folder(spark) -> str:
    """A new folder that driver and executors share: under the checkpoint folder, or on one machine a temporary one."""
    import tempfile
    import uuid

    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared and not shared.startswith("file:") and "://" in shared:
        raise RuntimeError("raster files need a folder mounted on all machines")
    return f"{shared.split(':', 1)[-1].replace('//', '/')}/rasters-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="rasters-")


@query(f"WITH {PX} SELECT row, col, 1 AS band, round(value, 5) AS value FROM px WHERE row BETWEEN 10 AND 300 AND col BETWEEN 3 AND 50")
def raster_files(spark, sf):
    """Pixels written as a TIFF file, and a window of it read again: whole tiles are read, the rest is cut."""
    px = pixels(spark, sf).select(F.lit("image").alias("raster_id"), F.lit(1).alias("band"), "row", "col", "value")
    path = rasters.write_rasters(rasters.tiles_of(px, 64), _folder(spark), "float64", (0.0, 1.0, 0.0, 0.0, 0.0, -1.0), 32636).first().path
    back = rasters.pixels(rasters.read_tiles(spark, path, 64, (3, 50, 10, 300)))
    return back.select("row", "col", "band", F.round("value", 5).alias("value"))


@query(f"WITH {PX} SELECT row, col, round(value, 5) AS ew, round(value * 2, 5) AS ns, round(abs(value), 5) AS snr FROM px WHERE row < 100")
def correlation_files(spark, sf):
    """A correlation's three bands through a file."""
    px = pixels(spark, sf).filter("row < 100").select(F.lit("c").alias("raster_id"), F.posexplode(F.array("value", F.col("value") * 2, F.abs("value"))).alias("b", "v"), "row", "col")
    tiles = rasters.tiles_of(px.select("raster_id", (F.col("b") + 1).alias("band"), "row", "col", F.col("v").alias("value")), 64)
    path = rasters.write_rasters(tiles, _folder(spark), "float64", descriptions=["East/West", "North/South", "SNR"]).first().path
    return rounded(rasters.correlation_product(rasters.pixels(rasters.read_tiles(spark, path))), 5, ew=F.col("ew"), ns=F.col("ns"), snr=F.col("snr")).drop("raster_id")


@query("SELECT n_nationkey AS k, ceil((300007 + n_nationkey) / 10e0) * 10 AS grid_left, floor((4600011 - n_nationkey * 3) / 10e0) * 10 AS grid_top, CAST((floor((300007 + n_nationkey + 198) / 10e0) - ceil((300007 + n_nationkey) / 10e0)) + 1 AS INT) AS cols, CAST((floor((4600011 - n_nationkey * 3) / 10e0) - ceil((4600011 - n_nationkey * 3 - 158) / 10e0)) + 1 AS INT) AS rows, 32636 AS epsg FROM nation")
def map_grid(spark, sf):
    """Snapped output grids of images whose corners lie on known map places."""
    from ..kernels import geodesy as geo

    def one(k: int):
        ground = lambda c, r: geo.from_utm(300007 + k + 2 * c, 4600011 - 3 * k - 2 * r, 36, True)
        g = ortho.map_grid(ground, 100, 80, 10.0)
        return k, round(g.left, 3), round(g.top, 3), g.cols, g.rows, g.epsg

    keys = [r.n_nationkey for r in t(spark, sf, "nation").select("n_nationkey").collect()]
    return spark.createDataFrame([one(k) for k in keys], "k int, grid_left double, grid_top double, cols int, rows int, epsg int")


@query("SELECT p_partkey, true AS on_surface FROM part")
def ground_on_terrain(spark, sf):
    """Pixels to the ground on a sloping surface by rounds of heights: each point ends on it."""
    p = t(spark, sf, "part").select("p_partkey", F.expr("p_partkey * 0.37e0 % 299").alias("x"), F.expr("p_retailprice % 399").alias("y"))
    slope = lambda lat: 100 + (lat - 41) * 2000
    out = sensors.to_ground_on(p, model(), lambda d: d.withColumn("height", slope(F.col("lat"))), "x", "y")
    return out.select("p_partkey", (F.abs(F.col("alt") - slope(F.col("lat"))) < 0.1).alias("on_surface"))


@cache
def _plane():
    """A raw image of a plane in map coordinates through a model, and the grid of its ortho image."""
    from ..kernels import geodesy as geo

    m = model(120, 90)
    r, c = np.mgrid[0:120, 0:90]
    lon, lat, _ = pushbroom.to_ground(m, c.ravel(), r.ravel(), 0.0)
    e, n = geo.to_utm(lon, lat, 36, True)
    image = ((e - 300000) / 1e4 + (n - 4500000) / 1e4).reshape(120, 90)
    return image, ortho.map_grid(lambda x, y: pushbroom.to_ground(m, x, y, 0.0), 90, 120, 60.0)


_G = _plane()[1]


@query(f"SELECT CAST(i AS INT) AS row, CAST(j AS INT) AS col, round(({float(_G.left)!r} + (j + 0.5e0) * 60 - 300000) / 1e4 + ({float(_G.top)!r} - (i + 0.5e0) * 60 - 4500000) / 1e4, 3) AS value FROM unnest(range({_G.rows // 2 - 5}, {_G.rows // 2 + 5})) AS a(i), unnest(range({_G.cols // 2 - 5}, {_G.cols // 2 + 5})) AS b(j)")
def ortho_rsm(spark, sf):
    """An ortho image by a push-broom model: the middle of a plane comes back as that plane."""
    image, g = _plane()
    raw = spark.createDataFrame([(r, c, float(image[r, c])) for r in range(120) for c in range(90)], "row int, col int, value double")
    _, out = ortho.ortho_rsm(spark, raw, model(120, 90), 60.0)
    mid = out.filter(F.col("row").between(g.rows // 2 - 5, g.rows // 2 + 4) & F.col("col").between(g.cols // 2 - 5, g.cols // 2 + 4))
    return mid.select("row", "col", F.round("value", 3).alias("value"))


@query("SELECT CAST(vec_id AS INT) AS row, CAST(i AS INT) AS col, 2e0 AS ew, 1e0 AS ns, 0.5e0 AS dz FROM embeddings, unnest(range(0, 4)) AS r(i)")
def three_d_job(spark, sf):
    """Three displacement maps of one grid joined by pixel, with heights and raw lines looked up, to a 3-D displacement."""
    at = t(spark, sf, "embeddings").select(F.col("vec_id").cast("int").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("col"))
    maps = {n: at.select("row", "col", F.lit(e).alias("ew"), F.lit(v).alias("ns")) for n, e, v in (("pre", 0.0, 0.0), ("post1", 2.0, -1.0), ("post2", 2.0, -1.0))}
    lines = {n: at.select("row", "col", (F.col("row") % 390 + 0.5).alias("line")) for n in displacement.NAMES}
    # a surface whose height at a moved point is half a metre more
    heights = lambda d: d.withColumn("height", 500.0 + F.when(F.abs(F.col("_x") - F.col("x")) > 1, 0.5).otherwise(0.0))
    df = displacement.combination(maps, (330000.0, 4.0, 0.0, 4560000.0, 0.0, -4.0), heights, lines)
    out = displacement.displacement(df, [model(tilt=v).position for v in (0.0, 0.3, -0.2, 0.25)], 32636)
    return out.select("row", "col", *[F.round(c, 3).alias(c) for c in ("ew", "ns", "dz")])


@query("SELECT s_suppkey AS ref_x, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal ELSE s_acctbal - 0.25e0 * 5 END AS x_map, CASE WHEN s_suppkey % 3 = 0 THEN 0e0 ELSE 0.8e0 END AS weight FROM supplier")
def gcp_update(spark, sf):
    """Control points moved by measured shifts; without a measure they stay, of no weight."""
    s = t(spark, sf, "supplier")
    points_ = s.select(s.s_suppkey.cast("string").alias("gcp_id"), s.s_acctbal.alias("x_map"), F.lit(4560000.0).alias("y_map"), F.lit(1.0).alias("weight"), F.lit(31.0).alias("lon"), F.lit(41.0).alias("lat"), F.lit(32636).alias("epsg"))
    shifts = s.select(s.s_suppkey.cast("string").alias("gcp_id"), F.lit(0.25).alias("dx"), F.lit(0.0).alias("dy"), F.when(s.s_suppkey % 3 == 0, 0.0).otherwise(0.8).alias("snr"))
    out = gcps.moved(points_, shifts, 5.0)
    return out.select(F.col("gcp_id").cast("long").alias("ref_x"), "x_map", "weight")
