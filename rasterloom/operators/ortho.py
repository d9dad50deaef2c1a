"""Output grids, elevation, resampling and orthorectification on tables of pixels."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geodesy, rfm
from ..kernels import geodesy as geo
from ..kernels import pushbroom, sinc
from ..kernels.pushbroom import Sensor
from ..sources.rpc import Rfm
from .raster import bilinear, mean_where_missing
from .sensors import to_pixel


@dataclass(frozen=True)
class Grid:
    """An output image in a UTM projection."""

    left: float
    top: float
    res: float
    cols: int
    rows: int
    epsg: int

    @property
    def transform(self) -> tuple[float, ...]:
        return self.left, self.res, 0.0, self.top, 0.0, -self.res


def snapped(left: float, top: float, right: float, bottom: float, res: float) -> tuple[float, float, float, float]:
    """Edges moved inward to multiples of res, those within res / 1e5 of one kept."""

    def at(v: float, up: bool) -> float:
        r = v % res
        return v if min(r, res - r) < res / 1e5 else v - r + (res if up else 0.0)

    return at(left, True), at(top, False), at(right, False), at(bottom, True)


def map_grid(ground: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, ...]], width: int, height: int, res: float | None = None, epsg: int | None = None) -> Grid:
    """The snapped grid of an image's corners. ground: (cols, lines) to lon, lat; without res the smaller step of a central pixel."""
    lon, lat = ground(np.array([0, width - 1, 0, width - 1.0]), np.array([0, 0, height - 1, height - 1.0]))[:2]
    north = lat[0] > 0 if epsg is None else epsg < 32700
    zone = int(geo.utm_zone(lon[0])) if epsg is None else epsg % 100
    x, y = geo.to_utm(lon, lat, zone, north)
    if res is None:
        res = min(step_of(ground, width, height, zone, north))
    left, top, right, bottom = (float(v) for v in snapped(x.min(), y.max(), x.max(), y.min(), res))
    return Grid(left, top, float(res), int(round((right - left) / res)) + 1, int(round((top - bottom) / res)) + 1, (32600 if north else 32700) + zone)


def step_of(ground, width: int, height: int, zone: int, north: bool) -> tuple[float, float]:
    """Size of a central pixel in both directions of the map."""
    lon, lat = ground(np.array([width / 2, width / 2 + 1]), np.array([height / 2, height / 2 + 1]))[:2]
    x, y = geo.to_utm(lon, lat, zone, north)
    return abs(x[0] - x[1]), abs(y[0] - y[1])


def rfm_ground(m: Rfm, alt: float | None = None):
    own = m.scalars["HEIGHT_OFF"] if alt is None else alt
    return lambda c, r: rfm.invert(m, np.asarray(c, float), np.asarray(r, float), np.full(len(c), own))


def rfm_footprint(m: Rfm, width: int, height: int) -> list[tuple[float, float]]:
    """Closed ring (lon, lat) of the corners at the model's own height."""
    lon, lat = rfm_ground(m)(np.array([0, width - 1, width - 1, 0.0]), np.array([0, 0, height - 1, height - 1.0]))
    ring = list(zip(lon.tolist(), lat.tolist(), strict=True))
    return [*ring, ring[0]]


def rfm_geotransform(m: Rfm, width: int, height: int) -> tuple[float, ...]:
    """Least-squares affine (x0, dx, rx, y0, ry, dy) of lon and lat by column and line from the four corners."""
    c, r = np.array([0, width - 1, 0, width - 1.0]), np.array([0, 0, height - 1, height - 1.0])
    lon, lat = rfm_ground(m)(c, r)
    fit = np.linalg.lstsq(np.stack([c, r, np.ones(4)], axis=1), np.stack([lon, lat], axis=1), rcond=None)[0]
    return fit[2, 0], fit[0, 0], fit[1, 0], fit[2, 1], fit[0, 1], fit[1, 1]


def altitude_range(m: Rfm, k: float = 1.0) -> tuple[float, float]:
    s = m.scalars
    return s["HEIGHT_OFF"] - k * s["HEIGHT_SCALE"], s["HEIGHT_OFF"] + k * s["HEIGHT_SCALE"]


def grid_points(spark: SparkSession, g: Grid, strip_rows: int = 64) -> DataFrame:
    """(row, col, east, north, lon, lat) of the centres of a grid's pixels, a strip of rows a task."""
    n = -(-g.rows // strip_rows)
    rows = spark.range(0, n, 1, n).select(F.explode(F.sequence(F.col("id") * strip_rows, F.least((F.col("id") + 1) * strip_rows, F.lit(g.rows)) - 1)).alias("row"))
    at = rows.select(F.col("row").cast("int").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(g.cols - 1))).alias("col"))
    at = at.withColumns({"east": F.lit(g.left) + (F.col("col") + 0.5) * g.res, "north": F.lit(g.top) - (F.col("row") + 0.5) * g.res})
    lon, lat = geodesy.from_utm(F.col("east"), F.col("north"), F.lit(g.epsg % 100), F.lit(g.epsg < 32700))
    return at.select("*", lon.alias("lon"), lat.alias("lat"))


def with_elevation(points: DataFrame, dem: DataFrame, transform: tuple[float, ...], epsg: int, key: list[str], how: str = "bilinear", mean: bool = False) -> DataFrame:
    """Adds ``height`` at lon, lat from an elevation raster (row, col, value), null off it, or its mean with ``mean``.

    The raster keeps its projection: points are brought into it, not the
    raster to theirs.
    """
    x0, dx, _, y0, _, dy = transform
    if epsg == 4326:
        x, y = F.col("lon"), F.col("lat")
    else:
        x, y = geodesy.to_utm(F.col("lon"), F.col("lat"), F.lit(epsg % 100), F.lit(epsg < 32700))
    at = points.select(*key, ((x - x0) / dx - 0.5).alias("_x"), ((y - y0) / dy - 0.5).alias("_y"))
    if how == "nearest":
        px = dem.select(F.col("row").alias("_r"), F.col("col").alias("_c"), "value")
        got = at.withColumns({"_r": F.floor(F.col("_y") + 0.5).cast("int"), "_c": F.floor(F.col("_x") + 0.5).cast("int")}).join(px, ["_r", "_c"], "left").select(*key, F.col("value").alias("height"))
    else:
        got = bilinear(at.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(key)}), dem, [f"_k{i}" for i in range(len(key))], "_x", "_y").withColumnsRenamed({f"_k{i}": k for i, k in enumerate(key)} | {"value": "height"})
    out = points.join(got, key, "left")
    return mean_where_missing(out, "height") if mean else out


def sinc_sample(points: DataFrame, px: DataFrame, key: list[str], x: str, y: str, kernel: int = 15, step: float = 1.0, tile: int = 256) -> DataFrame:
    """(key, value): windowed sinc at fractional pixels, null where the kernel leaves the image or meets a missing pixel.

    Pixels are dealt to tiles with a halo of half the kernel, and each point
    goes to its own tile, so no task holds more than a tile and its points.
    """
    kernel = kernel if kernel > 0 and kernel % 2 else 15
    halo = kernel // 2 + 1
    kinds = dict(points.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in key) + ", value double"
    span = lambda c: F.sequence(F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile))
    dealt = px.select("row", "col", F.col("value").cast("double").alias("value")).withColumn("_r", F.explode(span("row"))).withColumn("_c", F.explode(span("col")))
    asked = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*key, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).withColumns({"_r": F.floor(F.rint("_y") / tile), "_c": F.floor(F.rint("_x") / tile)})

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out = np.full(b.num_rows, np.nan)
        if a.num_rows and b.num_rows:
            r, c = a.column("row").to_numpy(), a.column("col").to_numpy()
            image = np.full((r.max() - r.min() + 1, c.max() - c.min() + 1), np.nan)
            image[r - r.min(), c - c.min()] = a.column("value").to_numpy()
            out = sinc.resample(image, b.column("_y").to_numpy() - r.min(), b.column("_x").to_numpy() - c.min(), kernel, (step, step))
        return pa.table([*[b.column(k) for k in key], pa.array(out, mask=np.isnan(out))], names=[*key, "value"])

    met = dealt.groupBy("_r", "_c").cogroup(asked.groupBy("_r", "_c")).applyInArrow(run, schema)
    return points.select(*key).join(met, key, "left")


def sample(points: DataFrame, px: DataFrame, method: str, step: float = 1.0) -> DataFrame:
    """(row, col, value) of output pixels (row, col) from input places (x, y) of pixel centres."""
    at = points.select(F.col("row").alias("r"), F.col("col").alias("c"), F.col("x"), F.col("y"))
    got = bilinear(at, px, ["r", "c"], "x", "y") if method == "bilinear" else sinc_sample(at, px, ["r", "c"], "x", "y", step=step)
    return got.select(F.col("r").alias("row"), F.col("c").alias("col"), "value")


def _rectified(points: DataFrame, raw: DataFrame, method: str, step: float) -> DataFrame:
    value = sample(points, raw, method, step)
    return points.select("row", "col", "x", "y").join(value, ["row", "col"], "left")


def ortho_rfm(spark: SparkSession, raw: DataFrame, m: Rfm, width: int, height: int, res: float | None = None, dem: tuple[DataFrame, tuple, int] | None = None, correction: list[float] | None = None, method: str = "bilinear") -> tuple[Grid, DataFrame]:
    """The grid, and (row, col, x, y, value): each output pixel's place in the raw image and its value. dem: pixels, transform, EPSG."""
    g = map_grid(rfm_ground(m), width, height, res)
    at = grid_points(spark, g)
    at = with_elevation(at, *dem, ["row", "col"]) if dem else at.withColumn("height", F.lit(None).cast("double"))
    x, y = rfm.ground_to_image(m, F.col("lon"), F.col("lat"), F.col("height"), correction)
    native = min(step_of(rfm_ground(m), width, height, g.epsg % 100, g.epsg < 32700))
    return g, _rectified(at.select("row", "col", x.alias("x"), y.alias("y")), raw, method, max(1.0, g.res / native))


def ortho_rsm(spark: SparkSession, raw: DataFrame, m: Sensor, res: float | None = None, dem: tuple[DataFrame, tuple, int] | None = None, correction: np.ndarray | None = None, method: str = "bilinear", h: float = 0.0) -> tuple[Grid, DataFrame]:
    """As ``ortho_rfm`` with a rigorous model; pixels off the elevation raster take its mean, or h without one."""
    lines, cols = m.shape
    ground = lambda c, r: pushbroom.to_ground(m, c, r, h, correction)
    g = map_grid(ground, cols, lines, res)
    at = grid_points(spark, g)
    at = with_elevation(at, *dem, ["row", "col"], mean=True) if dem else at.withColumn("height", F.lit(h))
    placed = to_pixel(at.withColumnRenamed("col", "c"), m, alt="height", correction=correction)
    native = min(step_of(ground, cols, lines, g.epsg % 100, g.epsg < 32700))
    return g, _rectified(placed.select("row", F.col("c").alias("col"), F.col("col").alias("x"), F.col("line").alias("y")), raw, method, max(1.0, g.res / native))


def reproject(spark: SparkSession, px: DataFrame, transform: tuple[float, ...], epsg: int, to: Grid) -> DataFrame:
    """(row, col, value) of a raster on another grid, nearest pixels; both in UTM or geographic coordinates."""
    at = grid_points(spark, to)
    return with_elevation(at, px, transform, epsg, ["row", "col"], "nearest").select("row", "col", F.col("height").alias("value"))


def crop(px: DataFrame, transform: tuple[float, ...], left: float, top: float, right: float, bottom: float) -> tuple[tuple[float, ...], DataFrame]:
    """Pixels whose centres lie in a map window, numbered from its corner, and their transform. The limits reach the scan."""
    x0, dx, rx, y0, ry, dy = transform
    c0, c1 = int(np.ceil((left - x0) / dx - 0.5)), int(np.floor((right - x0) / dx - 0.5))
    r0, r1 = int(np.ceil((top - y0) / dy - 0.5)), int(np.floor((bottom - y0) / dy - 0.5))
    c0, r0 = max(c0, 0), max(r0, 0)
    kept = px.filter(F.col("row").between(r0, r1) & F.col("col").between(c0, c1))
    return (x0 + c0 * dx, dx, rx, y0 + r0 * dy, ry, dy), kept.withColumns({"row": F.col("row") - r0, "col": F.col("col") - c0})


def reprojected(points: Column, zone: int, north: bool) -> Column:
    """An array of struct(lon, lat) as struct(east, north)."""

    def one(p: Column) -> Column:
        e, n = geodesy.to_utm(p["lon"], p["lat"], F.lit(zone), F.lit(north))
        return F.struct(e.alias("east"), n.alias("north"))

    return F.transform(points, one)


def footprint_json(name: str, ring: list[tuple[float, float]], properties: dict | None = None) -> str:
    """A GeoJSON feature of a closed ring."""
    import json

    return json.dumps({"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[list(p) for p in ring]]}, "properties": {"name": name} | (properties or {})})


def transformer(kind: str, m: Rfm | None = None):
    """(to image, to ground) on columns or arrays: ``identity`` gives its input, ``rfm`` goes through a model."""
    if kind == "identity":
        return (lambda x, y, z=None: (x, y)), (lambda c, r, z=None: (c, r))
    if kind == "rfm" and m is not None:
        return (lambda lon, lat, alt=None: rfm.ground_to_image(m, lon, lat, alt)), (lambda c, r, alt: rfm.invert(m, c, r, alt))
    raise ValueError("kind is identity, or rfm with a model")


def orthorectify(spark: SparkSession, raw: DataFrame, m: Rfm | Sensor, width: int, height: int, res: float | None = None, dem: tuple[DataFrame, tuple, int] | None = None, correction=None, method: str = "sinc", gcps: DataFrame | None = None, loops: int = 3) -> tuple[Grid, DataFrame]:
    """An ortho image by whichever model; control points of a rigorous one first refine its correction."""
    if isinstance(m, Sensor):
        if gcps is not None:
            from . import gcps as control
            from .sensors import tables

            lines, cols = tables(spark, "model", m)
            gsd = min(step_of(lambda c, r: pushbroom.to_ground(m, c, r), width, height, gcps.first().epsg % 100, gcps.first().epsg < 32700))
            correction, _, _ = control.refine(gcps, lines, cols, "model", lambda g, c, loop: control.rsm_shifts(g, m, c, loop), gsd, loops)
        return ortho_rsm(spark, raw, m, res, dem, correction, method)
    return ortho_rfm(spark, raw, m, width, height, res, dem, correction, method)
