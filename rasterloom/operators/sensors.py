"""Push-broom models as tables, and points through them.

A model is three tables' worth of rows: ``lines`` (model, line, pos, vel,
to_orbit, to_earth as arrays) and ``cols`` (model, col, look). It is as large
as an image has lines and columns, so a model is broadcast to the tasks that
map points through it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geodesy, vectors
from ..kernels import pushbroom
from ..kernels.pushbroom import Sensor
from .stats import plane_fit

LINES = "model string, line int, pos array<double>, vel array<double>, to_orbit array<double>, to_earth array<double>"
COLS = "model string, col int, look array<double>"


def tables(spark: SparkSession, name: str, m: Sensor) -> tuple[DataFrame, DataFrame]:
    """The model as tables (to be written and read instead of pickled objects)."""
    vel = m.velocity if m.velocity is not None else np.zeros_like(m.position)
    lines = [(name, i, m.position[i].tolist(), vel[i].tolist(), m.to_orbit[i].ravel().tolist(), m.to_earth[i].ravel().tolist()) for i in range(m.shape[0])]
    return spark.createDataFrame(lines, LINES), spark.createDataFrame([(name, i, m.look[i].tolist()) for i in range(m.shape[1])], COLS)


def sensor(lines: DataFrame, cols: DataFrame, name: str) -> Sensor:
    """One model from its tables: its lines and columns go to the driver."""
    r = lines.filter(F.col("model") == name).orderBy("line").toPandas()
    look = cols.filter(F.col("model") == name).orderBy("col").toPandas()
    of = lambda c, *shape: np.array(r[c].tolist(), float).reshape(-1, *shape)
    return Sensor(of("pos", 3), of("to_orbit", 3, 3), of("to_earth", 3, 3), np.array(look["look"].tolist(), float).reshape(-1, 3), of("vel", 3))


def _mapped(df: DataFrame, wanted: list[str], added: list[str], f) -> DataFrame:
    """The table with double columns added by a function of arrays of its columns."""
    names = df.columns

    def run(batches):
        for b in batches:
            args = [np.asarray(b.column(names.index(c)).to_numpy(zero_copy_only=False), float) for c in wanted]
            out = f(*args)
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(v, pa.float64(), mask=~np.isfinite(v)) for v in out]], names=[*names, *added])

    from pyspark.sql.types import DoubleType, StructType

    schema = StructType([*df.schema.fields])
    for c in added:
        schema = schema.add(c, DoubleType())
    return df.mapInArrow(run, schema)


def to_ground(df: DataFrame, m: Sensor, col: str = "col", line: str = "line", height: str | None = None, correction: np.ndarray | None = None) -> DataFrame:
    """Adds lon, lat, alt of pixels at the height of a column (0 without one)."""
    shared = df.sparkSession.sparkContext.broadcast(m)
    df = df if height else df.withColumn("_h", F.lit(0.0))
    out = _mapped(df, [col, line, height or "_h"], ["lon", "lat", "alt"], lambda x, y, h: pushbroom.to_ground(shared.value, x, y, np.nan_to_num(h), correction))
    return out if height else out.drop("_h")


def to_ground_on(df: DataFrame, m: Sensor, heights, col: str = "col", line: str = "line", correction: np.ndarray | None = None, rounds: int = 10, close: float = 1e-3) -> DataFrame:
    """Adds lon, lat, alt on a surface: ``heights`` adds a column height to a table with lon and lat.

    A round maps all points and looks their heights up by a join; rounds end
    when no height changes by ``close``. Points off the surface keep theirs.
    """
    now = df.withColumn("_h", F.lit(0.0))
    for _ in range(rounds):
        met = heights(to_ground(now, m, col, line, "_h", correction)).withColumn("_n", F.coalesce("height", "_h"))
        moved = met.agg(F.max(F.abs(F.col("_n") - F.col("_h"))).alias("d")).first().d
        now = met.select(*df.columns, F.col("_n").alias("_h"))
        if moved is None or moved < close:
            break
    return to_ground(now, m, col, line, "_h", correction).drop("_h")


def to_pixel(df: DataFrame, m: Sensor, lon: str = "lon", lat: str = "lat", alt: str = "alt", correction: np.ndarray | None = None) -> DataFrame:
    """Adds col, line of ground points, null where none is found."""
    shared = df.sparkSession.sparkContext.broadcast(m)
    return _mapped(df, [lon, lat, alt], ["col", "line"], lambda x, y, h: pushbroom.to_pixel(shared.value, x, y, h, correction))


def _times(r: Column, v: vectors.Vec) -> vectors.Vec:
    """A rotation, nine numbers by rows, times a vector."""
    return tuple(r[3 * i] * v[0] + r[3 * i + 1] * v[1] + r[3 * i + 2] * v[2] for i in range(3))


def look_errors(gcps: DataFrame, lines: DataFrame, cols: DataFrame) -> DataFrame:
    """Points (model, gcp_id, lon, lat, alt, xpix, ypix, weight) with the error of the look direction: ux, uy, uz.

    The error is the unit vector from the satellite to the point less the
    model's direction at the point's whole pixel: two equi-joins and expressions.
    """
    at = gcps.withColumns({"line": F.floor("ypix").cast("int"), "col": F.floor("xpix").cast("int")})
    met = at.join(lines.select("model", "line", "pos", "to_orbit", "to_earth"), ["model", "line"]).join(cols, ["model", "col"])
    vec = lambda c: tuple(F.col(c)[i] for i in range(3))
    aim = _times(F.col("to_earth"), vectors.unit(_times(F.col("to_orbit"), vectors.unit(vec("look")))))
    x, y, z = geodesy.to_ecef(F.col("lon"), F.col("lat"), F.col("alt"))
    seen = vectors.unit(tuple(a - F.col("pos")[i] for i, a in enumerate((x, y, z))))
    return met.select(*gcps.columns, *[(a - b).alias(n) for a, b, n in zip(seen, aim, ("ux", "uy", "uz"), strict=True)])


def refinement(gcps: DataFrame, lines: DataFrame, cols: DataFrame) -> DataFrame:
    """(model, correction): the nine numbers, by rows, of the planes through the look errors in (x, y, 1), weighted."""
    e = look_errors(gcps, lines, cols)
    fits = [plane_fit(e, F.col("xpix"), F.col("ypix"), F.col("weight"), F.col(u), ["model"]).select("model", *[F.col(c).alias(f"{c}{i}") for c in "abc"]) for i, u in enumerate(("ux", "uy", "uz"))]
    met = fits[0].join(fits[1], "model").join(fits[2], "model")
    return met.select("model", F.array(*[F.col(f"{c}{i}") for c in "abc" for i in range(3)]).alias("correction"))
