"""Interpolation of sampled sequences and images by splines, rotations by great arcs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import bspline
from .sequences import bracket


def spline(points: DataFrame, samples: DataFrame, key: str, t: str, values: list[str], degree: int, chunks: int = 1) -> DataFrame:
    """(key, t, values): splines of degree 1, 2 or 3 through each key's samples at its points, carried on beyond the ends.

    A key's samples meet its points in one task; ``chunks`` splits the points
    of a key over more, each with a copy of the samples. Keys with fewer than
    two samples give nulls.
    """
    kinds = dict(points.dtypes)
    schema = f"`{key}` {kinds[key]}, `{t}` double, " + ", ".join(f"`{v}` double" for v in values)
    left = samples.select(key, F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("_c"), F.col(t).cast("double").alias(t), *[F.col(v).cast("double").alias(v) for v in values])
    right = points.select(key, F.pmod(F.hash(t), F.lit(chunks)).alias("_c"), F.col(t).cast("double").alias(t))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        at = b.column(t).to_numpy()
        x = a.column(t).to_numpy()
        if len(np.unique(x)) < 2:
            out = [pa.nulls(len(at), pa.float64()) for _ in values]
        else:
            y = np.stack([a.column(v).to_numpy() for v in values], axis=1)
            out = [pa.array(c) for c in bspline.interpolate(x, y, at, degree).T]
        return pa.table([b.column(key), pa.array(at), *out], names=[key, t, *values])

    return left.groupBy(key, "_c").cogroup(right.groupBy(key, "_c")).applyInArrow(run, schema)


def slerp(points: DataFrame, samples: DataFrame, key: str, t: str, q: str) -> DataFrame:
    """(key, t, q): unit quaternions (arrays) on the great arc between the samples around each time; beyond the ends the end sample."""
    b = bracket(points, samples, key, t, q)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, u: s + u)
    unit = lambda x: F.transform(x, lambda u: u / F.sqrt(dot(x, x)))
    s = b.select(key, t, unit(F.col("v0")).alias("_a"), unit(F.col("v1")).alias("_b"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(F.col(t) - F.col("t0"), F.col("t1") - F.col("t0")))).alias("_f"))
    s = s.withColumn("_b", F.when(dot(F.col("_a"), F.col("_b")) < 0, F.transform("_b", lambda u: -u)).otherwise(F.col("_b")))
    s = s.withColumn("_w", F.acos(F.least(F.lit(1.0), dot(F.col("_a"), F.col("_b")))))
    near = F.col("_w") < 1e-9
    wa = F.when(near, 1 - F.col("_f")).otherwise(F.sin((1 - F.col("_f")) * F.col("_w")) / F.sin("_w"))
    wb = F.when(near, F.col("_f")).otherwise(F.sin(F.col("_f") * F.col("_w")) / F.sin("_w"))
    s = s.withColumns({"_wa": wa, "_wb": wb})
    return s.select(key, t, F.zip_with("_a", "_b", lambda x, y: x * F.col("_wa") + y * F.col("_wb")).alias(q))


def image_spline(points: DataFrame, px: DataFrame, key: list[str], x: str, y: str, degree: int = 3, tile: int = 64, halo: int = 8) -> DataFrame:
    """(key, value): tensor splines at fractional pixels (x, y), null outside the image.

    Pixels are dealt to square tiles with a halo, and each point is evaluated
    in its own tile; a spline's weights fade within a few pixels, so the halo
    changes it by less than 1e-4 of the values about. A point whose tile lacks
    pixels is null.
    """
    kinds = dict(points.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in key) + ", value double"
    span = lambda c: F.sequence(F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile))
    dealt = px.select("row", "col", F.col("value").cast("double").alias("value")).withColumn("_r", F.explode(span("row"))).withColumn("_c", F.explode(span("col")))
    asked = points.select(*key, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).withColumns({"_r": F.floor(F.col("_y") / tile), "_c": F.floor(F.col("_x") / tile)})

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out = np.full(b.num_rows, np.nan)
        if a.num_rows and b.num_rows:
            r, c = a.column("row").to_numpy(), a.column("col").to_numpy()
            image = np.full((r.max() - r.min() + 1, c.max() - c.min() + 1), np.nan)
            image[r - r.min(), c - c.min()] = a.column("value").to_numpy()
            ys, xs = b.column("_y").to_numpy() - r.min(), b.column("_x").to_numpy() - c.min()
            ok = (ys >= 0) & (ys <= image.shape[0] - 1) & (xs >= 0) & (xs <= image.shape[1] - 1)
            if not np.isnan(image).any() and min(image.shape) > 1:
                out[ok] = bspline.interpolate2(image, ys[ok], xs[ok], degree)
        return pa.table([*[b.column(k) for k in key], pa.array(out, mask=np.isnan(out))], names=[*key, "value"])

    return dealt.groupBy("_r", "_c").cogroup(asked.groupBy("_r", "_c")).applyInArrow(run, schema)


