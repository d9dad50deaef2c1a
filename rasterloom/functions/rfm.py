"""Rational function model: ground to image as expressions, image to ground as an Arrow kernel."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.rpc import Rfm

# Powers of (x, y, z) of the 20 terms, x latitude, y longitude, z height, all normalised.
TERMS = [(0, 0, 0), (0, 1, 0), (1, 0, 0), (0, 0, 1), (1, 1, 0), (0, 1, 1), (1, 0, 1), (0, 2, 0), (2, 0, 0), (0, 0, 2), (1, 1, 1), (0, 3, 0), (2, 1, 0), (0, 1, 2), (1, 2, 0), (3, 0, 0), (1, 0, 2), (0, 2, 1), (2, 0, 1), (0, 0, 3)]


def polynomial(coeff, x, y, z):
    """Of columns or arrays alike, summed in the order of the terms."""
    out = None
    for c, (i, j, k) in zip(coeff, TERMS, strict=True):
        term = None
        for v, n in ((x, i), (y, j), (z, k)):
            for _ in range(n):
                term = v if term is None else term * v
        part = term * c if term is not None else c
        out = part if out is None else out + part
    return out


def normalised(m: Rfm, lon, lat, alt):
    s = m.scalars
    return (lat - s["LAT_OFF"]) / s["LAT_SCALE"], (lon - s["LONG_OFF"]) / s["LONG_SCALE"], (alt - s["HEIGHT_OFF"]) / s["HEIGHT_SCALE"]


def ground_to_image(m: Rfm, lon: Column, lat: Column, alt: Column | None = None, correction: list[float] | None = None) -> tuple[Column, Column]:
    """Column and line in pixels. A null height is the model's own. correction: 3 x 3 by rows, added in normalised image space."""
    s = m.scalars
    own = F.lit(s["HEIGHT_OFF"])
    x, y, z = normalised(m, lon, lat, own if alt is None else F.coalesce(alt, own))
    col, line = polynomial(m.samp_num, x, y, z) / polynomial(m.samp_den, x, y, z), polynomial(m.line_num, x, y, z) / polynomial(m.line_den, x, y, z)
    if correction is not None:
        c = [F.lit(float(v)) for v in correction]
        col, line = col + c[0] * col + c[1] * line + c[2], line + c[3] * col + c[4] * line + c[5]
    return col * s["SAMP_SCALE"] + s["SAMP_OFF"], line * s["LINE_SCALE"] + s["LINE_OFF"]


def invert(m: Rfm, col: np.ndarray, line: np.ndarray, alt: np.ndarray, rounds: int = 30, close: float = 1e-18) -> tuple[np.ndarray, np.ndarray]:
    """Longitude and latitude by Newton steps with difference quotients; each point stops on its own."""
    s = m.scalars
    u = np.stack([(col - s["SAMP_OFF"]) / s["SAMP_SCALE"], (line - s["LINE_OFF"]) / s["LINE_SCALE"]])
    z = (alt - s["HEIGHT_OFF"]) / s["HEIGHT_SCALE"]

    def image(y, x, z):
        return np.stack([polynomial(m.samp_num, x, y, z) / polynomial(m.samp_den, x, y, z), polynomial(m.line_num, x, y, z) / polynomial(m.line_den, x, y, z)])

    y, x, step = np.zeros_like(z), np.zeros_like(z), 1e-6
    open_ = np.ones(len(z), bool)
    for _ in range(rounds):
        i = np.flatnonzero(open_)
        if not len(i):
            break
        p = image(y[i], x[i], z[i])
        e = u[:, i] - p
        open_[i[(e * e).sum(axis=0) < close]] = False
        a, b = (image(y[i] + step, x[i], z[i]) - p) / step, (image(y[i], x[i] + step, z[i]) - p) / step
        det = a[0] * b[1] - a[1] * b[0]
        y[i] += (e[0] * b[1] - e[1] * b[0]) / det
        x[i] += (a[0] * e[1] - a[1] * e[0]) / det
    return y * s["LONG_SCALE"] + s["LONG_OFF"], x * s["LAT_SCALE"] + s["LAT_OFF"]


def image_to_ground(df: DataFrame, m: Rfm, col: str = "col", line: str = "line", alt: str = "alt", keep: tuple[str, ...] = ()) -> DataFrame:
    """(kept columns, lon, lat, alt) of image points; a null height is the model's own. Points are independent of their batch."""
    own = m.scalars["HEIGHT_OFF"]
    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "lon double, lat double, alt double"])

    def run(batches):
        for b in batches:
            c, r = (np.asarray(b.column(i).to_numpy(zero_copy_only=False), float) for i in (len(keep), len(keep) + 1))
            h = np.asarray(b.column(len(keep) + 2).to_numpy(zero_copy_only=False), float)
            lon, lat = invert(m, c, r, h)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(lon), pa.array(lat), pa.array(h)], names=[*keep, "lon", "lat", "alt"])

    return df.select(*keep, F.col(col).cast("double").alias("_c"), F.col(line).cast("double").alias("_r"), F.coalesce(F.col(alt).cast("double"), F.lit(own)).alias("_h")).mapInArrow(run, schema)
