"""Time series of displacement: principal components with missing values, and independent components.

The time axis is short, so a time x time Gram matrix, a sum over pixels, holds
all that decompositions need; pixels stay distributed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fill_mean(cube: DataFrame, pixel: list[str], times: list) -> DataFrame:
    """(pixel, x, w): arrays in the order of times, gaps filled with the pixel's mean, w 1 for data and 0 for gaps."""
    by = cube.groupBy(*pixel).agg(F.map_from_entries(F.collect_list(F.struct("t", "value"))).alias("_m"), F.avg("value").alias("_a"))  # as many as there are times
    at = [F.col("_m")[F.lit(t)] for t in times]
    return by.select(*pixel, F.array(*[F.coalesce(v, F.col("_a")) for v in at]).alias("x"), F.array(*[v.isNotNull().cast("double") for v in at]).alias("w"))


def gram(vectors: DataFrame, n: int, x: str = "x") -> np.ndarray:
    """n x n sums of products; partial sums are made by task, one matrix each."""

    def run(batches):
        total = np.zeros((n, n))
        for b in batches:
            m = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, n)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n * n), pa.int32()), pa.array(total.reshape(-1))], names=["i", "v"])

    got = vectors.select(x).mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(n * n)
    for r in got:
        out[r.i] = r.v
    return out.reshape(n, n)


def gram_table(cube: DataFrame, pixel: list[str]) -> DataFrame:
    """(t1, t2, g) in relations only: sums over pixels of products of pairs of times."""
    a, b = (cube.select(*pixel, F.col("t").alias(t), F.col("value").alias(v)) for t, v in (("t1", "v1"), ("t2", "v2")))
    return a.join(b, pixel).groupBy("t1", "t2").agg(F.sum(F.col("v1") * F.col("v2")).alias("g"))


def basis(g: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(V n x k, S k): leading right singular vectors, largest entry positive, and singular values."""
    val, vec = np.linalg.eigh(g)
    order = np.argsort(-val)[:k]
    val, vec = np.maximum(val[order], 0), vec[:, order]
    sign = np.sign(vec[np.abs(vec).argmax(axis=0), np.arange(len(order))])
    return vec * np.where(sign == 0, 1, sign), np.sqrt(val)


def pcaim(vectors: DataFrame, n: int, k: int, rounds: int = 100, close: float = 1e-6) -> tuple[np.ndarray, np.ndarray, list[float], DataFrame]:
    """Components of data with weights (x, w): gaps take the reconstruction of the round before.

    For 1 to k components: A = w x + (1 - w) X, projection on the leading
    vectors, until chi2 = sum w (X - x)^2 settles. X follows from the vectors
    of the rounds so far; as a chain of n x n matrices wouldn't hold for each
    pixel's own gaps, each round rewrites x in place by one Arrow pass over a
    checkpointed table. Returns V, S, chi2 by component, the filled vectors.
    """
    shared = vectors.sparkSession
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    keep = [f for f in vectors.schema.fields if f.name not in ("x", "w", "y")]
    schema = StructType([*keep, *[StructField(c, ArrayType(DoubleType())) for c in ("x", "w", "y")]])
    if shared.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        import tempfile

        folder, master = shared.conf.get("spark.checkpoint.dir", None), shared.sparkContext.master
        if not folder and (not master.startswith("local") or master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared.sparkContext.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="series-"))
    now = vectors.select(*[f.name for f in keep], "x", "w", F.col("x").alias("y")).to(schema).checkpoint()
    chis, v, s = [], np.zeros((n, 0)), np.zeros(0)
    for i in range(1, k + 1):
        old = np.inf
        for _ in range(rounds):
            v, s = basis(gram(now, n, "y"), i)
            p = v @ v.T

            def run(batches, p=p):
                for b in batches:
                    m = {f: b.column(b.schema.get_field_index(f)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, n) for f in ("x", "w", "y")}
                    back = m["y"] @ p
                    y = m["w"] * m["x"] + (1 - m["w"]) * back
                    cols = [pa.array(y.tolist(), pa.list_(pa.float64())) if f == "y" else b.column(f) for f in b.schema.names]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array((m["w"] * (back - m["x"]) ** 2).sum(axis=1))], names=[*b.schema.names, "chi"])

            done = now.mapInArrow(run, StructType([*schema.fields, StructField("chi", DoubleType())])).checkpoint()
            chi = done.agg(F.sum("chi")).first()[0] or 0.0
            now = done.drop("chi")
            if abs(old - chi) <= chi * close or chi < 1e-15:
                break
            old = chi
        chis.append(chi)
    return v, s, chis, now


def ica(vectors: DataFrame, n: int, k: int, rounds: int = 200, close: float = 1e-8, seed: int = 0) -> tuple[np.ndarray, DataFrame]:
    """(unmixing k x n, table with array ``ic``): symmetric fixed-point iteration with the exponential contrast.

    Each round needs k x k averages only, made as partial sums by task.
    """
    means = np.array(vectors.select(*[F.avg(F.col("x")[i]) for i in range(n)]).first(), float)
    count = vectors.count()
    centred = vectors.withColumn("x", F.array(*[F.col("x")[i] - float(means[i]) for i in range(n)]))
    v, s = basis(gram(centred, n), k)
    white = (v / np.maximum(s, 1e-12)).T * np.sqrt(count)
    w = np.linalg.qr(np.random.default_rng(seed).normal(size=(k, k)))[0]

    def partial(w):
        def run(batches):
            a, d = np.zeros((k, k)), np.zeros(k)
            for b in batches:
                z = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, n) @ white.T
                u = z @ w.T
                e = np.exp(-u * u / 2)
                a += (u * e).T @ z
                d += ((1 - u * u) * e).sum(axis=0)
            flat = np.concatenate([a.reshape(-1), d])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], names=["i", "v"])

        return run

    for _ in range(rounds):
        got = {r.i: r.v for r in centred.select("x").mapInArrow(partial(w), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()}
        flat = np.array([got.get(i, 0.0) for i in range(k * k + k)]) / max(count, 1)
        new = flat[: k * k].reshape(k, k) - flat[k * k :, None] * w
        val, vec = np.linalg.eigh(new @ new.T)
        new = vec @ np.diag(1 / np.sqrt(np.maximum(val, 1e-12))) @ vec.T @ new
        done = np.abs(np.abs((new * w).sum(axis=1)) - 1).max() < close
        w = new
        if done:
            break
    un = w @ white
    sign = np.sign(un[np.arange(k), np.abs(un).argmax(axis=1)])
    un = un * np.where(sign == 0, 1, sign)[:, None]
    ic = F.array(*[sum((F.col("x")[i] * float(un[j, i]) for i in range(n)), F.lit(0.0)) for j in range(k)])
    return un, centred.withColumn("ic", ic)


def slice_weights(cube: DataFrame, pixels: int, power: float) -> DataFrame:
    """(t, n_missing, weight): the share of pixels with data to a power, over the largest."""
    n = cube.groupBy("t").agg(F.count("value").alias("n"))
    raw = F.pow(F.col("n") / F.lit(pixels), F.lit(power))
    return n.select("t", (F.lit(pixels) - F.col("n")).alias("n_missing"), (raw / F.max(raw).over(Window.partitionBy(F.lit(0)))).alias("weight"))
