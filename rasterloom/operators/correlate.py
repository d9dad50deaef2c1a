"""Sub-pixel image correlation: statistical (normalised cross-correlation) and by frequency.

Images arrive as a table of tiles (pair_id, row0, col0, base, target): square
arrays in row order that already hold their margin, cut by ``halo_tiles``.
Tiles are independent rows, so a kernel runs on any number of executors with
a tile's memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "pair_id long, row int, col int, dx double, dy double, snr double"


def ncc(base: np.ndarray, target: np.ndarray, reach: int) -> tuple[float, float, float]:
    """(dx, dy, peak): the shift of the window ``base`` inside ``target``, larger by ``reach`` on all sides; a parabola refines each axis."""
    n = base.shape[0]
    view = np.lib.stride_tricks.sliding_window_view(target, base.shape)
    b = base - base.mean()
    t = view - view.mean(axis=(2, 3), keepdims=True)
    den = np.sqrt((b * b).sum() * (t * t).sum(axis=(2, 3)))
    score = np.divide((t * b).sum(axis=(2, 3)), den, out=np.full(den.shape, np.nan), where=den > 1e-12)
    if n == 0 or np.isnan(score).all():
        return np.nan, np.nan, 0.0
    j, i = np.unravel_index(np.nanargmax(score), score.shape)

    def refine(lo, mid, hi):
        d = lo - 2 * mid + hi
        return 0.5 * (lo - hi) / d if np.isfinite(d) and d < 0 else 0.0

    dx = refine(score[j, i - 1], score[j, i], score[j, i + 1]) if 0 < i < score.shape[1] - 1 else 0.0
    dy = refine(score[j - 1, i], score[j, i], score[j + 1, i]) if 0 < j < score.shape[0] - 1 else 0.0
    return i - reach + dx, j - reach + dy, float(score[j, i])


def phase_shift(base: np.ndarray, target: np.ndarray, rounds: int = 4, mask: float = 0.9) -> tuple[float, float, float]:
    """(dx, dy, snr) of two windows of equal size: whole pixels by the peak of the phase correlation, then a weighted plane through the phase."""
    n = base.shape[0]
    taper = np.hanning(n + 2)[1:-1]
    taper = np.outer(taper, taper)
    f = np.fft.fftfreq(n) * 2 * np.pi
    wx, wy = np.meshgrid(f, f)
    total = np.zeros(2)
    a = np.fft.fft2((base - base.mean()) * taper)
    snr = 0.0
    moved = target
    for step in range(3):
        b = np.fft.fft2((moved - moved.mean()) * taper)
        q = a * np.conj(b)
        size = np.abs(q)
        if not size.max() > 0:
            return np.nan, np.nan, 0.0
        q = np.divide(q, size, out=np.zeros_like(q), where=size > 0)
        if step == 0:
            peak = np.fft.ifft2(q).real
            j, i = np.unravel_index(np.argmax(peak), peak.shape)
            whole = np.array([-(i if i <= n // 2 else i - n), -(j if j <= n // 2 else j - n)], float)
            total += whole
            moved = np.roll(target, (-int(whole[1]), -int(whole[0])), axis=(0, 1))
            continue
        level = np.log(np.maximum(size, 1e-300))
        level -= level.max()
        w = (level > mask * level.mean()).astype(float) * (np.hypot(wx, wy) < np.pi / 2)
        d = np.zeros(2)
        for _ in range(rounds):
            r = np.angle(q * np.exp(-1j * (wx * d[0] + wy * d[1])))
            m = np.array([[(w * wx * wx).sum(), (w * wx * wy).sum()], [(w * wx * wy).sum(), (w * wy * wy).sum()]])
            if abs(np.linalg.det(m)) < 1e-12:
                break
            d += np.linalg.solve(m, [(w * wx * r).sum(), (w * wy * r).sum()])
            phi = np.abs(q - np.exp(1j * (wx * d[0] + wy * d[1]))) ** 2
            w = w * (1 - phi / 4) ** 6
        total += d
        snr = float(1 - (w * phi).sum() / (4 * w.sum())) if w.sum() > 0 else 0.0
        break
    return float(total[0]), float(total[1]), snr


def measure(base: np.ndarray, target: np.ndarray, method: str, window: int, step: int, reach: int):
    """(row, col, dx, dy, snr) of the windows of a tile; rows and columns of window corners without the margin."""
    margin = reach if method == "spatial" else 0
    for r in range(margin, base.shape[0] - window - margin + 1, step):
        for c in range(margin, base.shape[1] - window - margin + 1, step):
            b = base[r : r + window, c : c + window]
            if method == "spatial":
                yield r, c, *ncc(b, target[r - reach : r + window + reach, c - reach : c + window + reach], reach)
            else:
                yield r, c, *phase_shift(b, target[r : r + window, c : c + window])


def correlate(tiles: DataFrame, method: str = "frequency", window: int = 32, step: int = 16, reach: int = 10) -> DataFrame:
    """Displacements in pixels, positive right and down from base to target."""
    if method not in ("frequency", "spatial"):
        raise ValueError("method is frequency or spatial")

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for t in batch.to_pylist():
                a, b = (np.array(t[k], float).reshape(t["height"], -1) for k in ("base", "target"))
                out += [(t["pair_id"], t["row0"] + r, t["col0"] + c, dx, dy, snr) for r, c, dx, dy, snr in measure(a, b, method, window, step, reach)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, type=k) for x, k in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64()), strict=True)], names=["pair_id", "row", "col", "dx", "dy", "snr"])

    return tiles.select("pair_id", "row0", "col0", "height", "base", "target").mapInArrow(run, OUT)


def halo_tiles(px: DataFrame, size: int, margin: int, overlap: int = 0) -> DataFrame:
    """Tiles (pair_id, row0, col0, height, base, target) from pixels (pair_id, row, col, base, target): size + 2 margin + overlap on a side, less at the far edges; holed tiles are left out.

    Windows of a step that divides the size go on over the edges of tiles when
    overlap is window - step. A pixel goes to each tile that holds it, at most
    four while 2 margin + overlap is at most a tile; then one grouping by tile,
    whose size is bounded.
    """
    span = size + 2 * margin + overlap

    def of(c: str):
        return F.sequence(F.greatest(F.ceil((F.col(c) - span + 1) / size), F.lit(0)), F.floor(F.col(c) / size))

    dealt = px.withColumn("ti", F.explode(of("row"))).withColumn("tj", F.explode(of("col")))
    cell = F.struct("row", "col", "base", "target")
    high, wide = F.max("row") - F.col("ti") * size + 1, F.max("col") - F.col("tj") * size + 1
    held = dealt.groupBy("pair_id", "ti", "tj").agg(F.sort_array(F.collect_list(cell)).alias("px"), high.cast("int").alias("height"), wide.cast("int").alias("width")).filter(F.size("px") == F.col("height") * F.col("width"))
    return held.select("pair_id", (F.col("ti") * size).cast("int").alias("row0"), (F.col("tj") * size).cast("int").alias("col0"), "height", F.col("px.base").alias("base"), F.col("px.target").alias("target"))


def ncc_table(px: DataFrame, windows: int, reach: int) -> DataFrame:
    """(wr, wc, dx, dy, score) of the best whole shift of aligned windows, in relations only: pixels, shifts, windows, ``corr``.

    px: (row, col, base, target). A pixel goes to each window that it lies at
    most ``reach`` from, once and not for each shift; a window's pixels then
    meet where they are, (2 reach + 1)^2 pairs for each of the window.
    """
    near = lambda c: F.sequence(*[F.floor((F.col(c) + d) / windows).cast("int") for d in (-reach, reach)])
    dealt = px.withColumn("wr", F.explode(near("row"))).withColumn("wc", F.explode(near("col")))
    held = dealt.groupBy("wr", "wc").agg(F.collect_list(F.struct("row", "col", "base", "target")).alias("px"))
    own = (F.floor(F.col("b.row") / windows) == F.col("wr")) & (F.floor(F.col("b.col") / windows) == F.col("wc"))
    met = held.withColumn("b", F.explode("px")).filter(own).withColumn("t", F.explode("px"))
    met = met.select("wr", "wc", (F.col("t.col") - F.col("b.col")).alias("dx"), (F.col("t.row") - F.col("b.row")).alias("dy"), "b.base", "t.target").filter(F.col("dx").between(-reach, reach) & F.col("dy").between(-reach, reach))
    scored = met.groupBy("wr", "wc", "dx", "dy").agg(F.corr("base", "target").alias("score"), F.count("*").alias("n")).filter(f"n = {windows * windows}")
    best = F.max_by(F.struct("dx", "dy"), F.struct(F.round("score", 9), -F.abs(F.col("dx")) - F.abs(F.col("dy")), "dx", "dy"))
    return scored.groupBy("wr", "wc").agg(best.alias("b"), F.max("score").alias("score")).select("wr", "wc", "b.dx", "b.dy", "score")
