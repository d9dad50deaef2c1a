"""Windowed sinc resampling of an image at fractional pixels."""

from __future__ import annotations

import numpy as np


def weights(offset: np.ndarray, kernel: int, scale: np.ndarray) -> np.ndarray:
    """Normalised weights of ``kernel`` pixels about each offset in [-0.5, 0.5]: a sinc of the output's step (``scale``, 1 at least), apodised by a raised cosine."""
    d = np.arange(kernel) - kernel // 2 - offset[:, None]
    x = d / scale[:, None]
    half = (kernel // 2 + 1) * scale[:, None]
    w = np.sinc(x) * np.where(np.abs(d) < half, 0.5 + 0.5 * np.cos(np.pi * d / half), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def resample(image: np.ndarray, rows: np.ndarray, cols: np.ndarray, kernel: int = 15, step: tuple[float, float] = (1.0, 1.0)) -> np.ndarray:
    """Values at fractional (row, column); NaN where the kernel leaves the image or meets a missing pixel. step: the output's steps in input pixels."""
    if kernel < 1 or kernel % 2 == 0:
        kernel = 15
    rows, cols = np.asarray(rows, float), np.asarray(cols, float)
    out = np.full(len(rows), np.nan)
    r, c, half = np.rint(rows).astype(np.int64), np.rint(cols).astype(np.int64), kernel // 2
    ok = np.flatnonzero((r >= half) & (r < image.shape[0] - half) & (c >= half) & (c < image.shape[1] - half))
    for at in range(0, len(ok), 4096):  # bounded memory
        i = ok[at : at + 4096]
        wr = weights(rows[i] - r[i], kernel, np.full(len(i), max(1.0, step[0])))
        wc = weights(cols[i] - c[i], kernel, np.full(len(i), max(1.0, step[1])))
        around = np.arange(-half, half + 1)
        patch = image[r[i][:, None, None] + around[None, :, None], c[i][:, None, None] + around[None, None, :]]
        out[i] = np.einsum("nrc,nr,nc->n", patch, wr, wc)
    return out
