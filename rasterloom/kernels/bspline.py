"""Interpolating splines of degree 1 to 3 with not-a-knot ends, in one and two dimensions."""

from __future__ import annotations

import numpy as np


def knots(x: np.ndarray, k: int) -> np.ndarray:
    """Of an interpolating spline through sorted x: samples for odd degrees, their midpoints for even ones, without those next to the ends."""
    inner = x[(k + 1) // 2 : len(x) - (k + 1) // 2] if k % 2 else ((x[1:] + x[:-1]) / 2)[k // 2 : len(x) - 1 - k // 2]
    return np.concatenate((np.full(k + 1, x[0]), inner, np.full(k + 1, x[-1])))


def basis(t: np.ndarray, k: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, values): the k + 1 basis functions that aren't 0 at each x, by their recurrence; beyond the ends, the end pieces carried on."""
    at = np.clip(np.searchsorted(t, x, side="right") - 1, k, len(t) - k - 2)
    values = np.ones((len(x), 1))
    for d in range(1, k + 1):
        out = np.zeros((len(x), d + 1))
        for j in range(d):
            lo, hi = t[at - d + 1 + j], t[at + 1 + j]
            w = values[:, j] / (hi - lo)
            out[:, j] += (hi - x) * w
            out[:, j + 1] += (x - lo) * w
        values = out
    return at - k, values


def fit(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(knots, coefficients, degree) through the samples; y may have more columns. The degree falls with too few samples.

    The collocation matrix has at most 2k + 1 diagonals and needs no pivots.
    """
    x, y = np.asarray(x, float), np.asarray(y, float)
    if len(x) < 2 or np.any(np.diff(x) <= 0):
        raise ValueError("a spline needs two samples at least, in rising order")
    k = min(k, len(x) - 1)
    t = knots(x, k)
    first, v = basis(t, k, x)
    n = len(x)
    band = np.zeros((n, 4 * k + 1))  # entry (i, j) at j - i + 2k
    for j in range(k + 1):
        band[np.arange(n), first + j - np.arange(n) + 2 * k] = v[:, j]
    c = y.reshape(n, -1).copy()
    mid = 2 * k
    for i in range(n):
        for r in range(i + 1, min(i + 2 * k, n - 1) + 1):
            f = band[r, i - r + mid]
            if f:
                f /= band[i, mid]
                width = min(2 * k, n - 1 - i) + 1
                band[r, i - r + mid : i - r + mid + width] -= f * band[i, mid : mid + width]
                c[r] -= f * c[i]
    for i in range(n - 1, -1, -1):
        for j in range(i + 1, min(i + 2 * k, n - 1) + 1):
            c[i] -= band[i, j - i + mid] * c[j]
        c[i] /= band[i, mid]
    return t, c.reshape(y.shape), k


def evaluate(t: np.ndarray, c: np.ndarray, k: int, x: np.ndarray) -> np.ndarray:
    first, v = basis(t, k, np.asarray(x, float))
    return sum(v[:, j].reshape((-1,) + (1,) * (c.ndim - 1)) * c[first + j] for j in range(k + 1))


def interpolate(x: np.ndarray, y: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Values at ``at`` of the spline through samples in any order; equal x count once, the first."""
    x, first = np.unique(np.asarray(x, float), return_index=True)
    return evaluate(*fit(x, np.asarray(y, float)[first], k), np.asarray(at, float))


def interpolate2(image: np.ndarray, rows: np.ndarray, cols: np.ndarray, k: int = 3) -> np.ndarray:
    """Values at fractional (row, column) of the tensor spline through an image's pixels."""
    h, w = image.shape
    tr, half, kr = fit(np.arange(h), image, k)
    tc, both, kc = fit(np.arange(w), half.T, k)  # coefficients by column, then row
    fr, vr = basis(tr, kr, np.asarray(rows, float))
    fc, vc = basis(tc, kc, np.asarray(cols, float))
    return sum(vr[:, i] * vc[:, j] * both[fc + j, fr + i] for i in range(kr + 1) for j in range(kc + 1))
