"""Rigorous model of a push-broom sensor: pixel to ground and back, correction, builders from sampled orbits."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from ..functions.vectors import RAY_A, RAY_B
from . import bspline, geodesy


@dataclass
class Sensor:
    """A model: by line the satellite's position and two rotations, by column the look direction."""

    position: np.ndarray  # (lines, 3), earth-centred
    to_orbit: np.ndarray  # (lines, 3, 3), satellite to orbital frame
    to_earth: np.ndarray  # (lines, 3, 3), orbital to earth-centred frame, axes in columns
    look: np.ndarray  # (columns, 3)
    velocity: np.ndarray | None = None
    info: dict = field(default_factory=dict)

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.position), len(self.look)


def between(v: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows of ``v`` at fractional places on the line between neighbours, carried on beyond the ends."""
    if len(v) == 1:
        return np.repeat(v, len(at), axis=0)
    i = np.clip(np.floor(at).astype(np.int64), 0, len(v) - 2)
    f = (at - i).reshape((-1,) + (1,) * (v.ndim - 1))
    return v[i] + (v[i + 1] - v[i]) * f


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=-1, keepdims=True)


def orbital_frame(position: np.ndarray, velocity: np.ndarray) -> np.ndarray:
    """Axes in columns: Z along the position, X along velocity x Z, Y = Z x X."""
    z = unit(position)
    x = unit(np.cross(velocity, z))
    return np.stack([x, np.cross(z, x), z], axis=-1)


def correction(c: np.ndarray | None, col: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Change of the look direction: the 3 x 3 correction times (col, line, 1)."""
    return 0.0 if c is None else np.stack([col, line, np.ones_like(col)], axis=1) @ np.asarray(c, float)


def direction(m: Sensor, col: np.ndarray, line: np.ndarray, c: np.ndarray | None = None) -> np.ndarray:
    u = between(m.look, col)
    u = unit(np.einsum("nij,nj->ni", between(m.to_orbit, line), u))
    return np.einsum("nij,nj->ni", between(m.to_earth, line), u) + correction(c, col, line)


def on_ellipsoid(s: np.ndarray, u: np.ndarray, h: np.ndarray) -> np.ndarray:
    """First points of rays on the ellipsoid raised by h, NaN where they miss it."""
    w = np.stack([1 / (RAY_A + h) ** 2, 1 / (RAY_A + h) ** 2, 1 / (RAY_B + h) ** 2], axis=1)
    a, b, g = (w * u * u).sum(1), 2 * (w * s * u).sum(1), (w * s * s).sum(1) - 1
    disc = b * b - 4 * a * g
    with np.errstate(invalid="ignore"):
        m = (-b - np.sqrt(disc)) / (2 * a)
    return s + m[:, None] * u


def to_ground(m: Sensor, col, line, h=0.0, c: np.ndarray | None = None, height=None, rounds: int = 10, close: float = 1e-3):
    """(lon, lat, alt) of pixels at heights h; with ``height`` (lon, lat -> alt) until heights change by less than ``close``. Each point stops on its own."""
    col, line = np.atleast_1d(np.asarray(col, float)), np.atleast_1d(np.asarray(line, float))
    h = np.broadcast_to(np.asarray(h, float), col.shape).copy()
    s, u = between(m.position, line), direction(m, col, line, c)
    lon, lat, alt = geodesy.from_ecef(on_ellipsoid(s, u, h))
    if height is None:
        return lon, lat, alt
    open_ = np.ones(len(h), bool)
    for _ in range(rounds):
        i = np.flatnonzero(open_)
        if not len(i):
            break
        found = np.asarray(height(lon[i], lat[i]), float)
        new = np.where(np.isnan(found), h[i], found)  # no height there: the one before
        open_[i[np.abs(new - h[i]) < close]] = False
        h[i] = new
        lon[i], lat[i], alt[i] = geodesy.from_ecef(on_ellipsoid(s[i], u[i], h[i]))
    return lon, lat, alt


def affine_seed(m: Sensor, h: float = 0.0, c: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(2 x 2, 2): from (lon, lat) to (col, line) by the four corners."""
    lines, cols = m.shape
    x, y = np.array([0, cols - 1, 0, cols - 1.0]), np.array([0, 0, lines - 1, lines - 1.0])
    lon, lat, _ = to_ground(m, x, y, h, c)
    a = np.stack([lon, lat, np.ones(4)], axis=1)
    fit = np.linalg.lstsq(a, np.stack([x, y], axis=1), rcond=None)[0]
    return fit[:2].T, fit[2]


def to_pixel(m: Sensor, lon, lat, h, c: np.ndarray | None = None, rounds: int = 50, close: float = 1e-6):
    """(col, line) of ground points by Newton steps from the corners' affine; NaN where none is found."""
    lon, lat = np.asarray(lon, float), np.asarray(lat, float)
    h = np.broadcast_to(np.asarray(h, float), lon.shape)
    a, b = affine_seed(m, float(np.nanmean(h)) if len(h) and not np.isnan(h).all() else 0.0, c)
    at = np.stack([lon, lat], axis=1) @ a.T + b
    open_ = ~np.isnan(at).any(axis=1) & ~np.isnan(h)
    at[~open_] = np.nan
    done = np.zeros(len(at), bool)
    lines, cols = m.shape
    for _ in range(rounds):
        i = np.flatnonzero(open_)
        if not len(i):
            break
        x, y = at[i, 0], at[i, 1]
        p = np.stack(to_ground(m, x, y, h[i], c)[:2], axis=1)
        px = (np.stack(to_ground(m, x + 0.5, y, h[i], c)[:2], axis=1) - p) / 0.5
        py = (np.stack(to_ground(m, x, y + 0.5, h[i], c)[:2], axis=1) - p) / 0.5
        e = np.stack([lon[i], lat[i]], axis=1) - p
        det = px[:, 0] * py[:, 1] - py[:, 0] * px[:, 1]
        with np.errstate(invalid="ignore", divide="ignore"):
            step = np.stack([e[:, 0] * py[:, 1] - e[:, 1] * py[:, 0], px[:, 0] * e[:, 1] - px[:, 1] * e[:, 0]], axis=1) / det[:, None]
        bad = ~np.isfinite(step).all(axis=1)
        at[i] += np.where(bad[:, None], np.nan, np.clip(step, -4 * max(lines, cols), 4 * max(lines, cols)))
        small = (np.abs(step) < close).all(axis=1)
        done[i[small]] = True
        open_[i[small | bad]] = False
    at[~done] = np.nan
    return at[:, 0], at[:, 1]


def footprint(m: Sensor, h: float = 0.0, c: np.ndarray | None = None, height=None) -> list[tuple[float, float]]:
    """Closed ring (lon, lat): upper left, upper right, lower right, lower left."""
    lines, cols = m.shape
    lon, lat, _ = to_ground(m, [0, cols - 1, cols - 1, 0], [0, 0, lines - 1, lines - 1], h, c, height)
    ring = list(zip(lon.tolist(), lat.tolist(), strict=True))
    return [*ring, ring[0]]


def quaternion_matrix(q: np.ndarray, transpose: bool = False) -> np.ndarray:
    """Rotations of (n, 4) quaternions with the scalar last; the transpose is the convention of vendors that rotate axes instead of vectors."""
    x, y, z, w = np.moveaxis(unit(np.asarray(q, float)), -1, 0)
    r = np.stack([1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w), 2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w), 2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)], axis=-1).reshape(-1, 3, 3)
    return np.swapaxes(r, 1, 2) if transpose else r


def opk(omega, phi, kappa) -> np.ndarray:
    """Rx(omega) Ry(phi) Rz(kappa)."""
    so, co, sp, cp, sk, ck = (f(np.asarray(v, float)) for v in (omega, phi, kappa) for f in (np.sin, np.cos))
    return np.stack([cp * ck, -cp * sk, sp, co * sk + so * sp * ck, co * ck - so * sp * sk, -so * cp, so * sk - co * sp * ck, so * ck + co * sp * sk, co * cp], axis=-1).reshape(-1, 3, 3)


def lagrange(t: np.ndarray, v: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The polynomial through all samples."""
    out = 0.0
    for i in range(len(t)):
        w = np.ones_like(at)
        for j in range(len(t)):
            if j != i:
                w = w * (at - t[j]) / (t[i] - t[j])
        out = out + w[:, None] * v[i]
    return out


def trimmed(t: np.ndarray, first: float, last: float, keep: int = 4) -> np.ndarray:
    """Places of the samples between two times, with the ``keep`` last before and first after them, without which there is an error."""
    before, after = np.flatnonzero(t < first)[-keep:], np.flatnonzero(t > last)[:keep]
    if len(before) < keep or len(after) < keep:
        raise ValueError(f"fewer than {keep} samples of the orbit before or after the scene")
    return np.concatenate((before, np.flatnonzero((t >= first) & (t <= last)), after))


def smooth(v: np.ndarray) -> np.ndarray:
    out = v.copy()
    out[1:-1] = v[:-2] / 6 + v[1:-1] * (2 / 3) + v[2:] / 6
    return out


def padded(t: np.ndarray, v: np.ndarray, first: float, last: float, step: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Samples with one more, a step outside, at an end that the scene goes beyond: the mean of the nearest two."""
    if t[0] > first:
        t, v = np.concatenate(([first - step], t)), np.concatenate(([v[:2].mean(axis=0)], v))
    if t[-1] < last:
        t, v = np.concatenate((t, [last + step])), np.concatenate((v, [v[-2:].mean(axis=0)]))
    return t, v


def repaired(t: np.ndarray, v: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Flagged samples on the line between valid ones, zeros if none is valid."""
    if bad.all():
        return np.zeros_like(v)
    out = v.copy()
    for k in range(v.shape[1]):
        out[bad, k] = np.interp(t[bad], t[~bad], v[~bad, k])
    return out


# From axes along the track, left of it and down to axes right, along the track and up.
SWAP = np.array([[0, 1, 0], [1, 0, 0], [0, 0, -1.0]])


def build_quaternion_sensor(d: dict) -> Sensor:
    """From the dictionary of a SPOT 6/7 scene: quadratic splines of orbit and attitude, looks from the line-of-sight polynomials."""
    n, cols = d["lines"], d["cols"]
    t = d["start"] + np.arange(n) * d["line_period"]
    orbit = bspline.interpolate(d["ephemeris_time"], np.hstack([d["position"], d["velocity"]]), t, 2)
    q = bspline.interpolate(d["attitude_time"], d["quaternion"], t, 2)
    k = np.arange(cols, dtype=float)
    look = np.stack([-np.polyval(list(d["los_x"])[::-1], k), np.polyval(list(d["los_y"])[::-1], k), np.full(cols, -1.0)], axis=1)
    # the attitude is of the platform in the earth-centred frame, so the orbital frame's rotation is taken off
    earth = orbital_frame(orbit[:, :3], orbit[:, 3:])
    to_orbit = np.einsum("nji,njk,kl->nil", earth, quaternion_matrix(q), SWAP)
    return Sensor(orbit[:, :3], to_orbit, earth, unit(look), orbit[:, 3:], {k: d[k] for k in ("sensor", "gsd") if k in d})


# Ground sampling distance of a full scene by its columns.
SCENE_GSD = {3000: 20.0, 6000: 10.0, 12000: 5.0, 24000: 2.5}


def build_angle_sensor(d: dict) -> Sensor:
    """From the dictionary of a SPOT 1-5 scene: Lagrange orbit, tangent looks, integrated and smoothed attitude angles by splines."""
    n, cols = d["lines"], d["cols"]
    t = d["centre_time"] + (np.arange(n) + 1 - d["centre_line"]) * d["line_period"]
    keep = trimmed(d["ephemeris_time"], t[0], t[-1])
    orbit = lagrange(d["ephemeris_time"][keep], np.hstack([d["position"], d["velocity"]])[keep], t)
    psi_x, psi_y = np.asarray(d["psi_x"], float), np.asarray(d["psi_y"], float)
    ends = unit(np.stack([-np.tan(psi_y), np.tan(psi_x), np.full(len(psi_x), -1.0)], axis=1))
    look = ends if len(ends) == cols else between(ends, np.arange(cols) * (len(ends) - 1) / max(1, cols - 1))  # often the two end detectors only
    if d.get("ccd") is not None:  # misalignment of the detectors, turned by the mirror
        a = (d.get("mirror_step", 0) - 48) * 0.6 * np.pi / 180
        turn = np.array([[np.cos(a), 0, -np.sin(a)], [0, 1, 0], [np.sin(a), 0, np.cos(a)]])
        look = look + np.asarray(d["ccd"], float)[:cols] @ turn.T
    if d.get("mission") == 5:
        at, angles = np.asarray(d["attitude_time"], float), np.asarray(d["attitude"], float)  # yaw, pitch, roll
        bad = np.asarray(d.get("attitude_bad", np.zeros(len(at), bool)))
        angles = repaired(at, angles, bad)
    else:
        at, bad = np.asarray(d["rate_time"], float), np.asarray(d.get("rate_bad", np.zeros(len(d["rate_time"]), bool)))
        rate = repaired(at, np.asarray(d["rate"], float), bad)
        start = np.where(np.asarray(d.get("angle_bad", [False]))[:1, None], 0.0, np.asarray(d["angle"], float)[:1])
        angles = start + np.vstack([np.zeros((1, 3)), np.cumsum(rate[1:] * np.diff(at)[:, None], axis=0)])
        angles = smooth(angles)
    at, angles = padded(at, angles, t[0], t[-1])
    yaw, pitch, roll = bspline.interpolate(at, angles, t, 3).T
    return Sensor(orbit[:, :3], opk(-pitch, -roll, yaw), orbital_frame(orbit[:, :3], orbit[:, 3:]), unit(look), orbit[:, 3:], {"gsd": SCENE_GSD.get(cols)})


def build_frame_sensor(d: dict) -> Sensor:
    """From the dictionary of a DigitalGlobe scene: linear orbit and attitude, a detector line in the camera frame turned by its quaternion."""
    n, cols = d["lines"], d["cols"]
    sign = 1 if d.get("forward", True) else -1
    t = d["first_line_time"] + sign * np.arange(n) / d["line_rate"]
    at = lambda x: np.interp(t, x, np.arange(len(x)))
    position = between(np.asarray(d["position"], float), at(d["ephemeris_time"]))
    velocity = between(np.asarray(d["velocity"], float), at(d["ephemeris_time"]))
    q = between(np.asarray(d["quaternion"], float), at(d["attitude_time"]))
    x, y = d["detector_origin"]
    angle, pitch = np.radians(d.get("detector_rotation", 0.0)), d["detector_pitch"]
    k = np.arange(cols) * pitch
    camera = np.stack([x + np.sin(angle) * -k, y + np.cos(angle) * -k, np.full(cols, d["focal"])], axis=1)
    body = camera @ quaternion_matrix(np.asarray([d["camera_quaternion"]], float))[0].T
    look = np.stack([body[:, 1], body[:, 0], -body[:, 2]], axis=1)
    earth = orbital_frame(position, velocity)
    to_orbit = np.einsum("nji,njk,kl->nil", earth, quaternion_matrix(q), SWAP)
    return Sensor(position, to_orbit, earth, unit(look), velocity, {})


BUILDERS = {"spot67": build_quaternion_sensor, "spot15": build_angle_sensor, "dg": build_frame_sensor}
