"""Fixed-step window of each event, for a whole Arrow batch at once.

Every event carries its visible history: up to ``window + 1`` points, sorted by time. Events on the grid use those points
as they are; the others are resampled with a natural cubic spline. Only the last ``window + 1`` samples can matter to the
models, so only those are evaluated, however long the resampled series is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa


@dataclass
class Windows:
    values: np.ndarray  # (rows, 4, window) training series: levels or first differences
    levels: np.ndarray  # (rows, 4, train) last sampled positions
    base_ts: np.ndarray  # (rows,) time of the last sample


def natural_spline(x: np.ndarray, y: np.ndarray):
    """Coefficients (b, c, d) per interval; ``x`` is (rows, knots), ``y`` (rows, series, knots)."""
    step = np.diff(x)
    slope = np.diff(y) / step[:, None, :]
    n = x.shape[1]
    upper = np.zeros_like(x)
    rhs = np.zeros_like(y)
    for k in range(1, n - 1):
        pivot = 2.0 * (x[:, k + 1] - x[:, k - 1]) - step[:, k - 1] * upper[:, k - 1]
        upper[:, k] = step[:, k] / pivot
        load = 3.0 * (slope[:, :, k] - slope[:, :, k - 1])
        rhs[:, :, k] = (load - step[:, None, k - 1] * rhs[:, :, k - 1]) / pivot[:, None]
    c = np.zeros_like(y)
    for k in range(n - 2, -1, -1):
        c[:, :, k] = rhs[:, :, k] - upper[:, None, k] * c[:, :, k + 1]
    h = step[:, None, :]
    b = slope - h * (c[:, :, 1:] + 2.0 * c[:, :, :-1]) / 3.0
    d = np.diff(c) / (3.0 * h)
    return b, c[:, :, :-1], d


def spline_values(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Spline through (x, y) at the times ``at`` (rows, samples) -> (rows, series, samples)."""
    b, c, d = natural_spline(x, y)
    piece = (at[:, :, None] >= x[:, None, 1:-1]).sum(axis=2)
    dx = (at - np.take_along_axis(x, piece, axis=1))[:, None, :]
    piece = np.broadcast_to(piece[:, None, :], (at.shape[0], y.shape[1], at.shape[1]))
    a, b, c, d = (np.take_along_axis(v, piece, axis=2) for v in (y, b, c, d))
    return a + dx * (b + dx * (c + dx * d))


def _columns(history: pa.ListArray):
    points = history.values
    field = lambda name: points.field(name).to_numpy(zero_copy_only=False)
    series = np.stack([field(n) for n in ("longitude", "latitude", "speed", "heading")])
    return history.offsets.to_numpy(), field("timestamp"), series


def sampled_levels(history: pa.ListArray, irregular: np.ndarray, window: int, step: int):
    """``sample`` of histories that come as lists, each sorted by time."""
    offsets, ts, series = _columns(history)
    count = np.diff(offsets)
    width = max(window + 1, int(count.max(initial=0)))
    at = np.maximum(offsets[1:, None] - width + np.arange(width), 0)
    return sample(ts[at], series[:, at].transpose(1, 0, 2), count, irregular, window, step)


def in_time_order(ts: np.ndarray, series: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Histories (rows, points) sorted by time, equal times by their values."""
    order = np.lexsort((*series.transpose(1, 0, 2)[::-1], ts), axis=-1)
    return np.take_along_axis(ts, order, axis=1), np.take_along_axis(series, order[:, None, :], axis=2)


def sample(ts, series, count, irregular, window: int, step: int, sort: bool = False):
    """Last ``window + 1`` samples of each event: (rows, 4, window + 1), their count and the time of the last one.

    ``ts`` (rows, points) and ``series`` (rows, 4, points), of ``window + 1`` points or more, hold the ``count`` visible ones at their
    end; an event off the grid is resampled from all of them. Events with
    only ``window`` points on the grid leave the first slot unused; the count says so. ``sort``: points came in any order.
    """
    width, points = window + 1, ts.shape[1]
    levels = series[:, :, points - width :].copy()
    base_ts = ts[:, -1].copy()
    for n in np.unique(count[irregular]):
        rows = np.flatnonzero(irregular & (count == n))
        knots, values = ts[rows, points - n :], series[rows][:, :, points - n :]
        if sort:
            knots, values = in_time_order(knots, values)
        start = knots[:, 0]
        x = (knots - start[:, None]).astype(float)
        y = values[:, :2]
        last = (knots[:, -1] - start) // step
        at = last[:, None] + np.arange(1 - width, 1)
        found = spline_values(x, y, (at * step).astype(float))
        found[:, :, -1] = y[:, :, -1]  # the last sample keeps the last true position
        levels[rows, :2] = found
        levels[rows, 2:] = 0.0
        base_ts[rows] = start + last * step
    return levels, np.where(irregular, width, np.minimum(count, width)), base_ts


def windows(levels: np.ndarray, count: np.ndarray, base_ts: np.ndarray, train: int, diff: bool) -> Windows:
    """Training series of one model family from the sampled levels."""
    values = levels[:, :, 1:]
    if diff:
        values = np.diff(levels)
        short = count < levels.shape[2]
        values[short, :2, 0] = 0.0
        values[short, 2:, 0] = levels[short, 2:, 1]
    return Windows(values, levels[:, :, -train:], base_ts)
