"""The model written out point by point in plain Python: the yardstick for the Spark jobs."""

from __future__ import annotations

import math

ATTR = ("longitude", "latitude", "speed", "heading")


def spline(x, y):
    """Natural cubic spline by a dense solve of the second-derivative system."""
    import numpy as np

    n = len(x)
    a, b = np.zeros((n, n)), np.zeros(n)
    a[0, 0] = a[-1, -1] = 1.0
    for k in range(1, n - 1):
        h0, h1 = x[k] - x[k - 1], x[k + 1] - x[k]
        a[k, k - 1 : k + 2] = h0, 2 * (h0 + h1), h1
        b[k] = 6 * ((y[k + 1] - y[k]) / h1 - (y[k] - y[k - 1]) / h0)
    m = np.linalg.solve(a, b)

    def value(t):
        k = max(j for j in range(n - 1) if x[j] <= t)
        h, u, v = x[k + 1] - x[k], x[k + 1] - t, t - x[k]
        return float(
            (m[k] * u**3 + m[k + 1] * v**3) / (6 * h)
            + (y[k] / h - m[k] * h / 6) * u
            + (y[k + 1] / h - m[k + 1] * h / 6) * v
        )

    return value


def resampled(points, s):
    """points: time-sorted (ts, lon, lat, speed, heading)."""
    ts = [p[0] for p in points]
    if len(points) < 3 or len(set(ts)) < len(ts):
        return []
    m = (ts[-1] - ts[0]) // s + 1
    x = [float(t - ts[0]) for t in ts]
    lon, lat = spline(x, [p[1] for p in points]), spline(x, [p[2] for p in points])
    out = [(ts[0], points[0][1], points[0][2], 0.0, 0.0)]
    out += [(ts[0] + j * s, lon(j * s), lat(j * s), 0.0, 0.0) for j in range(1, m - 1)]
    return [*out, (ts[0] + (m - 1) * s, points[-1][1], points[-1][2], 0.0, 0.0)]


def dot(w, x):
    total = w[0] * x[0]
    for a, b in zip(w[1:], x[1:], strict=True):
        total += a * b
    return total


class Track:
    def __init__(self, cfg):
        self.cfg, self.history, self.segment = cfg, [], -1

    def step(self, point):
        """One arrived point -> list of (step, ts, lon, lat, speed, heading, error)."""
        c = self.cfg
        h, p, s = c.window, c.train, c.sampling
        if not self.history or point[0] - self.history[-1][0] > c.gap_threshold:
            self.history, self.i = [], 0
            self.segment += 1
            self.w = [[2.0, -1.0] + [0.0] * (p - 2) for _ in ATTR]
            self.a = [[[c.epsilon * (r == q) for q in range(p)] for r in range(p)] for _ in ATTR]
        self.history.append(point)
        self.i += 1
        ts = [q[0] for q in self.history]
        self.visible = len(ts)
        self.irregular = any(b - a != s for a, b in zip(ts, ts[1:], strict=False))
        by_time = sorted(self.history, key=lambda q: q[0])
        self.span_ok = math.floor((ts[-1] - ts[0]) / s) + 1 > h
        if not self.irregular:
            z = by_time
        elif self.span_ok:
            z = resampled(by_time, s)
            self.i += len(z)
        else:
            z = []
        out = self.forecast(z) if len(z) >= h else []
        self.history = self.history[-h:]
        return out

    def forecast(self, z):
        c = self.cfg
        h, p, s = c.window, c.train, c.sampling
        if not c.diff:
            v = [q[1:] for q in z[-h:]]
        else:
            steps = [tuple(b - a for a, b in zip(r[1:], q[1:], strict=True)) for r, q in zip(z, z[1:], strict=False)]
            v = [(0.0, 0.0, *z[0][3:]), *steps] if len(z) == h else steps[-h:]
        mean = []
        for k in range(4):
            errors = []
            for split in range(p, h):
                x = [v[j][k] for j in range(split - 1, split - p - 1, -1)]
                e = dot(self.w[k], x) - v[split][k]
                errors.append(e)
                if c.newton:
                    g = [2 * xi * e for xi in x]
                    a = self.a[k]
                    left = [dot(row, g) for row in a]
                    right = [dot(g, [a[r][q] for r in range(p)]) for q in range(p)]
                    scale = dot(right, g) + 1
                    a = [
                        [a[r][q] - sum(left[r] * g[m] * a[m][q] for m in range(p)) / scale for q in range(p)]
                        for r in range(p)
                    ]
                    self.a[k] = a
                    self.w[k] = [
                        self.w[k][j] - dot(g, [a[r][j] for r in range(p)]) * c.lrate for j in range(p)
                    ]
                else:
                    rate = math.sqrt(self.i - p)
                    self.w[k] = [wj - (xj * 2 * e / rate) * c.lrate for wj, xj in zip(self.w[k], x, strict=True)]
            mean.append(sum(errors) / len(errors))
        base, seen = z[-1][0], self.history[-1]
        rows = []
        if c.corrected:
            on_diffs = c.diff and c.semantics == "fixed"
            source = [q for q in v[-p:]] if on_diffs else [q[1:] for q in z[-p:]]
            ahead = [dot(self.w[k], [q[k] for q in reversed(source)]) - abs(mean[k]) for k in range(4)]
            rows.append((0, *seen, False))
            now = seen[1:]
            for n in range(1, c.horizon + 1):
                now = tuple(a + b for a, b in zip(now, ahead, strict=True)) if c.diff else tuple(ahead)
                rows.append((n, base + n * s, *now, self.flag(now[2])))
            return rows
        recent, now = [list(q) for q in v[-p:]], seen[1:]
        for n in range(1, c.horizon + 1):
            ahead = [dot(self.w[k], [q[k] for q in reversed(recent[-p:])]) for k in range(4)]
            recent.append(ahead)
            now = (now[0] + ahead[0], now[1] + ahead[1], ahead[2], ahead[3]) if c.diff else tuple(ahead)
            rows.append((n, base + n * s, *now, self.flag(ahead[2])))
        return rows[1:] if c.variant == "arma_gd" else rows

    def flag(self, speed):
        return speed > self.cfg.speed_threshold or math.isnan(speed) or math.isinf(speed)


def forecasts(points, cfg):
    """points: (id, ts, lon, lat, speed, heading) in arrival order -> forecast rows keyed like the Spark output."""
    tracks, out = {}, []
    for key, *point in points:
        track = tracks.setdefault(key, Track(cfg))
        for n, ts, *values, error in track.step(tuple(point)):
            horizon = n if cfg.corrected else n - 1
            out.append((key, ts, *values, error, horizon, n, point[0], track.segment))
    return out
