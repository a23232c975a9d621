"""Weight recurrences, advanced for many tracks at a time.

Rows reach a task in wavefront order: the first trainable event of every track, then the second of every track, and so
on. One numpy step then updates all tracks of the partition together, and tracks never mix. The state held is one weight
vector (and Newton matrix) per live track, however long the tracks are.

State and series keep the weight index first - (train, rows, 4) - so that every term of a sum is one contiguous block.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np

from ..config import ATTRIBUTES, ModelConfig


def dot(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sum of products along the first axis, added from first to last."""
    terms = w * x
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


def linear_start(train: int) -> np.ndarray:
    # The linear start vector continues the last step.
    return np.array([2.0, -1.0] + [0.0] * (train - 2))


class Series:
    """Training pairs of a batch: features newest first (train, rows, 4), targets (rows, 4), step roots (rows, 1)."""

    def __init__(self, values: np.ndarray, i: np.ndarray, train: int):
        v = np.ascontiguousarray(values.transpose(2, 0, 1))
        ends = range(train, v.shape[0])
        self.features = [v[k - train : k][::-1] for k in ends]
        self.targets = [v[k] for k in ends]
        self.root = np.sqrt((i - train).astype(float))[:, None]


class Weights:
    """Weights of one configuration for all live tracks of a partition.

    With ``piece``, tracks of gradient jobs are learnt in pieces of so many events: where a track goes on after a piece, the weights
    after it come from the affine map of the piece (see ``Pieces``). The same holds wherever a track lies, so its weights do
    not depend on how points are laid out.
    """

    def __init__(self, cfg: ModelConfig, piece: int = 0):
        self.cfg = cfg
        p = cfg.train
        self.w = np.empty((p, 0, 4))
        self.a = np.empty((p, p, 0, 4)) if cfg.newton else None
        self.opened: list = []
        self.pieces = Pieces(cfg) if piece and not cfg.newton else None

    def open(self, n: int, w0=None, a0=None) -> None:
        """Start ``n`` tracks. ``w0``/``a0`` are (mask, values of the masked rows) that replace the configured start."""
        p = self.cfg.train
        self.w = np.empty((p, n, 4))
        self.w[:] = linear_start(p)[:, None, None]
        if w0 is not None:
            self.w[:, w0[0]] = w0[1].reshape(-1, 4, p).transpose(2, 0, 1)
        if self.cfg.newton:
            self.a = np.empty((p, p, n, 4))
            self.a[:] = (np.eye(p) * self.cfg.epsilon)[:, :, None, None]
            if a0 is not None:
                self.a[:, :, a0[0]] = a0[1].reshape(-1, 4, p, p).transpose(2, 3, 0, 1)

    def park(self) -> None:
        self.opened.append((self.w, self.a))

    def keep(self, live: np.ndarray) -> None:
        if self.opened:
            self.w = np.concatenate([w for w, _ in self.opened], axis=1)
            if self.a is not None:
                self.a = np.concatenate([a for _, a in self.opened], axis=2)
            self.opened = []
        if not live.all():
            self.w = self.w[:, live]
            if self.a is not None:
                self.a = self.a[:, :, live]
            if self.pieces is not None:
                self.pieces.keep(live)

    def learn(self, at: slice | np.ndarray, series: Series, rows: slice, predicted: np.ndarray) -> None:
        """Train tracks ``at`` on the events ``rows``, one each; predictions go to ``predicted`` (pairs, rows, 4)."""
        w = self.w[:, at]
        a = None if self.a is None else self.a[:, :, at]
        root, lrate = series.root[rows], self.cfg.lrate
        for k, features in enumerate(series.features):
            x = features[:, rows]
            guess = dot(w, x)
            error = guess - series.targets[k][rows]
            if a is None:
                w -= x * 2 * error / root * lrate
            else:
                newton_step(a, w, 2 * x * error, lrate)
            predicted[k, rows] = guess
        if not isinstance(at, slice):  # those were copies
            self.w[:, at] = w
            if a is not None:
                self.a[:, :, at] = a

    def flat(self) -> tuple[np.ndarray, np.ndarray | None]:
        return flat_weights(self.w), None if self.a is None else flat_matrix(self.a)


#: Fixed part of the rule for pieces: a map with larger entries is not used, and the weights go on as they came along the piece.
LARGEST_MAP = 10.0


class Pieces:
    """Affine maps of the pieces in which the tracks of a wavefront are, for the tracks that go on after their piece.

    All tracks of a round are at the same place of their piece, so pieces begin and end for all of them together.
    """

    def __init__(self, cfg: ModelConfig):
        self.lrate, self.train = cfg.lrate, cfg.train
        self._clear()

    def _clear(self) -> None:
        self.where = np.empty(0, np.int64)  # places of these tracks among those of the round
        self.begin = np.empty((self.train, 0, 4))
        self.maps = identity_map(0, self.train)

    def start(self, first: int, goes_on: np.ndarray, w: np.ndarray) -> None:
        """Tracks ``first``, ``first + 1``, ... of the round begin a piece with weights ``w``."""
        found = np.flatnonzero(goes_on)
        if len(found):
            self.where = np.concatenate([self.where, first + found])
            self.begin = np.concatenate([self.begin, w[:, found]], axis=1)
            self.maps = np.concatenate([self.maps, identity_map(len(found), self.train)], axis=1)

    def keep(self, live: np.ndarray) -> None:
        stay = live[self.where]
        if not stay.all():
            self.begin, self.maps = self.begin[:, stay], self.maps[:, stay]
        self.where = (np.cumsum(live) - 1)[self.where[stay]]

    def learn(self, first: int, n: int, trained: np.ndarray | None, series: Series, rows: slice) -> None:
        """One event of tracks ``first`` to ``first + n - 1``, or of those ``trained`` among them; its values are ``rows`` of series."""
        a, b = np.searchsorted(self.where, (first, first + n))
        if a == b:
            return
        local, at = self.where[a:b] - first, np.arange(a, b)
        if trained is not None:
            place = np.searchsorted(trained, local)
            hit = np.append(trained, -1)[place] == local
            local, at = place[hit], at[hit]
        state = self.maps[:, at]
        gradient_map(state, series, rows.start + local, self.lrate)
        self.maps[:, at] = state

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """Tracks of the round whose weights after the piece come from its map, and those weights."""
        maps = flat_map(self.maps)
        fit = map_sizes(maps, self.train) <= LARGEST_MAP
        return self.where[fit], apply_map(maps[fit], self.begin[:, fit])

    def settle(self, w: np.ndarray) -> None:
        """Pieces are over: put their weights in, and forget them."""
        if len(self.where):
            at, after = self.ends()
            w[:, at] = after
        self._clear()


def map_sizes(maps: np.ndarray, train: int) -> np.ndarray:
    """Largest entry of the linear part of each flattened map; infinite where it is not a number."""
    size = np.abs(maps[:, 4 * train :]).max(axis=1, initial=0.0)
    size[~np.isfinite(maps).all(axis=1)] = np.inf
    return size


def flat_weights(w: np.ndarray) -> np.ndarray:
    """(train, rows, 4) -> (rows, 4 * train), attribute by attribute."""
    return w.transpose(1, 2, 0).reshape(w.shape[1], -1)


def flat_matrix(a: np.ndarray) -> np.ndarray:
    return a.transpose(2, 3, 0, 1).reshape(a.shape[2], -1)


def newton_step(a: np.ndarray, w: np.ndarray, g: np.ndarray, lrate: float) -> None:
    """Rank-one update of the inverse matrix, then a step along ``g A``; both in place."""
    column, row = a[:, 0] * g[0], g[0] * a[0]
    for k in range(1, len(g)):
        column = column + a[:, k] * g[k]
        row = row + g[k] * a[k]
    scale = dot(row, g) + 1
    change = (column * g[0])[:, None] * a[0]
    for k in range(1, len(g)):
        change = change + (column * g[k])[:, None] * a[k]
    a -= change / scale
    move = g[0] * a[0]
    for k in range(1, len(g)):
        move = move + g[k] * a[k]
    w -= move * lrate


def gradient_map(state: np.ndarray, series: Series, rows: slice, lrate: float) -> None:
    """Advance affine maps of the gradient step by one event, in place.

    ``state`` is (train, rows, train + 1, 4): entry 0 is the image of the zero vector, the others are the images of the
    unit vectors under the linear part. A whole chunk of events thus becomes one affine map of its start weights.
    """
    root = series.root[rows][:, None]
    for k, features in enumerate(series.features):
        x = features[:, rows][:, :, None]
        error = dot(state, x)
        error[:, 0] -= series.targets[k][rows]
        state -= x * 2 * error / root * lrate


def identity_map(rows: int, train: int) -> np.ndarray:
    state = np.zeros((train, rows, train + 1, 4))
    for j in range(train):
        state[j, :, j + 1] = 1.0
    return state


def flat_map(state: np.ndarray) -> np.ndarray:
    """(train, rows, train + 1, 4) -> (rows, (train + 1) * 4 * train)."""
    return state.transpose(1, 2, 3, 0).reshape(state.shape[1], -1)


def apply_map(maps: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weights after a chunk from the weights (train, rows, 4) before it; ``maps`` as flattened."""
    p = w.shape[0]
    parts = maps.reshape(-1, p + 1, 4, p).transpose(3, 0, 1, 2)
    out = parts[:, :, 0].copy()
    for j in range(p):
        out += parts[:, :, j + 1] * w[j]
    return out


def forecasts(cfg: ModelConfig, w: np.ndarray, values, levels, observed, residual) -> np.ndarray:
    """Forecast series (rows, 4, steps) of one event per row, from its weights (train, rows, 4).

    Plain jobs feed each forecast back as the newest feature. Corrected jobs keep the last sampled window for every
    step and subtract the size of the mean residual; their first entry is the observed point.
    """
    p, horizon = cfg.train, cfg.horizon
    newest_first = lambda v: v[:, :, -p:][:, :, ::-1].transpose(2, 0, 1)
    if cfg.from_observed:
        on_diffs = cfg.diff and cfg.corrected and cfg.semantics == "fixed"
        step = dot(w, newest_first(values if on_diffs else levels))
        if cfg.corrected:
            step = step - np.abs(residual)
        steps = np.repeat(step[:, :, None], horizon, axis=2)
        path = np.concatenate([observed[:, :, None], steps], axis=2)
        return np.cumsum(path, axis=2) if cfg.diff and cfg.corrected else path
    recent = list(newest_first(values))
    out = np.empty((*w.shape[1:], horizon))
    for k in range(horizon):
        ahead = w[0] * recent[0]
        for j in range(1, p):
            ahead = ahead + w[j] * recent[j]
        out[:, :, k] = ahead
        recent = [ahead, *recent[:-1]]
    if cfg.diff:  # positions are summed up from the last observed point; speed and heading stay differences
        track = np.cumsum(np.concatenate([observed[:, :2, None], out[:, :2]], axis=2), axis=2)
        out[:, :2] = track[:, :, 1:]
    return out


def random_weights(cfg: ModelConfig, key: int, segment: int) -> np.ndarray:
    """Start weights from {-1.00 .. 1.00}: the same hash as the column expression of the batch jobs."""
    draws = []
    for name in ATTRIBUTES:
        for j in range(cfg.train):
            text = f"{cfg.seed}|{key}|{segment}|{name}|{j}"
            draws.append(int(md5(text.encode()).hexdigest()[:8], 16) % 201 - 100)
    return np.array(draws) / 100
