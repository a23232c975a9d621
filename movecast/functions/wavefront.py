"""Arrow tasks that carry per-track model state through one partition (used with ``mapInArrow``).

Input rows are events sorted by (t, track), where ``t`` counts the events of a track from 1 and ``more`` tells whether the track has
another one. The tracks of round ``t + 1`` are those of round ``t`` with ``more``, in the same order, so rows find their state by
position alone. A row brings its own point only; the points before it are those of the same track in the rounds before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import functions as F

from ..config import ATTRIBUTES, ModelConfig
from . import recurrence
from .sampling import sample, sampled_levels, windows


#: Columns of a true position.
TRUE = ("true_longitude", "true_latitude")


def lists(values: np.ndarray, where: np.ndarray | None = None) -> pa.Array:
    """(rows, n) floats as a list column; rows outside ``where`` become null."""
    rows, n = values.shape
    if where is None:
        offsets = np.arange(rows + 1, dtype=np.int32) * n
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.reshape(-1)))
    ends = np.concatenate([[0], np.cumsum(np.where(where, n, 0))]).astype(np.int32)
    offsets = pa.array(ends, mask=np.append(~where, False))
    return pa.ListArray.from_arrays(offsets, pa.array(values[where].reshape(-1)))


def numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _given(batch: pa.RecordBatch, name: str, at: slice):
    """Start values of rows ``at``: (mask of rows that have some, their flattened values)."""
    if name not in batch.schema.names:
        return None
    column = batch.column(name).slice(at.start, at.stop - at.start)
    return ~np.asarray(column.is_null()), column.flatten().to_numpy(zero_copy_only=False)


def rounds(t: np.ndarray) -> Iterator[slice]:
    """Runs of equal ``t``."""
    edges = np.concatenate([[0], np.flatnonzero(np.diff(t)) + 1, [len(t)]])
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b > a:
            yield slice(int(a), int(b))


@dataclass(frozen=True)
class Round:
    """Rows of one round, as far as a batch has them."""

    t: int
    rows: slice
    live: np.ndarray | None  # tracks of the round before that are in this one, when it begins
    first: int  # tracks of this round before these rows

    @property
    def n(self) -> int:
        return self.rows.stop - self.rows.start

    @property
    def at(self) -> slice:
        """State of these rows: tracks that just begin have one of their own."""
        return slice(0, self.n) if self.t == 1 else slice(self.first, self.first + self.n)


class Front:
    """Position of the wavefront: how far the current round has come, and which of its tracks go on."""

    def __init__(self):
        self.t = 0
        self.more: list[np.ndarray] = []

    def rounds(self, t: np.ndarray, more: np.ndarray) -> list[Round]:
        """The rounds of a batch."""
        out = []
        for rows in rounds(t):
            now, live = int(t[rows.start]), None
            if now != self.t:
                live = np.concatenate(self.more) if self.more else np.empty(0, dtype=bool)
                self.more, self.t = [], now
            first = sum(map(len, self.more))
            self.more.append(more[rows])
            out.append(Round(now, rows, live, first))
        return out


class Histories:
    """Last points of the live tracks. Points lie in one pool; each knows the place of the one before it (0: there is none).

    The pool is cleared of points that no later row sees when it holds twice what the live tracks need, so its upkeep is in
    proportion to the rows, however many tracks a partition has.
    """

    SLACK = 1 << 16  # points that the pool may hold besides

    def __init__(self, width: int):
        self.width = width
        self.size = 1
        self.ts, self.values, self.back = np.zeros(1024, np.int64), np.zeros((1024, 4)), np.zeros(1024, np.int64)
        self.last = np.empty(0, np.int64)  # newest point of each track that goes on from the round before
        self.now: list[np.ndarray] = []  # newest points of the tracks of this round

    def _add(self, ts: np.ndarray, values: np.ndarray) -> np.ndarray:
        first, self.size = self.size, self.size + len(ts)
        if self.size > len(self.ts):
            more = max(self.size, 2 * len(self.ts)) - len(self.ts)
            self.ts, self.back = (np.concatenate([v, np.zeros(more, np.int64)]) for v in (self.ts, self.back))
            self.values = np.concatenate([self.values, np.zeros((more, 4))])
        self.ts[first : self.size], self.values[first : self.size], self.back[first : self.size] = ts, values, 0
        return np.arange(first, self.size)

    def take(self, batch: pa.RecordBatch, values: np.ndarray, steps: list[Round]) -> np.ndarray:
        """(rows, width) places of the points that each row sees, oldest first."""
        given, count = None, None
        if "before" in batch.schema.names:  # the points before the first one of a piece come with it
            lists_ = batch.column("before")
            known = pa.compute.list_flatten(lists_)
            field = lambda name: known.field(name).to_numpy(zero_copy_only=False)
            count = pa.compute.fill_null(pa.compute.list_value_length(lists_), 0).to_numpy()
            given = self._add(field("timestamp"), np.stack([field(a) for a in ATTRIBUTES], axis=1))
            ends = np.cumsum(count)
            self.back[given[1:]] = given[:-1]
            begin = (ends - count)[count > 0]
            self.back[given[begin]] = 0
        places = self._add(numbers(batch, "timestamp"), values)
        for s in steps:
            here = places[s.rows]
            if s.live is not None:
                self.last = np.concatenate(self.now)[s.live] if self.now else np.empty(0, np.int64)
                self.now = []
            if s.t > 1:
                self.back[here] = self.last[s.at]
            elif given is not None:
                has = np.flatnonzero(count[s.rows] > 0) + s.rows.start
                self.back[places[has]] = given[ends[has] - 1]
            self.now.append(here)
        return self.seen(places, self.width)

    def seen(self, places: np.ndarray, width: int) -> np.ndarray:
        out = np.empty((len(places), width), np.int64)
        out[:, -1] = places
        for k in range(width - 2, -1, -1):
            out[:, k] = self.back[out[:, k + 1]]
        return out

    def shrink(self) -> None:
        """Forget what no later row sees, if that is most of the pool."""
        used = sum(map(len, self.now))
        waiting, keep = self.last[used:], self.width - 1
        if self.size <= 2 * keep * (len(waiting) + used) + self.SLACK:
            return
        seen = self.seen(np.concatenate([waiting, *self.now]), keep)
        slots = np.where(seen > 0, 1 + np.arange(seen.size).reshape(seen.shape), 0)
        flat = np.append(0, seen.ravel())
        self.size = len(flat)
        self.ts, self.values = self.ts[flat], self.values[flat]
        self.back = np.append(0, np.concatenate([np.zeros((len(seen), 1), np.int64), slots[:, :-1]], axis=1).ravel())
        newest = slots[:, -1]
        self.last = np.concatenate([np.zeros(min(used, len(self.last)), np.int64), newest[: len(waiting)]])
        self.now = [newest[len(waiting) :]]


class Truths:
    """True positions at the times for which the newest events of the live tracks are forecast.

    An event brings those that the event before it lacks (``ahead``) and keeps that event's from a time on (``kept_from``), so what is
    held is in proportion to the live tracks and a forecast's steps.
    """

    KIND = np.dtype([("at", "i8"), *[(c, "f8") for c in TRUE], *[(f"no_{c}", "?") for c in TRUE]])

    def __init__(self):
        self.last, self.ends = np.empty(0, self.KIND), np.zeros(1, np.int64)  # of the tracks that go on from the round before
        self.now: list[tuple[np.ndarray, np.ndarray]] = []  # of the tracks of this round: how many each has, and all of them

    def _brought(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        column = batch.column("ahead")
        found, places = pa.compute.list_flatten(column), pa.compute.fill_null(pa.compute.list_value_length(column), 0)
        out = np.empty(len(found), self.KIND)
        out["at"] = found.field("at").to_numpy(zero_copy_only=False)
        for c in TRUE:
            out[f"no_{c}"] = found.field(c).is_null().to_numpy(zero_copy_only=False)
            out[c] = found.field(c).to_numpy(zero_copy_only=False)
        return places.to_numpy(zero_copy_only=False).astype(np.int64), out

    def take(self, batch: pa.RecordBatch, steps: list[Round]) -> tuple[np.ndarray, np.ndarray]:
        """The row of each true position that the rows of a batch have, and all of these, row by row."""
        count, brought = self._brought(batch)
        ends, kept_from = np.append(0, np.cumsum(count)), numbers(batch, "kept_from")
        rows, found = [], []
        for s in steps:
            if s.live is not None:
                self._go_on(s.live)
            has, who = brought[ends[s.rows.start] : ends[s.rows.stop]], np.repeat(np.arange(s.n), count[s.rows])
            if s.t > 1:
                mine = self.ends[s.at.start : s.at.stop + 1]
                had, owner = self.last[mine[0] : mine[-1]], np.repeat(np.arange(s.n), np.diff(mine))
                stay = had["at"] >= kept_from[s.rows][owner]
                has, who = np.concatenate([had[stay], has]), np.concatenate([owner[stay], who])
                order = np.argsort(who, kind="stable")
                has, who = has[order], who[order]
            self.now.append((np.bincount(who, minlength=s.n), has))
            rows.append(who + s.rows.start)
            found.append(has)
        return np.concatenate(rows), np.concatenate(found)

    def _go_on(self, live: np.ndarray) -> None:
        if self.now:
            count, has = (np.concatenate(v) for v in zip(*self.now, strict=True))
            self.last, self.ends = has[np.repeat(live, count)], np.append(0, np.cumsum(count[live]))
        self.now = []


def truth_lists(rows: np.ndarray, found: np.ndarray, own: np.ndarray, base: np.ndarray, cfg: ModelConfig) -> pa.Array:
    """True positions at the time of each forecast entry of events, as lists of lists.

    ``found`` are those of the events ``rows``; ``own``, ``base``: times of the events and of their last samples.
    """
    size, at = cfg.horizon + cfg.from_observed, found["at"]
    ahead, rest = np.divmod(at - base[rows], cfg.sampling)
    hit = (rest == 0) & (ahead >= 1) & (ahead <= cfg.horizon)
    entry = ahead if cfg.from_observed else ahead - 1
    if cfg.from_observed:  # entry 0 is the observed point
        observed = at == own[rows]
        hit, entry = hit | observed, np.where(observed, 0, entry)
    cell, found = (rows * size + entry)[hit], found[hit]
    order = np.argsort(cell, kind="stable")
    found, ends = found[order], np.append(0, np.cumsum(np.bincount(cell, minlength=len(own) * size))).astype(np.int32)
    places = pa.StructArray.from_arrays([pa.array(found[c].copy(), mask=found[f"no_{c}"].copy()) for c in TRUE], names=list(TRUE))
    lists_ = pa.ListArray.from_arrays(pa.array(ends), places)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * size), lists_)


class _Seen:
    """What the configurations of one window size see of a batch: their training events and the samples at these."""

    def __init__(self, batch: pa.RecordBatch, history: Histories, places: np.ndarray, configs: list[ModelConfig], named: Callable, true=None):
        window, c = configs[0].window, configs[0]
        self.use = np.flatnonzero(numbers(batch, named("trains")))
        self.whole = len(self.use) == batch.num_rows
        seen = places[self.use, -(window + 1) :]
        irregular = numbers(batch, named("irregular"))[self.use]
        count = (seen > 0).sum(axis=1)
        series = history.values[seen].transpose(0, 2, 1)
        sampled = sample(history.ts[seen], series, count, irregular, window, c.sampling, c.order == "arrival")
        i = numbers(batch, named("i"))[self.use]
        self.inputs, self.series = {}, {}
        for cfg in configs:
            key = (cfg.train, cfg.diff)
            if key not in self.inputs:
                self.inputs[key] = windows(*sampled, cfg.train, cfg.diff)
                self.series[key] = recurrence.Series(self.inputs[key].values, i, cfg.train)
        self.truth: dict[tuple, pa.Array] = {}
        if true is not None and len(self.use):
            rows, found = true
            mine = np.full(batch.num_rows, -1)
            mine[self.use] = np.arange(len(self.use))
            used = mine[rows] >= 0
            own = numbers(batch, "timestamp")[self.use]
            for cfg in {(c.horizon, c.from_observed): c for c in configs}.values():
                self.truth[cfg.horizon, cfg.from_observed] = truth_lists(mine[rows[used]], found[used], own, sampled[2], cfg)

    def of(self, s: Round) -> tuple[slice, np.ndarray | None]:
        """Training events of a round (places among all of them) and the rows of the round that they are; None: all."""
        if self.whole:
            return s.rows, None
        a, b = np.searchsorted(self.use, (s.rows.start, s.rows.stop))
        return slice(int(a), int(b)), (None if b - a == s.n else self.use[a:b] - s.rows.start)


#: Forecast values that a configuration makes of a batch at most; larger batches are taken in stretches.
BATCH_VALUES = 1 << 18


def _stretches(batches: Iterable[pa.RecordBatch], configs: list[ModelConfig]) -> Iterator[pa.RecordBatch]:
    """Batches of so few rows that what is made of them stays small, however long the forecasts are."""
    rows = max(1, BATCH_VALUES // (len(ATTRIBUTES) * max(c.horizon for c in configs)))
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def model_task(configs: list[ModelConfig], want: str, state: bool, piece: int, named: Callable) -> Callable:
    """Task that trains every configuration on every event and returns ``want`` of its training events.

    ``want`` is "forecast", "weights" or "backtest"; with ``state`` each track also gives a row of its final weights (``last``).
    ``piece``: events of a piece (see ``recurrence.Weights``). ``named``: column of a window size.
    """
    sizes = sorted({c.window for c in configs})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = [recurrence.Weights(c, piece) for c in configs]
        front, history, truths = Front(), Histories(max(sizes) + 1), Truths()
        for batch in _stretches(batches, configs):
            t, more = numbers(batch, "t"), numbers(batch, "more")
            observed = np.stack([numbers(batch, a) for a in ATTRIBUTES], axis=1)
            steps = front.rounds(t, more)
            places = history.take(batch, observed, steps)
            true = truths.take(batch, steps) if "ahead" in batch.schema.names else None
            with np.errstate(all="ignore"):
                seen = {h: _Seen(batch, history, places, [c for c in configs if c.window == h], lambda c, h=h: named(c, h), true) for h in sizes}
                history.shrink()
                for k, (cfg, model) in enumerate(zip(configs, models, strict=True)):
                    yield from _train(batch, k, cfg, model, seen[cfg.window], steps, more, observed, want, state, piece)

    return run


def _train(batch, k: int, cfg: ModelConfig, model, seen: _Seen, steps, more, observed, want: str, state: bool, piece: int):
    """Train one configuration on a batch."""
    key = (cfg.train, cfg.diff)
    series, inputs, n = seen.series[key], seen.inputs[key], len(seen.use)
    keep = want == "weights"
    weights = np.empty((cfg.train, n, 4))
    matrices = np.empty((cfg.train, cfg.train, n, 4)) if keep and cfg.newton else None
    predicted = np.empty((cfg.window - cfg.train, n, 4))
    final = []
    goes_on = numbers(batch, "goes_on") if model.pieces is not None else None
    for s in steps:
        if s.live is not None:
            model.keep(s.live)
        if s.t == 1:
            model.open(s.n, _given(batch, f"w0_{k}", s.rows), _given(batch, f"a0_{k}", s.rows))
        if model.pieces is not None and (s.t - 1) % piece == 0:
            if s.live is not None:
                model.pieces.settle(model.w)
            model.pieces.start(s.first, goes_on[s.rows], model.w[:, s.at])
        rows, trained = seen.of(s)
        if rows.stop > rows.start:
            at = s.at if trained is None else s.at.start + trained
            model.learn(at, series, rows, predicted)
            if model.pieces is not None:
                model.pieces.learn(s.first, s.n, trained, series, rows)
            weights[:, rows] = model.w[:, at]
            if matrices is not None:
                matrices[:, :, rows] = model.a[:, :, at]
        if state and not more[s.rows].all():
            final.append(_final(model, s, np.flatnonzero(~more[s.rows]), piece))
        if s.t == 1:
            model.park()
    if n:
        actual = np.stack(series.targets)
        out = _base(batch if seen.whole else batch.take(pa.array(seen.use)), k)
        if want == "forecast":
            out |= _forecast(observed[seen.use], cfg, weights, predicted - actual, inputs)
        elif want == "backtest":
            for name, v in (("predicted", predicted), ("actual", actual)):
                out[name] = lists(v.transpose(1, 2, 0).reshape(n, -1))
        nothing = pa.nulls(n, pa.list_(pa.float64()))
        if keep or state:
            out["w"] = lists(recurrence.flat_weights(weights)) if keep else nothing
            out["a"] = nothing if matrices is None else lists(recurrence.flat_matrix(matrices))
        if state:
            out["last"] = pa.array(np.zeros(n, bool))
        if seen.truth:
            out["truth"] = seen.truth[cfg.horizon, cfg.from_observed]
        yield pa.RecordBatch.from_pydict(out)
    if final:
        rows, w, a = zip(*final, strict=True)
        rows, w = np.concatenate(rows), np.concatenate(w, axis=1)
        out = _base(batch.take(pa.array(rows)), k)
        names = [c.split()[0] for c in model_schema(want, True, "ahead" in batch.schema.names).split(", ")]
        out["w"] = lists(recurrence.flat_weights(w))
        out["a"] = lists(recurrence.flat_matrix(np.concatenate(a, axis=2))) if cfg.newton else pa.nulls(len(rows), pa.list_(pa.float64()))
        out["last"] = pa.array(np.ones(len(rows), bool))
        fill = {"base_ts": pa.int64(), "truth": pa.list_(pa.list_(pa.struct([(c, pa.float64()) for c in TRUE])))}
        out |= {c: pa.nulls(len(rows), fill.get(c, pa.list_(pa.float64()))) for c in names if c not in out}
        yield pa.RecordBatch.from_pydict({c: out[c] for c in names})


def _final(model, s: Round, ended: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Rows whose track ends, with the weights that it goes on with elsewhere: where a piece ends too, those after the piece."""
    at = s.at.start + ended
    w = model.w[:, at]
    if model.pieces is not None and s.t % piece == 0 and len(model.pieces.where):
        where, after = model.pieces.ends()
        place = np.searchsorted(where, s.first + ended)
        hit = np.append(where, -1)[place] == s.first + ended
        w[:, hit] = after[:, place[hit]]
    return s.rows.start + ended, w, None if model.a is None else model.a[:, :, at]


#: True positions at the time of each entry of the forecasts.
TRUTH = "array<array<struct<" + ",".join(f"{c}:double" for c in TRUE) + ">>>"


def model_schema(want: str, state: bool, truth: bool = False) -> str:
    columns = ["id int", "segment bigint", "origin_timestamp bigint", "config int"]
    if want == "forecast":
        columns += ["base_ts bigint"] + [f"{a} array<double>" for a in ATTRIBUTES]
    elif want == "backtest":
        columns += ["predicted array<double>", "actual array<double>"]
    if want == "weights" or state:
        columns += ["w array<double>", "a array<double>"]
    if state:
        columns.append("last boolean")
    if truth:
        columns.append(f"truth {TRUTH}")
    return ", ".join(columns)


def _base(batch: pa.RecordBatch, config: int) -> dict:
    return {
        "id": batch.column("id"),
        "segment": batch.column("segment"),
        "origin_timestamp": batch.column("timestamp"),
        "config": pa.array(np.full(batch.num_rows, config, dtype=np.int32)),
    }


def _forecast(observed, cfg: ModelConfig, weights, residual, inputs) -> dict:
    mean = residual[0].copy()
    for r in residual[1:]:
        mean += r
    mean /= len(residual)
    path = recurrence.forecasts(cfg, weights, inputs.values, inputs.levels, observed, mean)
    return {"base_ts": pa.array(inputs.base_ts)} | {a: lists(path[:, j]) for j, a in enumerate(ATTRIBUTES)}


def map_task(cfg: ModelConfig, named: Callable) -> Callable:
    """Task that folds each piece of events into one affine map of its start weights (gradient jobs).

    Emits one row per piece: the map, and the largest entry of its linear part.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        front, history = Front(), Histories(cfg.window + 1)
        pieces = recurrence.Pieces(cfg)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            more = numbers(batch, "more")
            steps = front.rounds(numbers(batch, "t"), more)
            places = history.take(batch, np.stack([numbers(batch, a) for a in ATTRIBUTES], axis=1), steps)
            ended, maps = [], []
            with np.errstate(all="ignore"):
                seen = _Seen(batch, history, places, [cfg], lambda c: named(c, cfg.window))
                history.shrink()
                series = seen.series[cfg.train, cfg.diff]
                for s in steps:
                    if s.live is not None and s.t > 1:
                        pieces.keep(s.live)
                    if s.t == 1:
                        pieces.start(s.first, np.ones(s.n, dtype=bool), np.zeros((cfg.train, s.n, 4)))
                    rows, trained = seen.of(s)
                    if rows.stop > rows.start:
                        pieces.learn(s.first, s.n, trained, series, rows)
                    over = np.flatnonzero(~more[s.rows])
                    if len(over):
                        ended.append(over + s.rows.start)
                        maps.append(recurrence.flat_map(pieces.maps[:, s.first + over]))
            if ended:
                maps = np.concatenate(maps)
                out = {n: batch.column(n).take(pa.array(np.concatenate(ended))) for n in ("id", "segment", "piece")}
                yield pa.RecordBatch.from_pydict(out | {"map": lists(maps), "size": pa.array(recurrence.map_sizes(maps, cfg.train))})

    return run


MAP_SCHEMA = "id int, segment bigint, piece bigint, map array<double>, size double"


def carry_task(cfg: ModelConfig) -> Callable:
    """Task that runs the maps of pieces in order and returns the weights with which the piece after each one starts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, front = recurrence.Weights(cfg), Front()
        for batch in batches:
            if batch.num_rows == 0:
                continue
            t = numbers(batch, "t")
            maps = batch.column("map").flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)
            after = np.empty((cfg.train, len(t), 4))
            for s in front.rounds(t, numbers(batch, "more")):
                if s.live is not None:
                    model.keep(s.live)
                if s.t == 1:
                    model.open(s.n, _given(batch, "w0_0", s.rows))
                model.w[:, s.at] = recurrence.apply_map(maps[s.rows], model.w[:, s.at])
                after[:, s.rows] = model.w[:, s.at]
                if s.t == 1:
                    model.park()
            out = {n: batch.column(n) for n in ("id", "segment")}
            out["piece"] = pa.array(numbers(batch, "piece") + 1)
            yield pa.RecordBatch.from_pydict(out | {"w0_0": lists(recurrence.flat_weights(after))})

    return run


CARRY_SCHEMA = "id int, segment bigint, piece bigint, w0_0 array<double>"


def resampled_series(window: int, step: int, train: int, diff: bool) -> Callable:
    """Arrow function from an event's history off the grid to its training series; null where the history is null."""
    kind = pa.struct([(a, pa.list_(pa.float64())) for a in ATTRIBUTES])

    @F.arrow_udf("struct<" + ", ".join(f"{a}:array<double>" for a in ATTRIBUTES) + ">")
    def series(history: pa.Array) -> pa.Array:
        given = np.flatnonzero(~history.is_null().to_numpy(zero_copy_only=False))
        if not len(given):
            return pa.nulls(len(history), kind)
        known = pa.concat_arrays([history.take(pa.array(given))])
        sampled = sampled_levels(known, np.ones(len(given), dtype=bool), window, step)
        values = windows(*sampled, train, diff).values
        found = pa.StructArray.from_arrays([lists(values[:, j]) for j in range(4)], names=list(ATTRIBUTES))
        place = np.full(len(history), -1)
        place[given] = np.arange(len(given))
        return found.take(pa.array(place, mask=place < 0))

    return series
