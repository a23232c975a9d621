"""Forecasts over a stream of points, with one small state per object.

The state holds the last ``window`` points, the weights and the step counter, never the track. Points of one object are
taken in arrival order: by ``seq`` when the stream has it (a file position, a Kafka offset), else by time within each
micro-batch. Objects are dealt by a hash of their id to ``GROUPS`` groups, whose states are stored together and whose
micro-batch is laid out and learnt together, one numpy step for the next event of each object. A micro-batch of one group is held
while it is put in order, so bound it with the source's rate limit (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import ATTRIBUTES, ModelConfig
from ..functions import recurrence
from ..functions.sampling import sampled_levels, windows
from ..functions.wavefront import model_schema
from ..operators.forecast import forecast_rows

#: Groups of objects. A stream keeps their number for as long as it goes on from its checkpoint.
GROUPS = 2_048
#: Stands for a null id, which is an object of its own; ids are ints.
NO_ID = -(1 << 40)
NEVER = np.iinfo(np.int64).max

#: What is stored of the objects of a group, by rising id: numbers as bytes, ``ts`` and ``points`` object by object.
_FIELDS = {
    "ids": np.int64, "held": np.int64, "ts": np.int64, "points": np.float64, "w": np.float64, "a": np.float64,
    "i": np.int64, "segment": np.int64, "due": np.int64,
}
_STATE = ", ".join(f"{name} binary" for name in _FIELDS)
#: Points that wait for earlier ones, where a stream is put in time order.
_PENDING = "p_ids binary, p_ts binary, p_points binary"


class _Objects:
    """Objects of one group while its micro-batch is processed, by rising id: their last points (``held`` of each), their weights and
    counters, and when they are forgotten."""

    def __init__(self, cfg: ModelConfig, stored: tuple | None = None):
        self.cfg = cfg
        for (name, kind), value in zip(_FIELDS.items(), stored or [b""] * len(_FIELDS), strict=True):
            setattr(self, name, np.frombuffer(bytes(value), kind).copy())
        n, p = len(self.ids), cfg.train
        self.points, self.w = self.points.reshape(-1, 4), self.w.reshape(n, 4 * p)
        self.a = self.a.reshape(n, 4 * p * p if cfg.newton else 0)

    def stored(self) -> tuple:
        return tuple(getattr(self, name).tobytes() for name in _FIELDS)

    def of(self, which: np.ndarray) -> _Objects:
        out, rows = _Objects(self.cfg), np.repeat(which, self.held)
        for name in _FIELDS:
            setattr(out, name, getattr(self, name)[rows if name in ("ts", "points") else which])
        return out

    def merged(self, other: _Objects) -> _Objects:
        """These objects and others."""
        out, ids = _Objects(self.cfg), np.concatenate([self.ids, other.ids])
        order = np.argsort(ids, kind="stable")
        rows = np.argsort(np.repeat(ids, np.concatenate([self.held, other.held])), kind="stable")
        for name in _FIELDS:
            both = np.concatenate([getattr(self, name), getattr(other, name)])
            setattr(out, name, both[rows if name in ("ts", "points") else order])
        return out

    def told(self, ids: pd.Series) -> tuple[_Objects, _Objects]:
        """The objects of these ids, new ones too, and the others."""
        known, found = np.isin(self.ids, ids), _Objects(self.cfg)
        found.ids = np.setdiff1d(ids.to_numpy(np.int64), self.ids)
        n = len(found.ids)
        found.held, found.i, found.segment, found.due = (np.full(n, x) for x in (0, 0, -1, NEVER))
        found.w, found.a = np.zeros((n, self.w.shape[1])), np.zeros((n, self.a.shape[1]))
        return self.of(known).merged(found), self.of(~known)


class _Model:
    """Weights of the objects, with the segment that each one's are of."""

    def __init__(self, objects: _Objects):
        self.cfg, self.ids, self.segment = objects.cfg, objects.ids, objects.segment.copy()
        self.weights = recurrence.Weights(self.cfg)
        known = objects.segment >= 0
        self.weights.open(len(known), (known, objects.w[known]), (known, objects.a[known]) if self.cfg.newton else None)

    def open(self, at: np.ndarray, segment: np.ndarray) -> None:
        """Start weights of these segments, but for objects whose weights are of them already."""
        fresh = segment != self.segment[at]
        at, segment = at[fresh], segment[fresh]
        if not len(at):
            return
        start, w0 = recurrence.Weights(self.cfg), None
        if self.cfg.vector_init == "random":
            draws = [recurrence.random_weights(self.cfg, int(k), int(s)) for k, s in zip(self.ids[at], segment, strict=True)]
            w0 = (np.ones(len(at), dtype=bool), np.array(draws))
        start.open(len(at), w0)
        self.weights.w[:, at] = start.w
        if self.cfg.newton:
            self.weights.a[:, :, at] = start.a
        self.segment[at] = segment


@dataclass
class _Steps:
    """Steps of one micro-batch over the held and the new points, which lie object by object, in arrival order."""

    owner: np.ndarray  # the object of each step
    first: np.ndarray  # place of the oldest visible point of each step
    end: np.ndarray  # place after its newest one
    length: np.ndarray  # points of its fixed-step history; 0 where it cannot be sampled
    irregular: np.ndarray
    i: np.ndarray
    segment: np.ndarray
    begun: np.ndarray  # where the open segment begins among these points


def _sampled_lengths(ts: np.ndarray, first: np.ndarray, end: np.ndarray, cfg: ModelConfig) -> tuple[np.ndarray, np.ndarray]:
    """Number of points of each step's fixed-step history, and whether it has to be resampled."""
    off = np.cumsum(np.append(0, np.diff(ts) != cfg.sampling))
    irregular = off[end - 1] > off[first]
    count = end - first
    length = count.copy()
    for n in np.unique(count[irregular]):
        rows = np.flatnonzero(irregular & (count == n))
        seen = ts[first[rows, None] + np.arange(n)]
        in_order = np.sort(seen, axis=1)
        usable = (seen[:, -1] - seen[:, 0]) // cfg.sampling + 1 > cfg.window
        usable &= (np.diff(in_order) > 0).all(axis=1) & (n >= 3)
        length[rows] = np.where(usable, (in_order[:, -1] - in_order[:, 0]) // cfg.sampling + 1, 0)
    return length, irregular


def _per_point(objects: _Objects, ts: np.ndarray, owner: np.ndarray, new: np.ndarray) -> _Steps:
    """Steps of the stateful jobs: one per point; a gap starts the object afresh."""
    cfg, place, head = objects.cfg, np.arange(len(ts)), np.append(True, np.diff(owner) > 0)
    fresh = new & np.where(head, objects.held[owner] == 0, np.append(False, np.diff(ts) > cfg.gap_threshold))
    begun = np.maximum.accumulate(np.where(fresh | head, place, 0))[new]
    end, owner = place[new] + 1, owner[new]
    first = np.maximum(end - 1 - cfg.window, begun)
    length, irregular = _sampled_lengths(ts, first, end, cfg)
    # Running sums over the new points, less what they were before each object's first one or its open segment.
    grown = np.append(0, np.cumsum(1 + np.where(irregular, length, 0)))
    started = np.append(0, np.cumsum(fresh[new]))
    own = np.searchsorted(owner, owner)
    segments = started[1:] - started[own]
    since = np.where(segments == 0, own, (np.cumsum(new) - 1)[begun])
    i = np.where(segments == 0, objects.i[owner], 0) + grown[1:] - grown[since]
    return _Steps(owner, first, end, length, irregular, i, objects.segment[owner] + segments, begun)


def _per_batch(objects: _Objects, ts: np.ndarray, owner: np.ndarray, new: np.ndarray) -> _Steps:
    """Steps of the micro-batch jobs: all new points join the history at once; gaps do not matter."""
    every = np.arange(len(objects.ids))
    first, end = np.searchsorted(owner, every), np.searchsorted(owner, every, "right")
    length, irregular = _sampled_lengths(ts, first, end, objects.cfg)
    i = np.where(irregular & (length > 0), length, objects.i + 1)
    return _Steps(every, first, end, length, irregular, i, objects.segment + (objects.held == 0), first)


def _histories(ts: np.ndarray, points: np.ndarray, first: np.ndarray, end: np.ndarray) -> pa.ListArray:
    """The visible points of each step, each sorted by time."""
    count = end - first
    offsets = np.append(0, np.cumsum(count))
    row = np.repeat(np.arange(len(count)), count)
    place = first[row] + np.arange(len(row)) - offsets[row]
    place = place[np.lexsort((ts[place], row))]
    columns = [pa.array(ts[place]), *[pa.array(points[place, k]) for k in range(4)]]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, ["timestamp", *ATTRIBUTES]))


def _samples(ts: np.ndarray, points: np.ndarray, steps: _Steps, use: np.ndarray, cfg: ModelConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``sampled_levels`` of these steps. Those that see about as many points go together, as all are padded to the most."""
    first, end = steps.first[use], steps.end[use]
    levels, count, base_ts = np.empty((len(use), 4, cfg.window + 1)), np.empty(len(use), np.int64), np.empty(len(use), np.int64)
    width = np.ceil(np.log2(np.maximum(end - first, cfg.window + 1)))
    for size in np.unique(width):
        rows = np.flatnonzero(width == size)
        history = _histories(ts, points, first[rows], end[rows])
        levels[rows], count[rows], base_ts[rows] = sampled_levels(history, steps.irregular[use][rows], cfg.window, cfg.sampling)
    return levels, count, base_ts


def _advance(objects: _Objects, new: pd.DataFrame) -> pd.DataFrame | None:
    """Train on the points of one micro-batch, some of each object, by rising id; forecast arrays of its trainable steps.

    Only the weight recurrence goes step by step, for all objects together; histories, samples and forecasts are made at once.
    """
    cfg, every = objects.cfg, np.arange(len(objects.ids))
    owner = np.concatenate([np.repeat(every, objects.held), np.searchsorted(objects.ids, new["id"].to_numpy(np.int64))])
    order = np.argsort(owner, kind="stable")
    ts = np.concatenate([objects.ts, new["timestamp"].to_numpy(np.int64)])[order]
    points = np.concatenate([objects.points, new[list(ATTRIBUTES)].to_numpy(float)])[order]
    owner, arrived = owner[order], order >= len(objects.ts)
    steps = (_per_batch if cfg.motion == "derived" else _per_point)(objects, ts, owner, arrived)
    model = _Model(objects)
    use = np.flatnonzero(steps.length >= cfg.window)
    out = None
    if len(use):
        nth = np.arange(len(use)) - np.searchsorted(steps.owner[use], steps.owner[use])
        use = use[np.argsort(nth, kind="stable")]  # the first step of each object, then the second of each, ...
        rounds = np.append(0, np.cumsum(np.bincount(nth)))
        at, end, segment = steps.owner[use], steps.end[use], steps.segment[use]
        with np.errstate(all="ignore"):
            inputs = windows(*_samples(ts, points, steps, use, cfg), cfg.train, cfg.diff)
            series = recurrence.Series(inputs.values, steps.i[use], cfg.train)
            predicted = np.empty((cfg.window - cfg.train, len(use), 4))
            weights = np.empty((cfg.train, len(use), 4))
            for start, stop in zip(rounds[:-1], rounds[1:], strict=True):
                rows = slice(start, stop)
                model.open(at[rows], segment[rows])
                model.weights.learn(at[rows], series, rows, predicted)
                weights[:, rows] = model.weights.w[:, at[rows]]
            mean = (predicted - np.stack(series.targets)).cumsum(axis=0)[-1] / len(predicted)
            path = recurrence.forecasts(cfg, weights, inputs.values, inputs.levels, points[end - 1], mean)
        ids = objects.ids[at]
        ids = pd.arrays.IntegerArray(np.where(ids == NO_ID, 0, ids).astype(np.int32), ids == NO_ID)
        columns = [ids, segment, ts[end - 1], [0] * len(use), inputs.base_ts, *(list(path[:, k]) for k in range(4))]
        names = [c.split()[0] for c in model_schema("forecast", False).split(", ")]
        out = pd.DataFrame(dict(zip(names, columns, strict=True)))
    last, ends = np.searchsorted(steps.owner, every, "right") - 1, np.searchsorted(owner, every, "right")
    objects.i, objects.segment = steps.i[last], steps.segment[last]
    model.open(every, objects.segment)
    objects.w, a = model.weights.flat()
    objects.a = objects.a if a is None else a
    kept = np.maximum(steps.begun[last], ends - cfg.window)
    stay = np.arange(len(ts)) >= kept[owner]
    objects.ts, objects.points, objects.held = ts[stay], points[stay], ends - kept
    return out


def _not_late(objects: _Objects, new: pd.DataFrame) -> pd.DataFrame:
    """The new points that are not older than one of their object before them."""
    at = np.searchsorted(objects.ids, new["id"].to_numpy(np.int64))
    before, some = np.full(len(objects.ids), np.iinfo(np.int64).min), objects.held > 0
    before[some] = objects.ts[np.cumsum(objects.held)[some] - 1]
    latest = np.maximum(new.groupby("id")["timestamp"].cummax().to_numpy(), before[at])
    past = np.where(np.append(True, np.diff(at) > 0), before[at], np.append(0, latest[:-1]))
    return new[new["timestamp"].to_numpy() >= past]


def forecast_stream(
    points: DataFrame, cfg: ModelConfig, idle_timeout_ms: int | None = None, late: str = "keep", reorder_ms: int | None = None,
    groups: int = GROUPS,
) -> DataFrame:
    """Forecast rows of a point stream.

    Gradient jobs forget an object that was silent (in processing time) for ``idle_timeout_ms``, by default the gap
    threshold; 0 turns that off, which a drained replay (``availableNow``) needs: with a timeout there is always another
    batch to run. Newton and micro-batch jobs never forget. ``motion="derived"`` gives the micro-batch jobs, which take one
    step per object and micro-batch. ``late="drop"`` leaves out points older than the last one taken.

    ``reorder_ms``: take points in time order. A point is held until the watermark, that many ms behind the latest point of the
    stream, has passed it; one that comes after that is dropped. Points that are late by less give what the batch job gives. What
    is held is taken when the watermark passes it, whether the object sends more or not; objects are never forgotten.

    ``groups``: objects are stored and processed in so many groups. It changes no results, but must not change between runs from
    one checkpoint.
    """
    if late not in ("keep", "drop"):
        raise ValueError("late is 'keep' or 'drop'")
    by = "seq" if "seq" in points.columns else "timestamp"
    if cfg.order == "arrival" and by != "seq":
        raise ValueError("order='arrival' needs a `seq` column that numbers the arrivals")
    keep_idle = cfg.newton or cfg.motion == "derived" or idle_timeout_ms == 0
    wait = cfg.gap_threshold if idle_timeout_ms is None else idle_timeout_ms

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        objects = _Objects(cfg, state.get if state.exists else None)
        if state.hasTimedOut:
            objects = objects.of(objects.due >= now)
        else:
            new = pd.concat(list(batches)).sort_values(["id", by], kind="stable")
            active, others = objects.told(new["id"])
            if late == "drop":
                new = _not_late(active, new)
            taking, waiting = active.told(new["id"])
            if len(new):
                out = _advance(taking, new)
                if out is not None:
                    yield out
            active = taking.merged(waiting)
            active.due = np.full(len(active.ids), NEVER if keep_idle else now + wait)
            objects = active.merged(others.of(others.due >= now))
        if not len(objects.ids):
            state.remove()
            return
        state.update(objects.stored())
        if not keep_idle:
            state.setTimeoutDuration(max(1, int(objects.due.min()) - now))

    if reorder_ms is not None:
        if cfg.motion == "derived":
            raise ValueError("micro-batch jobs take points as they come")
        return _rows(_in_time_order(points, cfg, reorder_ms, by, groups), cfg)

    timeout = GroupStateTimeout.NoTimeout if keep_idle else GroupStateTimeout.ProcessingTimeTimeout
    runs = (
        points.select(*_columns(by, groups))
        .groupBy("group")
        .applyInPandasWithState(update, model_schema("forecast", False), _STATE, "append", timeout)
    )
    return _rows(runs, cfg)


def _columns(by: str, groups: int) -> list:
    """What the stateful operator reads of a point, and the group of its object."""
    id_, group = F.col("id").cast("int"), F.pmod(F.xxhash64(F.col("id").cast("int")), F.lit(groups)).cast("int")
    return [F.coalesce(id_.cast("long"), F.lit(NO_ID)).alias("id"), group.alias("group"), "timestamp", *ATTRIBUTES, *(["seq"] if by == "seq" else [])]


def _rows(runs: DataFrame, cfg: ModelConfig) -> DataFrame:
    """Forecast rows. pandas hands NaN on as null; a forecast that is not a number is flagged."""
    whole = {a: F.coalesce(a, F.lit(float("nan"))) for a in ATTRIBUTES} | {"error": F.coalesce("error", F.lit(True))}
    return forecast_rows(runs, [cfg]).withColumns(whole)


def _in_time_order(points: DataFrame, cfg: ModelConfig, reorder_ms: int, by: str, groups: int) -> DataFrame:
    """Forecast arrays of a stream whose points are held until the watermark has passed them."""
    names = ["id", "timestamp", *ATTRIBUTES]
    order = list(dict.fromkeys(["id", "timestamp", by]))

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        fields = len(_FIELDS)
        objects = _Objects(cfg, None if held is None else held[:fields])
        ids, ts, rows = (np.frombuffer(bytes(x), kind) for x, kind in zip([b""] * 3 if held is None else held[fields:], (np.int64, np.int64, float), strict=True))
        pending = pd.DataFrame({"id": ids, "timestamp": ts, **dict(zip(ATTRIBUTES, rows.reshape(-1, 4).T, strict=True))})
        arrived = [b for b in batches if len(b)]
        if arrived:
            new = pd.concat(arrived).sort_values(order, kind="stable")[names]
            pending = pd.concat([pending, new]) if len(pending) else new
        waiting = pending.sort_values(["id", "timestamp"], kind="stable")
        passed = waiting["timestamp"] <= state.getCurrentWatermarkMs()
        now, later = waiting[passed], waiting[~passed]
        if len(now):
            active, others = objects.told(now["id"])
            out = _advance(active, now)
            objects = active.merged(others)
            if out is not None:
                yield out
        columns = (later["id"].astype("int64"), later["timestamp"].astype("int64"), later[list(ATTRIBUTES)].astype(float))
        state.update((*objects.stored(), *(np.ascontiguousarray(c.to_numpy()).tobytes() for c in columns)))
        if len(later):
            state.setTimeoutTimestamp(int(later["timestamp"].min()))

    timed = points.select(*_columns(by, groups), F.timestamp_millis("timestamp").alias("event_time"))
    return (
        timed.withWatermark("event_time", f"{reorder_ms} milliseconds")
        .groupBy("group")
        .applyInPandasWithState(update, model_schema("forecast", False), f"{_STATE}, {_PENDING}", "append", GroupStateTimeout.EventTimeTimeout)
    )
