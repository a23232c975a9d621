"""Resampling of whole segments to a fixed step with natural cubic splines.

Spline coefficients of many segments are solved together in Arrow tasks; the grid itself is laid out by Spark, one knot at a
time, so a sparse segment with a long grid never sits in one task. Segments of hot tracks are solved chunk by chunk, and
exactly: the coefficients inside a chunk are linear in the two at its bounds, so each chunk reduces to its part of two boundary
equations (one small row per chunk), the tridiagonal system over the chunks of a segment gives the coefficients at the bounds, and all
chunks are filled in from those.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ModelConfig
from .tracks import CHUNK_ROWS, Part, durable, event_parts, union_parts

BLOCK = 1 << 18  # knots that a task solves together
HOT_KNOTS = 1 << 15  # a longer track is solved by chunks, as a sweep along one spline alone is slow

_KNOTS = (
    "id int, segment bigint, timestamp bigint, next_ts bigint, "
    "lon_a double, lon_b double, lon_c double, lon_d double, lat_a double, lat_b double, lat_c double, lat_d double, "
    "first_ts bigint, last_ts bigint, last_lon double, last_lat double"
)


def tridiagonal(lower, diag, upper, rhs, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Solve diagonally dominant systems that lie one after the other in flat arrays; ``rhs`` is (axes, places).

    System s has its equations at begin[s] to begin[s] + size[s] - 1. One numpy step moves all systems that are long enough on by
    one equation. Other places of the result are zero.
    """
    factor, load, out = np.zeros(diag.shape), np.zeros(rhs.shape), np.zeros(rhs.shape)
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    most = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(most + 1), "left")  # systems with more than k equations
    for k in range(most):
        at = begin[: live[k]] + k
        pivot, value = diag[at], rhs[:, at]
        if k:
            pivot, value = pivot - lower[at] * factor[at - 1], value - lower[at] * load[:, at - 1]
        factor[at], load[:, at] = upper[at] / pivot, value / pivot
    for k in range(most - 1, -1, -1):
        at = begin[: live[k]] + k
        out[:, at] = load[:, at]
        if k < most - 1:
            at = begin[: live[k + 1]] + k
            out[:, at] -= factor[at] * out[:, at + 1]
    return out


def _equations(step: np.ndarray, slope: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower and main diagonal and right side of the equation of each knot; the upper diagonal is the step after it."""
    lower = np.concatenate([[0.0], step[:-1]])
    return lower, 2.0 * (lower + step), 3.0 * (slope - np.concatenate([slope[:, :1], slope[:, :-1]], axis=1))


def _sweep(step: np.ndarray, slope: np.ndarray, begin: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """Second-order coefficients of natural splines that lie one after the other.

    Knots of spline s stand at begin[s] to begin[s] + knots[s] - 1; ``step`` and ``slope`` (axes, knots) belong to the interval
    that starts at a knot.
    """
    lower, diag, rhs = _equations(step, slope)
    return tridiagonal(lower, diag, step, rhs, begin + 1, np.maximum(knots - 2, 0))


def _by_groups(keys: tuple[str, ...], work: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task over rows sorted by the keys: ``work`` of whole groups, about ``BLOCK`` rows or one group at a time."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= BLOCK:
                table = pa.Table.from_batches(held).combine_chunks()
                last = int(_groups(table, keys)[-1])
                if last:
                    yield from work(table.slice(0, last), keys)
                held, size = table.slice(last).to_batches(), table.num_rows - last
        if size:
            yield from work(pa.Table.from_batches(held).combine_chunks(), keys)

    return solve


def _groups(table: pa.Table, keys: tuple[str, ...]) -> np.ndarray:
    """Where each group of a sorted table begins."""
    new = np.ones(table.num_rows, bool)
    new[1:] = np.any([np.diff(table[k].to_numpy()) != 0 for k in keys], axis=0)
    return np.flatnonzero(new)


def _intervals(table: pa.Table, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Times, values (axes, knots), the place after each knot, and step and slope of the interval that starts at it (1 and 0 where
    none does)."""
    ts = table["timestamp"].to_numpy()
    y = np.stack([table[n].to_numpy() for n in ("longitude", "latitude")])
    after = np.minimum(np.arange(len(ts)) + 1, len(ts) - 1)
    step = np.where(inner, ts[after] - ts, 1).astype(float)
    return ts, y, after, step, np.where(inner, (y[:, after] - y) / step, 0.0)


def _pieces(table: pa.Table, inner: np.ndarray, c: np.ndarray) -> dict:
    """Cubic pieces of the knots from their second-order coefficients; a last knot has only its value."""
    ts, y, after, step, slope = _intervals(table, inner)
    b = np.where(inner, slope - step * (c[:, after] + 2.0 * c) / 3.0, 0.0)
    d = np.where(inner, (c[:, after] - c) / (3.0 * step), 0.0)
    out = {n: table[n].to_numpy() for n in ("id", "segment", "timestamp")} | {"next_ts": np.where(inner, ts[after], ts)}
    for k, name in enumerate(("lon", "lat")):
        out |= {f"{name}_a": y[k], f"{name}_b": b[k], f"{name}_c": c[k], f"{name}_d": d[k]}
    return out


def _solve(table: pa.Table, keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Pieces of whole segments, with their first and last knot."""
    begin = _groups(table, keys)
    knots = np.diff(np.append(begin, table.num_rows))
    ts = table["timestamp"].to_numpy()
    ahead = np.append(np.diff(ts), 0)
    ahead[begin + knots - 1] = 1  # no interval starts at a last knot
    good = (knots >= 3) & (np.minimum.reduceat(ahead, begin) > 0)
    if not good.all():
        table = table.filter(pa.array(np.repeat(good, knots))).combine_chunks()
        if not table.num_rows:
            return
        begin, knots = _groups(table, keys), knots[good]
    end = begin + knots - 1
    inner = np.ones(table.num_rows, bool)
    inner[end] = False
    ts, y, _, step, slope = _intervals(table, inner)
    out = _pieces(table, inner, _sweep(step, slope, begin, knots))
    ends = {"first_ts": ts[begin], "last_ts": ts[end], "last_lon": y[0, end], "last_lat": y[1, end]}
    out |= {k: np.repeat(v, knots) for k, v in ends.items()}
    yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in out.items()})


# --- hot segments, chunk by chunk

_CHUNK = ("id", "segment", "chunk")
_BOUNDS = "id int, segment bigint, chunk bigint, " + ", ".join(
    f"{side}_{part} double" for side in ("own", "next") for part in ("own", "next", "lon", "lat")
)
_SYSTEM = "id int, segment bigint, chunk bigint, lower double, diag double, upper double, lon double, lat double"
_AT_BOUNDS = "id int, segment bigint, chunk bigint, c_lon double, c_lat double"


def _laid_out(table: pa.Table, keys: tuple[str, ...]):
    """Chunks of a table: where they begin, their last place (the first knot of the next chunk, or the last of the segment), and where
    intervals start."""
    begin = _groups(table, keys)
    end = np.append(begin[1:], table.num_rows) - 1
    inner = np.ones(table.num_rows, bool)
    inner[end] = False
    return begin, end, inner


def _reduce(table: pa.Table, keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Each chunk's part of the equations at its own first knot (``own_*``) and at that of the next chunk (``next_*``): the factors of
    the coefficients at both, and what it adds to the right sides."""
    begin, end, inner = _laid_out(table, keys)
    _, _, _, step, slope = _intervals(table, inner)
    lower, diag, rhs = _equations(step, slope)
    size = end - begin - 1
    some = size > 0
    # Inside a chunk: the values for bounds of zero (two axes), and what one unit at either bound adds.
    right = np.concatenate([rhs, np.zeros((2, table.num_rows))])
    right[2, begin[some] + 1] = -step[begin[some]]
    right[3, end[some] - 1] = -step[end[some] - 1]
    inside = tridiagonal(lower, diag, step, right, begin + 1, np.maximum(size, 0))
    lon, lat, left, after = inside
    first, last = np.minimum(begin + 1, end), np.maximum(end - 1, begin)
    a, z = step[begin], step[last]
    alone = end == begin  # the last knot of a segment, by itself: no interval, no equation
    out = {
        "own_own": 2 * a + np.where(some, a * left[first], 0.0),
        "own_next": np.where(some, a * after[first], a),
        "own_lon": 3 * slope[0, begin] - np.where(some, a * lon[first], 0.0),
        "own_lat": 3 * slope[1, begin] - np.where(some, a * lat[first], 0.0),
        "next_own": np.where(some, z * left[last], z),
        "next_next": 2 * z + np.where(some, z * after[last], 0.0),
        "next_lon": -3 * slope[0, last] - np.where(some, z * lon[last], 0.0),
        "next_lat": -3 * slope[1, last] - np.where(some, z * lat[last], 0.0),
    }
    known = {k: table[k].take(pa.array(begin)) for k in _CHUNK}
    columns = [*known.values(), *(pa.chunked_array([pa.array(v, mask=alone)]) for v in out.values())]
    yield from pa.Table.from_arrays(columns, names=[*known, *out]).combine_chunks().to_batches()


def _system(bounds: DataFrame) -> DataFrame:
    """One equation for each chunk bound within a segment. The coefficients at both ends of a segment are zero."""
    along = Window.partitionBy("id", "segment").orderBy("chunk")
    before = {c: F.lag(f"next_{c}").over(along) for c in ("own", "next", "lon", "lat")}
    rows = bounds.withColumns({f"b_{c}": v for c, v in before.items()})
    # The first chunk starts with the first knot, and a chunk without an interval is the last knot: nothing to solve there.
    rows = rows.where(F.col("b_own").isNotNull() & F.col("own_own").isNotNull())
    return rows.select(
        *_CHUNK, F.col("b_own").alias("lower"), (F.col("b_next") + F.col("own_own")).alias("diag"), F.col("own_next").alias("upper"),
        *[(F.col(f"b_{c}") + F.col(f"own_{c}")).alias(c) for c in ("lon", "lat")],
    )


def _solve_bounds(table: pa.Table, keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    begin = _groups(table, keys)
    size = np.diff(np.append(begin, table.num_rows))
    lower, diag, upper, lon, lat = (table[c].to_numpy() for c in ("lower", "diag", "upper", "lon", "lat"))
    lon, lat = tridiagonal(lower, diag, upper, np.stack([lon, lat]), begin, size)
    known = [table[k] for k in _CHUNK]
    whole = pa.Table.from_arrays([*known, pa.chunked_array([lon]), pa.chunked_array([lat])], names=[*_CHUNK, "c_lon", "c_lat"])
    yield from whole.combine_chunks().to_batches()


def _fill(table: pa.Table, keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Pieces of the chunks' own knots from the coefficients at both bounds."""
    begin, end, inner = _laid_out(table, keys)
    _, _, _, step, slope = _intervals(table, inner)
    lower, diag, rhs = _equations(step, slope)
    bounds = {e: np.stack([table[f"{e}_{a}"].to_numpy()[begin] for a in ("lon", "lat")]) for e in ("own", "next")}
    size = end - begin - 1
    some = size > 0
    rhs[:, begin[some] + 1] -= step[begin[some]] * bounds["own"][:, some]
    rhs[:, end[some] - 1] -= step[end[some] - 1] * bounds["next"][:, some]
    c = tridiagonal(lower, diag, step, rhs, begin + 1, np.maximum(size, 0))
    c[:, end] = bounds["next"]
    c[:, begin] = bounds["own"]
    out = _pieces(table, inner, c)
    own = table["own"].combine_chunks()
    whole = pa.Table.from_pydict({k: pa.array(v) for k, v in out.items()})
    yield from whole.filter(own).combine_chunks().to_batches()


def _chunked_pieces(part: Part) -> DataFrame:
    """Pieces of hot segments. ``part``: knots with segment, chunk and ``again``."""
    ends = durable(_ends(part))
    keep = ["id", "segment", "timestamp", "longitude", "latitude"]
    knots = part.df.select(*keep, "chunk").join(ends.select("id", "segment"), ["id", "segment"], "left_semi")
    knot = F.struct(*keep[2:])
    firsts = knots.groupBy(*_CHUNK).agg(F.min_by(knot, "timestamp").alias("k"))
    along = Window.partitionBy("id", "segment").orderBy("chunk")
    # Each chunk also gets the first knot of the next one.
    ahead = firsts.withColumn("chunk", F.lag("chunk").over(along)).where("chunk is not null")
    copies = ahead.select("id", "segment", "k.*", "chunk", F.lit(False).alias("own"))
    laid = durable(knots.withColumn("own", F.lit(True)).unionByName(copies).repartition(*_CHUNK))

    def grouped(df: DataFrame, work: Callable, keys: tuple[str, ...], by: tuple[str, ...], schema: str) -> DataFrame:
        return df.repartition(*keys).sortWithinPartitions(*by).mapInArrow(_by_groups(keys, work), schema)

    bounds = durable(grouped(laid, _reduce, _CHUNK, (*_CHUNK, "timestamp"), _BOUNDS))
    solved = grouped(_system(bounds), _solve_bounds, ("id", "segment"), _CHUNK, _AT_BOUNDS)
    zero = F.lit(0.0)
    given = bounds.select(*_CHUNK).join(solved, list(_CHUNK), "left")
    given = given.select(*_CHUNK, *[F.coalesce(f"c_{a}", zero).alias(f"own_{a}") for a in ("lon", "lat")])
    after = {f"next_{a}": F.coalesce(F.lead(f"own_{a}").over(along), zero) for a in ("lon", "lat")}
    given = durable(given.withColumns(after))
    schema = _KNOTS[: _KNOTS.index(", first_ts")]
    pieces = grouped(laid.join(given, list(_CHUNK)), _fill, _CHUNK, (*_CHUNK, "timestamp"), schema)
    return pieces.join(ends, ["id", "segment"])


def resample(
    points: DataFrame, step: int, gap: int, hot_rows: int = HOT_KNOTS, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Points of each segment on the grid ``first + k * step``: spline positions, speed = heading = 0.

    The last grid point carries the last true position. Segments with fewer than three points or with a repeated time
    cannot be interpolated and give no rows.
    """
    cfg = ModelConfig(gap_threshold=gap, window=3, train=2)
    frames = []
    for part in event_parts(points, cfg, hot_rows=hot_rows, chunk_rows=chunk_rows):
        extra = [c for c in (*part.order, *part.keys) if c not in ("id", "timestamp", "longitude", "latitude")]
        part = part.with_df(
            part.df.select(
                "id",
                F.col("segment").cast("bigint").alias("segment"),
                "timestamp",
                "longitude",
                "latitude",
                *extra,
                F.coalesce(F.col("prior.timestamp") == F.col("timestamp"), F.lit(False)).alias("again"),
            )
        )
        if not part.chunked:
            knots = part.df.drop("again", *extra)
            # Still hashed by id from the windows, so this sort needs no exchange.
            pieces = knots.sortWithinPartitions("id", "segment", "timestamp").mapInArrow(_by_groups(("id", "segment"), _solve), _KNOTS)
        else:
            pieces = _chunked_pieces(part)
        frames.append(_grid(pieces, step))
    return union_parts(frames)


def _ends(part: Part) -> DataFrame:
    """First and last knot of every segment that can be interpolated."""
    last = F.max_by(F.struct("longitude", "latitude"), "timestamp")
    facts = part.df.groupBy("id", "segment").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("again").alias("again"),
        F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"),
        last.alias("last"),
    )
    return facts.where((F.col("n") >= 3) & ~F.col("again")).select(
        "id",
        "segment",
        "first_ts",
        "last_ts",
        F.col("last.longitude").alias("last_lon"),
        F.col("last.latitude").alias("last_lat"),
    )


def _grid(pieces: DataFrame, step: int) -> DataFrame:
    since, s = F.col("timestamp") - F.col("first_ts"), F.lit(step)
    first = F.ceil(since / F.lit(float(step))).cast("bigint")
    until = F.when(
        F.col("timestamp") == F.col("last_ts"), F.floor(since / F.lit(float(step)))
    ).otherwise(F.floor((F.col("next_ts") - F.col("first_ts") - 1) / F.lit(float(step)))).cast("bigint")
    rows = pieces.where(first <= until).withColumn("k", F.explode(F.sequence(first, until)))
    at = F.col("first_ts") + F.col("k") * s
    dx = (at - F.col("timestamp")).cast("double")
    final = F.col("k") == F.floor((F.col("last_ts") - F.col("first_ts")) / F.lit(float(step)))

    def value(axis: str, name: str):
        a, b, c, d = (F.col(f"{axis}_{p}") for p in "abcd")
        return F.when(final, F.col(f"last_{axis}")).otherwise(a + dx * (b + dx * (c + dx * d))).alias(name)

    return rows.select(
        "id",
        "segment",
        at.alias("timestamp"),
        value("lon", "longitude"),
        value("lat", "latitude"),
        F.lit(0.0).alias("speed"),
        F.lit(0.0).alias("heading"),
    )
