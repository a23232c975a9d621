"""Segments, legs and resampling, cold and chunked."""

import math
import random

import numpy as np
import pytest
from brute import resampled

from movecast.functions.sampling import spline_values
from movecast.operators.legs import track_legs
from movecast.operators.resample import resample, tridiagonal
from movecast.operators.tracks import track_diff, track_parts, track_positions, track_segments

POINT = "id int, timestamp bigint, longitude double, latitude double, speed double, heading double, seq bigint"
T0 = 1_700_000_000_000


def made(spark, rows):
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], POINT)


def jittered(seed=0, tracks=3, n=60, gap_every=25):
    rnd, rows = random.Random(seed), []
    for key in range(tracks):
        ts = T0
        for k in range(n):
            rows.append((key, ts, rnd.uniform(-180, 180), rnd.uniform(-80, 80), rnd.random(), rnd.random()))
            ts += rnd.randint(1, 9000) + (100_000 if k % gap_every == gap_every - 1 else 0)
    return rows


def collected(df):
    return sorted(tuple(round(v, 7) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_chunks_hold_consecutive_points(spark):
    points = made(spark, jittered(tracks=2, n=100) + jittered(tracks=5, n=10)[20:])
    cold, hot = track_parts(points, hot_rows=50, chunk_rows=16)
    assert {r.id for r in cold.df.select("id").distinct().collect()} == {2, 3, 4}
    rows = hot.df.orderBy("id", "timestamp", "seq").select("id", "chunk").collect()
    assert [tuple(r) for r in rows] == sorted(map(tuple, rows))
    sizes = hot.df.groupBy("id", "chunk").count().collect()
    assert max(r["count"] for r in sizes) <= 16 and sum(r["count"] for r in sizes) == 200


def test_points_are_not_told_apart_where_all_tracks_are_hot(spark):
    cold, hot = track_parts(made(spark, jittered(tracks=2, n=100)), hot_rows=50, chunk_rows=16)
    assert "LocalRelation" in cold.df._jdf.queryExecution().optimizedPlan().toString()
    assert (cold.df.count(), hot.df.count()) == (0, 200)


def test_one_object_of_equal_points_is_split(spark):
    points = made(spark, [(1, T0, 1.0, 1.0, 1.0, 1.0)] * 500).drop("seq").repartition(4)
    (_, hot) = track_parts(points, hot_rows=100, chunk_rows=32)
    assert max(r["count"] for r in hot.df.groupBy("chunk").count().collect()) <= 32
    assert hot.df.count() == 500
    assert collected(track_positions(points, hot_rows=100, chunk_rows=32).select("pos")) == [(k,) for k in range(1, 501)]


@pytest.mark.parametrize("layout", [{}, {"hot_rows": 10, "chunk_rows": 4}])
def test_segments_and_differences(spark, layout):
    rows = jittered(seed=3)
    gap, want, diffs, last = 50_000, [], [], {}
    for r in rows:
        key, ts = r[0], r[1]
        before, segment = last.get(key, (None, 0))
        fresh = before is None or ts - before[1] > gap
        segment += int(before is not None and fresh)
        want.append((key, ts, segment))
        base = (0, 0, r[2], r[3], 0.0, 0.0) if fresh else before
        diffs.append((key, ts, segment, *[round(a - b, 7) for a, b in zip(r[2:], base[2:], strict=True)]))
        last[key] = (r, segment)
    points = made(spark, rows)
    assert collected(track_segments(points, gap, **layout).select("id", "timestamp", "segment")) == sorted(want)
    assert collected(track_diff(points, gap, **layout)) == sorted(diffs)


@pytest.mark.parametrize("layout", [{}, {"hot_rows": 10, "chunk_rows": 8}])
def test_resample_equals_dense_solve(spark, layout):
    rows = jittered(seed=5)
    rows += [(8, T0 + k, 1.0, 1.0, 0.0, 0.0) for k in (0, 5000, 5000, 9000)]  # repeated time: nothing
    rows += [(9, T0, 1.0, 1.0, 0.0, 0.0), (9, T0 + 9000, 2.0, 2.0, 0.0, 0.0)]  # two points: nothing
    points = made(spark, rows)
    segments = {}
    for r in track_segments(points, 50_000).orderBy("timestamp", "seq").collect():
        segments.setdefault((r.id, r.segment), []).append((r.timestamp, r.longitude, r.latitude, 0.0, 0.0))
    want = {(*k, p[0]): p[1:] for k, pts in segments.items() for p in resampled(pts, 1500)}
    got = {(r.id, r.segment, r.timestamp): (r.longitude, r.latitude, r.speed, r.heading) for r in resample(points, 1500, 50_000, **layout).collect()}
    assert got.keys() == want.keys() and {k[0] for k in got} == {0, 1, 2}
    for k in got:
        assert all(math.isclose(a, b, rel_tol=1e-8, abs_tol=1e-6) for a, b in zip(got[k], want[k], strict=True))


def test_long_segment_over_many_small_chunks(spark):
    points = made(spark, jittered(seed=6, tracks=1, n=900, gap_every=10_000))
    want = collected(resample(points, 2500, 50_000))
    assert collected(resample(points, 2500, 50_000, hot_rows=100, chunk_rows=16)) == want


@pytest.mark.parametrize("chunk", [1, 2, 4, 64])
def test_hot_segment_with_uneven_steps_is_exact(spark, chunk):
    """Steps that differ by a factor of a million, chunks of single knots, a last chunk of one knot."""
    rnd, rows, ts = random.Random(chunk), [], T0
    for k in range(129):
        rows.append((1, ts, rnd.uniform(-1, 1), rnd.uniform(-1, 1), 0.0, 0.0))
        ts += rnd.choice((1, 1_000, 1_000_000))
    rows += [(2, T0 + 1000 * k, 1.0, 2.0, 0.0, 0.0) for k in range(2)] + [(3, T0 + 5 * k, 1.0 * k * k, 2.0, 0.0, 0.0) for k in range(3)]
    points = made(spark, rows)
    want = {}
    for key in (1, 3):
        knots = [(r[1], r[2], r[3], 0.0, 0.0) for r in rows if r[0] == key]
        want |= {(key, p[0]): p[1:3] for p in resampled(knots, 250_000)}
    got = {(r.id, r.timestamp): (r.longitude, r.latitude) for r in resample(points, 250_000, 10**9, hot_rows=1, chunk_rows=chunk).collect()}
    cold = {(r.id, r.timestamp): (r.longitude, r.latitude) for r in resample(points, 250_000, 10**9).collect()}
    assert got.keys() == cold.keys() and len(got) > 100
    for k, v in got.items():
        assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) for a, b in zip(v, cold[k], strict=True))
    assert got.keys() == want.keys()
    for k, v in got.items():
        assert all(math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-6) for a, b in zip(v, want[k], strict=True))


def test_tridiagonal_systems_of_all_sizes():
    rng = np.random.default_rng(1)
    size = np.array([0, 1, 2, 5, 0, 40, 3])
    begin = np.cumsum(size) - size
    n = int(size.sum())
    lower, upper = rng.uniform(0, 1e6, n), rng.uniform(0, 1, n)
    diag, rhs = 2 * (lower + upper), rng.normal(size=(2, n))
    got = tridiagonal(lower, diag, upper, rhs, begin, size)
    for b, m in zip(begin, size, strict=True):
        if m:
            at = slice(b, b + m)
            full = np.diag(diag[at]) + np.diag(lower[at][1:], -1) + np.diag(upper[at][:-1], 1)
            assert np.allclose(got[:, at].T, np.linalg.solve(full, rhs[:, at].T), rtol=1e-10, atol=1e-18)


def test_spline_equals_library(spark):
    """commons-math ships with Spark."""
    x = [0.0, 1.0, 3.0, 4.0]
    y = [0.0, 1.0, 0.0, 2.0]
    at = np.array([[0.5, 2.0, 3.5]])
    got = spline_values(np.array([x]), np.array([[y]]), at)[0, 0]
    assert np.allclose(got, [0.6640625, 0.3125, 0.7890625], atol=1e-15)
    rnd = random.Random(1)
    jvm = spark._jvm
    for n in (3, 4, 5, 9):
        x = np.cumsum([rnd.uniform(0.5, 20) for _ in range(n)]) - 0.5
        y = [rnd.uniform(-50, 50) for _ in range(n)]
        gateway = spark.sparkContext._gateway
        xs, ys = gateway.new_array(jvm.double, n), gateway.new_array(jvm.double, n)
        for k in range(n):
            xs[k], ys[k] = float(x[k]), y[k]
        f = jvm.org.apache.commons.math3.analysis.interpolation.SplineInterpolator().interpolate(xs, ys)
        at = np.linspace(x[0], x[-1], 17)
        got = spline_values(x[None], np.array([[y]]), at[None])[0, 0]
        assert np.allclose(got, [f.value(float(v)) for v in at], rtol=0, atol=1e-10)


@pytest.mark.parametrize("layout", [{}, {"hot_rows": 10, "chunk_rows": 4}])
def test_legs(spark, layout):
    rows = [(1, T0, 0.0, 0.0, 0.0, 0.0), (1, T0 + 3_600_000, 0.0, 1.0, 0.0, 0.0), (1, T0 + 3_600_000, 1.0, 1.0, 0.0, 0.0)]
    rows += [(2, T0 + k * 1000, k * 0.1, 0.0, 0.0, 0.0) for k in range(30)]
    legs = track_legs(made(spark, rows), **layout).where("id = 1").orderBy("distance_units", "bearing_deg").collect()
    north, east = (legs[0], legs[1]) if legs[0].bearing_deg < 45 else (legs[1], legs[0])
    degree = math.pi / 180 * 6371000
    assert math.isclose(north.distance_m, degree, rel_tol=1e-12) and north.bearing_deg == 0.0
    assert math.isclose(north.speed_knots, degree / 1852, rel_tol=1e-12)
    assert east.speed_knots == -1.0 and 89 < east.bearing_deg < 91 and east.distance_units == 1.0
    west = track_legs(made(spark, [(1, T0, 1.0, 0.0, 0.0, 0.0), (1, T0 + 1, 0.0, 0.0, 0.0, 0.0)])).first()
    assert math.isclose(west.bearing_deg, 270.0)
