"""Streams give what the batch jobs give."""

import os
import random
import time

import pytest
from brute import forecasts
from test_models import KEYS, POINT, T0, assert_same, edge_rows, run, walk

from movecast.config import ModelConfig
from movecast.operators.tracks import scratch_path
from movecast.schema import FORECAST_COLUMNS
from movecast.sources.points import stream_points_csv
from movecast.sources.sinks import stream_batches_to, stream_forecasts_to
from movecast.streaming.forecast_stream import forecast_stream


def put(folder, name, rows, start=0):
    folder.mkdir(exist_ok=True)
    part = folder / f".{name}"
    lines = ["id,timestamp,longitude,latitude,speed,heading,seq"]
    lines += [",".join(map(repr, r)) + f",{start + k}" for k, r in enumerate(rows)]
    part.write_text("\n".join(lines) + "\n")
    part.rename(folder / name)


def drain(spark, folder, cfg, out, state, **options):
    stream = spark.readStream.schema(POINT).option("header", True).option("maxFilesPerTrigger", 1).csv(str(folder))
    query = stream_forecasts_to(forecast_stream(stream, cfg, **options), out, state, trigger=None)
    assert query.awaitTermination(120)


def stored(spark, out):
    return [tuple(r) for r in spark.read.parquet(out).select(*FORECAST_COLUMNS).select(*KEYS).collect()]


@pytest.mark.parametrize("variant", ["arma_gd", "corr_arima_ns"])
@pytest.mark.parametrize("pieces", [1, 3])
def test_stream_equals_batch(spark, tmp_path, variant, pieces):
    rows = walk(seed=2, tracks=2, n=40)
    random.Random(0).shuffle(rows)
    rows.sort(key=lambda r: r[1])
    rows += [(9, *r[1:]) for r in edge_rows() if r[0] == 1]
    cfg = ModelConfig(variant=variant, horizon=2, lrate=1e-6)
    size = -(-len(rows) // pieces)
    for k in range(pieces):
        put(tmp_path / "in", f"{k}.csv", rows[k * size : (k + 1) * size], k * size)
        time.sleep(1.1)  # files are taken by modification time
    out, state = scratch_path(spark, "out"), scratch_path(spark, "state")
    drain(spark, tmp_path / "in", cfg, out, state, idle_timeout_ms=0)
    assert_same(stored(spark, out), forecasts(rows, cfg))


def test_restart_continues_from_the_checkpoint(spark, tmp_path):
    rows = [r for r in walk(seed=3, tracks=1, n=30)]
    cfg = ModelConfig(variant="arima_gd", horizon=1, lrate=1e-6, vector_init="random", seed=5)
    out, state = scratch_path(spark, "out"), scratch_path(spark, "state")
    put(tmp_path / "in", "0.csv", rows[:13])
    drain(spark, tmp_path / "in", cfg, out, state, idle_timeout_ms=0)
    first = len(stored(spark, out))
    put(tmp_path / "in", "1.csv", rows[13:], 13)
    drain(spark, tmp_path / "in", cfg, out, state, idle_timeout_ms=0)
    points = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], POINT)
    got = stored(spark, out)
    assert 0 < first < len(got)
    assert_same(got, run(points, cfg))


def test_idle_objects_are_forgotten(spark, tmp_path):
    rows = [(1, T0 + 4000 * k, 1.0 + k, 2.0, 3.0, 4.0) for k in range(9)]
    cfg = ModelConfig(variant="arma_gd", horizon=2)
    put(tmp_path / "in", "0.csv", rows[:6])
    stream = spark.readStream.schema(POINT).option("header", True).csv(str(tmp_path / "in"))
    out, state = scratch_path(spark, "out"), scratch_path(spark, "state")
    query = stream_forecasts_to(forecast_stream(stream, cfg, idle_timeout_ms=500), out, state, "200 milliseconds")
    try:
        deadline = time.time() + 60
        while time.time() < deadline and query.lastProgress is None:
            time.sleep(0.2)
        time.sleep(6)
        before = len(stored(spark, out))
        put(tmp_path / "in", "1.csv", rows[6:], 6)
        time.sleep(6)
    finally:
        query.stop()
    assert before == 3  # the 4th to 6th point; the first step is not kept by this job
    assert len(stored(spark, out)) == before  # three points after the reset are too few to forecast


def test_late_points_can_be_dropped(spark, tmp_path):
    rows = [(1, T0 + 4000 * k, 1.0 + k, 2.0, 3.0, 4.0) for k in range(12)]
    late = rows[:7] + [(1, T0 + 8000, 7.0, 7.0, 7.0, 7.0)] + rows[7:]
    cfg = ModelConfig(variant="arma_ns", horizon=1, order="arrival")
    put(tmp_path / "in", "0.csv", late)
    out, state = scratch_path(spark, "out"), scratch_path(spark, "state")
    drain(spark, tmp_path / "in", cfg, out, state, late="drop")
    assert_same(stored(spark, out), forecasts(rows, cfg))
    out, state = scratch_path(spark, "out"), scratch_path(spark, "state")
    drain(spark, tmp_path / "in", cfg, out, state)
    assert_same(stored(spark, out), forecasts(late, cfg))


def test_late_points_of_a_later_batch_are_dropped(spark, tmp_path):
    rows = [(1, T0 + 4000 * k, 1.0 + k, 2.0, 3.0, 4.0) for k in range(14)]
    late = [(1, T0 + 4000 * k + 1, 7.0, 7.0, 7.0, 7.0) for k in (2, 3, 4)]  # rising, but all before the stored last time
    cfg = ModelConfig(variant="arma_ns", horizon=1, order="arrival")
    put(tmp_path / "in", "0.csv", rows[:7])
    time.sleep(1.1)
    put(tmp_path / "in", "1.csv", late + rows[7:], 7)
    out, state = scratch_path(spark, "out"), scratch_path(spark, "state")
    drain(spark, tmp_path / "in", cfg, out, state, late="drop")
    assert_same(stored(spark, out), forecasts(rows, cfg))


def test_micro_batch_jobs_take_one_step_per_batch(spark, tmp_path):
    rows = [(1, T0 + 4000 * k, 1.0 + 0.001 * k, 2.0, 3.0, 4.0) for k in range(12)]
    cfg = ModelConfig(variant="arima_ns", horizon=3, motion="derived")
    for k in range(3):
        put(tmp_path / "in", f"{k}.csv", rows[4 * k : 4 * k + 4], 4 * k)
        time.sleep(1.1)
    out, state = scratch_path(spark, "out"), scratch_path(spark, "state")
    drain(spark, tmp_path / "in", cfg, out, state)
    got = spark.read.parquet(out).orderBy("origin_timestamp", "step").collect()
    assert [(r.origin_timestamp - T0) // 4000 for r in got if r.step == 0] == [3, 7, 11]
    assert len(got) == 12 and {r.error for r in got} <= {True, False}
    steps = [r for r in got if r.origin_timestamp == T0 + 3 * 4000]
    assert [r.timestamp for r in steps] == [T0 + 4000 * (3 + k) for k in range(4)]
    assert steps[0].speed == 3.0 and steps[1].speed > 0 and steps[2].speed == 0.0  # positions do not move on


def test_csv_stream_is_rate_limited(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"{k}.csv").write_text("id,t,lon,lat,speed,heading\n1,1,1.0,1.0,1.0,1.0\n")
    batches = []
    stream = stream_points_csv(spark, str(tmp_path), files_per_trigger=1)
    query = stream.writeStream.foreachBatch(lambda df, n: batches.append(df.count())).trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    assert batches == [1, 1]


def test_csv_stream_keeps_the_order_of_lines(spark, tmp_path):
    rows = [(1, T0 + 4000 * k, 1.0 + k, 2.0, 3.0, 4.0) for k in range(12)]
    late = [*rows[:7], (1, T0 + 8000, 7.0, 7.0, 7.0, 7.0), *rows[7:]]
    cfg = ModelConfig(variant="arma_ns", horizon=1, order="arrival")
    (tmp_path / "in").mkdir()
    lines = ["id,timestamp,longitude,latitude,speed,heading", *(",".join(map(repr, r)) for r in late)]
    (tmp_path / "in" / "0.csv").write_text("\n".join(lines) + "\n")
    out, state = scratch_path(spark, "out"), scratch_path(spark, "state")
    stream = forecast_stream(stream_points_csv(spark, str(tmp_path / "in")), cfg)
    assert stream_forecasts_to(stream, out, state, trigger=None).awaitTermination(120)
    assert_same(stored(spark, out), forecasts(late, cfg))


def test_lines_of_several_files_keep_the_files_order(spark, tmp_path):
    """Files that come together in one micro-batch, named against the order of their times; late points stay late."""
    rows = walk(seed=31, tracks=2, n=30)
    rows.sort(key=lambda r: r[1])
    for k in (8, 23, 41):
        rows[k], rows[k + 3] = rows[k + 3], rows[k]
    cfg = ModelConfig(variant="arma_ns", horizon=2, lrate=1e-6, order="arrival")
    (tmp_path / "in").mkdir()
    for k in range(4):
        lines = ["id,timestamp,longitude,latitude,speed,heading", *(",".join(map(repr, r)) for r in rows[15 * k : 15 * k + 15])]
        file = tmp_path / "in" / f"{9 - k}.csv"
        file.write_text("\n".join(lines) + "\n")
        os.utime(file, (1_700_000_000 + k, 1_700_000_000 + k))
    for files in (1, 3, 10):
        out, state = scratch_path(spark, "out"), scratch_path(spark, "state")
        stream = forecast_stream(stream_points_csv(spark, str(tmp_path / "in"), files), cfg)
        assert stream_forecasts_to(stream, out, state, trigger=None).awaitTermination(120)
        assert_same(stored(spark, out), forecasts(rows, cfg))


@pytest.mark.parametrize("variant", ["arima_gd", "corr_arma_ns"])
def test_late_points_within_the_bound_give_the_batch_result(spark, tmp_path, variant):
    rnd = random.Random(3)
    rows = sorted(walk(seed=41, tracks=3, n=40), key=lambda r: r[1])
    cfg = ModelConfig(variant=variant, horizon=2, lrate=1e-6)
    arrivals = sorted(rows, key=lambda r: (r[1] + rnd.choice((0, 0, 9_000, 40_000)), r[0]))
    assert arrivals != rows
    size = -(-len(rows) // 4)
    for k in range(4):
        put(tmp_path / "in", f"{k}.csv", arrivals[k * size : (k + 1) * size], k * size)
        os.utime(tmp_path / "in" / f"{k}.csv", (1_700_000_000 + k, 1_700_000_000 + k))
    out, state = scratch_path(spark, "out"), scratch_path(spark, "state")
    drain(spark, tmp_path / "in", cfg, out, state, reorder_ms=50_000)
    put(tmp_path / "in", "4.csv", [(99, rows[-1][1] + 10**9, 0.0, 0.0, 0.0, 0.0)], len(rows))
    drain(spark, tmp_path / "in", cfg, out, state, reorder_ms=50_000)
    assert_same(stored(spark, out), forecasts(rows, cfg))
    with pytest.raises(ValueError):
        forecast_stream(spark.readStream.schema(POINT).csv(str(tmp_path / "in")), cfg.with_(variant="arima_gd", motion="derived"), reorder_ms=1)


def test_a_batch_that_runs_again_leaves_its_rows_once(spark, tmp_path):
    """The log forgets that the last micro-batch was done; a batch without forecasts leaves no folder."""
    rows = [r for r in walk(seed=51, tracks=3, n=30)]
    rows.sort(key=lambda r: r[1])
    cfg = ModelConfig(variant="arma_ns", horizon=2, lrate=1e-6)
    cuts = [0, 4, 40, len(rows)]  # the first four points forecast nothing
    for k in range(3):
        put(tmp_path / "in", f"{k}.csv", rows[cuts[k] : cuts[k + 1]], cuts[k])
        os.utime(tmp_path / "in" / f"{k}.csv", (1_700_000_000 + k, 1_700_000_000 + k))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run_all():
        stream = spark.readStream.schema(POINT).option("header", True).option("maxFilesPerTrigger", 1).csv(str(tmp_path / "in"))
        assert stream_batches_to(forecast_stream(stream, cfg), out, state, trigger=None, files=2).awaitTermination(120)
        return sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir())

    folders = run_all()
    assert folders == ["batch=1", "batch=2"]
    assert_same(stored(spark, out), forecasts(rows, cfg))
    for name in ("2", ".2.crc"):
        (tmp_path / "state" / "commits" / name).unlink()
    assert run_all() == folders
    assert_same(stored(spark, out), forecasts(rows, cfg))
    assert all(len(list((tmp_path / "out" / f).rglob("*.parquet"))) <= 2 for f in folders)


def test_a_large_batch_goes_to_more_files(spark, tmp_path):
    """No task stores more than its share of a micro-batch, however large that is."""
    rows = walk(seed=52, tracks=12, n=20)
    cfg = ModelConfig(variant="arma_ns", horizon=2, lrate=1e-6)
    put(tmp_path / "in", "0.csv", rows)
    stream = spark.readStream.schema(POINT).option("header", True).csv(str(tmp_path / "in"))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    assert stream_batches_to(forecast_stream(stream, cfg), out, state, trigger=None, files=2, file_rows=50).awaitTermination(120)
    assert_same(stored(spark, out), forecasts(rows, cfg))
    assert len(list((tmp_path / "out").rglob("*.parquet"))) > 2


@pytest.mark.parametrize("variant", ["arima_gd", "corr_arma_ns"])
def test_objects_of_a_group_go_together(spark, tmp_path, variant):
    """One call of Python for many objects, with gaps, new and silent ones among them, gives what each gives alone."""
    rows = sorted(walk(seed=61, tracks=9, n=30), key=lambda r: r[1])
    rows = [r for k, r in enumerate(rows) if not (r[0] == 3 and k < 100 or r[0] == 5 and 80 < k < 190)]
    cfg = ModelConfig(variant=variant, horizon=2, lrate=1e-6, vector_init="random", seed=4)
    size = -(-len(rows) // 3)
    for k in range(3):
        put(tmp_path / "in", f"{k}.csv", rows[k * size : (k + 1) * size], k * size)
        os.utime(tmp_path / "in" / f"{k}.csv", (1_700_000_000 + k, 1_700_000_000 + k))
    points = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], POINT)
    want = run(points, cfg)
    for groups in (1, 4):
        out, state = scratch_path(spark, "out"), scratch_path(spark, "state")
        drain(spark, tmp_path / "in", cfg, out, state, idle_timeout_ms=0, groups=groups)
        assert_same(stored(spark, out), want)


def test_each_object_of_a_group_is_forgotten_by_itself(spark, tmp_path):
    cfg = ModelConfig(variant="arma_gd", horizon=2)
    rows = {k: [(k, T0 + 4000 * n, 1.0 + n, 2.0, 3.0, 4.0) for n in range(12)] for k in (1, 2)}
    put(tmp_path / "in", "0.csv", rows[1][:6] + rows[2][:6])
    stream = spark.readStream.schema(POINT).option("header", True).csv(str(tmp_path / "in"))
    out, state = str(tmp_path / "out"), scratch_path(spark, "state")
    query = stream_forecasts_to(forecast_stream(stream, cfg, idle_timeout_ms=20_000, groups=1), out, state, "200 milliseconds")
    try:
        deadline = time.time() + 60
        while time.time() < deadline and not list((tmp_path / "out").rglob("*.parquet")):
            time.sleep(0.2)
        for n in range(6, 9):  # object 2 goes on, object 1 is silent
            time.sleep(4 if n == 6 else 6)
            put(tmp_path / "in", f"{n}.csv", rows[2][n : n + 1], n)
        time.sleep(9)
        put(tmp_path / "in", "9.csv", rows[1][6:9], 20)
        time.sleep(6)
    finally:
        query.stop()
    origins = [(r.id, (r.origin_timestamp - T0) // 4000) for r in spark.read.parquet(out).collect()]
    assert sorted(origins) == [(1, 3), (1, 4), (1, 5), *[(2, n) for n in range(3, 9)]]
