"""Scoring, sources and sinks."""

import pytest
from pyspark.sql import functions as F

from movecast.config import ModelConfig
from movecast.operators.evaluate import (
    accuracy_by_horizon,
    error_counts,
    score,
    score_summary,
    settings_label,
)
from movecast.operators.forecast import forecast
from movecast.plans import queries
from movecast.plans.inputs import traj_regular
from movecast.schema import ACCURACY, FORECAST, FORECAST_COLUMNS, POINT
from movecast.sources.points import decode_points, read_actuals, read_forecasts, read_points_csv, stored_table
from movecast.sources.sinks import append_bucketed, write_accuracy, write_forecasts

T0 = 1_700_000_000_000


def forecast_row(key, ts, lon, error=False, horizon=1, speed=1.0):
    return (key, ts, lon, 0.0, speed, 0.0, error, horizon, horizon, ts, 0, "arma_gd", "c")


def test_score_joins_on_id_and_time(spark):
    forecasts = spark.createDataFrame(
        [
            forecast_row(1, T0, 1.0),
            forecast_row(1, T0 + 1, 1.0),  # no true position
            forecast_row(1, T0, 9.0, error=True),  # flagged
            forecast_row(2, T0, 0.0, horizon=2),
        ],
        FORECAST,
    )
    actuals = spark.createDataFrame(
        [(1, T0, 1.0, 1.0), (1, T0, 2.0, 0.0), (2, T0, 0.0, 0.0), (3, T0, 0.0, 0.0)],
        "id int, timestamp bigint, longitude double, latitude double",
    )
    scored = score(forecasts, actuals, settings_label(ModelConfig(path="a.csv"), F.col("horizon")))
    assert scored.schema.names == ACCURACY.names
    rows = sorted((r.horizon, round(r.dist_lon_lat, 3), r.altitude) for r in scored.collect())
    assert rows == [(1, 111194.927, 0.0), (1, 111194.927, 0.0), (2, 0.0, 0.0)]
    label = "arma_gd_historical_positions4_predicted_locations16_sampling_4000_lrate_10E-5_train_3_a_Horizon_"
    assert {r.settings for r in scored.collect()} == {f"{label}1", f"{label}2"}
    assert score(forecasts, actuals, "x", horizon=2).count() == 1
    summary = {r.horizon: r for r in score_summary(scored).collect()}
    assert summary[1].n_scored == 2 and round(summary[1].rms_m, 3) == 111194.927
    counts = {r.horizon: (r.n_forecasts, r.n_errors) for r in error_counts(forecasts).collect()}
    assert counts == {1: (3, 1), 2: (1, 0)}
    tables = {"a": actuals, "b": actuals.where("id = 2")}
    cells = accuracy_by_horizon(forecasts, tables, "run", (1, 2)).collect()
    assert {(r.actuals, r.horizon, r.n_scored) for r in cells} == {("a", 1, 2), ("a", 2, 1), ("b", 2, 1)}


def test_score_pushes_the_horizon_to_the_files(spark, tmp_path):
    points = spark.createDataFrame([(1, T0 + 4000 * k, 1.0 * k, 1.0, 1.0, 1.0) for k in range(9)], POINT)
    path = str(tmp_path / "forecasts")
    write_forecasts(forecast(points, ModelConfig(horizon=4)), path)
    write_forecasts(forecast(points, ModelConfig(variant="arma_ns", horizon=4)), path)  # appends
    stored = read_forecasts(spark, path)
    assert stored.groupBy("variant").count().collect() and set(stored.columns) == set(FORECAST_COLUMNS)
    wanted = stored.where((F.col("horizon") == 2) & (F.col("variant") == "arma_ns"))
    assert wanted.count() == 6
    plan = wanted._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "horizon" in plan.split("PartitionFilters")[1].split("]")[0]
    truth = str(tmp_path / "actuals")
    points.write.parquet(truth)
    out = str(tmp_path / "accuracy")
    for _ in range(2):
        write_accuracy(score(wanted, read_actuals(spark, truth), "run"), out)
    assert spark.read.parquet(out).count() == 2 * 3


def test_csv_and_decoding(spark, tmp_path):
    (tmp_path / "p.csv").write_text("id,t,lon,lat,speed,heading\n1,1700000000000,1.5,2.5,3.5,4.5\n")
    row = (1, T0, 1.5, 2.5, 3.5, 4.5)
    points = read_points_csv(spark, str(tmp_path / "p.csv"))
    assert [tuple(r) for r in points.collect()] == [row] and points.schema == POINT
    (tmp_path / "bad.csv").write_text("id,t,lon,lat,speed,heading\n1,x,1.5,2.5,3.5,4.5\n")
    with pytest.raises(Exception, match="Malformed|MALFORMED"):
        read_points_csv(spark, str(tmp_path / "bad.csv")).collect()
    lines = spark.createDataFrame([(bytearray(b"1,1700000000000,1.5,2.5,3.5,4.5"), 7)], "value binary, offset bigint")
    assert [tuple(r) for r in decode_points(lines).collect()] == [row]
    assert [tuple(r) for r in decode_points(lines, 4, seq="offset").collect()] == [(*row[:4], 0.0, 0.0, 7)]
    with pytest.raises(ValueError):
        decode_points(lines, 5)
    with pytest.raises(Exception, match="INVALID_ARRAY_INDEX|CAST_INVALID"):
        decode_points(spark.createDataFrame([("1,2",)], "value string")).collect()


def test_readers_and_writers_want_one_target(spark):
    df = spark.createDataFrame([], ACCURACY)
    for call in (
        lambda: read_actuals(spark),
        lambda: read_actuals(spark, jdbc_url="jdbc:x", table="t"),
        lambda: write_accuracy(df),
        lambda: write_accuracy(df, "p", jdbc_url="jdbc:x"),
    ):
        with pytest.raises(ValueError):
            call()


def test_bucketed_tables_meet_without_a_shuffle(spark, sf_dir, tmp_path):
    """Two appends to each table, found again under another name; the join reads buckets as they lie."""
    cfg = ModelConfig(variant="corr_arma_gd", horizon=4, lrate=1e-6)
    points = traj_regular(spark, sf_dir)
    rows, true = forecast(points, cfg), points.select("id", "timestamp", "longitude", "latitude")
    for part in ("id % 2 = 0", "id % 2 = 1"):
        append_bucketed(rows.where(part), "some_forecasts", str(tmp_path / "f"), "forecasts", 4)
        append_bucketed(true.where(part), "some_actuals", str(tmp_path / "a"), "actuals", 4)
    again = stored_table(spark, "forecasts_again", str(tmp_path / "f"), "forecasts", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = score(again, spark.table("some_actuals"), "x", horizon=2)
        plan = stored._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan and "PartitionFilters: [isnotnull(horizon" in plan
        want = sorted(map(repr, score(rows, true, "x", horizon=2).collect()))
        assert want and sorted(map(repr, stored.collect())) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("some_forecasts", "some_actuals", "forecasts_again"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_more_points_lie_in_more_buckets(spark, tmp_path, monkeypatch):
    """A task joins a whole bucket, so buckets hold about as many points whatever the table."""
    made = [(k, k % 7, float(k % 5)) for k in range(120)]
    events = spark.createDataFrame(made, "event_id long, user_id long, value double").withColumns(
        {"ts": F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, event_id)"), "props": F.concat(F.lit("k="), F.col("event_id"))}
    )
    events.write.parquet(str(tmp_path / "events.parquet"))
    seen = []
    keep = lambda rows, name, path, kind, buckets: seen.append(buckets) or append_bucketed(rows, name, path, kind, buckets)
    monkeypatch.setattr(queries, "append_bucketed", keep)
    few = sorted(map(repr, queries.queries()["accuracy_bucketed"](spark, str(tmp_path)).collect()))
    monkeypatch.setattr(queries, "BUCKET_POINTS", 10, raising=False)
    assert few and sorted(map(repr, queries.queries()["accuracy_bucketed"](spark, str(tmp_path)).collect())) == few
    assert seen == [8, 8, 12, 12]
