"""Registered queries: each runs over the whole ``events`` table of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import VARIANTS, ModelConfig
from ..operators.evaluate import (
    EVALUATED_HORIZONS,
    accuracy_by_horizon,
    error_counts,
    score,
    score_summary,
    settings_label,
)
from ..operators.forecast import fit_weights, forecast, init_weights, one_step_backtest, training_pairs
from ..operators.legs import track_legs
from ..operators.resample import resample
from ..operators.sweep import SWEEP_HORIZON, SWEEP_RATES, sweep, sweep_grid
from ..operators.tracks import ENDLESS, scratch_path, track_diff, track_history, track_positions, track_segments
from ..schema import ACCURACY, FORECAST_COLUMNS, POINT
from ..sources.points import decode_points, read_actuals, read_forecasts, read_points_csv
from ..sources.sinks import append_bucketed, stream_batches_to, stream_forecasts_to, write_accuracy, write_forecasts
from ..streaming.forecast_stream import forecast_stream
from .inputs import RAW, REGULAR, actuals, epoch_ms, traj_raw, traj_regular

SCORED = REGULAR.with_(variant="corr_arma_gd", path="events.csv")
RATE_TEXT = "10E-6"  # the learning rate of SCORED as the label shows it
DERIVED = REGULAR.with_(variant="arima_gd", motion="derived")
#: Micro-batch jobs take one step for each batch of so many points of a track.
MICRO_BATCH_POINTS = 16
MICRO_BATCHES = {
    "stream_micro_batch": REGULAR.with_(variant="arima_ns", motion="derived"),
    "stream_micro_batch_arma_gd": REGULAR.with_(variant="arma_gd", motion="derived"),
    "stream_micro_batch_arma_ns": REGULAR.with_(variant="arma_ns", motion="derived"),
    "stream_micro_batch_arima_gd": REGULAR.with_(variant="arima_gd", motion="derived"),
    # Off the grid a batch sets the step counter to the length of its resampled history. Gaps do not matter to these jobs.
    "stream_micro_batch_arima_gd_irregular": RAW.with_(variant="arima_gd", horizon=4, motion="derived", gap_threshold=ENDLESS),
}
ARRIVED = RAW.with_(variant="arima_gd", horizon=4, order="arrival")
PUBLISHED = SCORED.with_(horizon=max(EVALUATED_HORIZONS))
#: A layout in which every track of the given tables is hot: chunks of 16 points, pieces of 16 events, rounds of two pieces.
HOT = {"hot_rows": 16, "chunk_rows": 16}
HOT_ROUNDS = HOT | {"piece_rows": 16, "round_pieces": 2}
SWEEP_CONFIGS = [
    REGULAR.with_(variant=v, window=h, train=p, lrate=r, horizon=4, config_id=f"{v}-{h}-{p}-{r}")
    for v in ("arma_gd", "arima_ns")
    for h, p in ((4, 3), (6, 5))
    for r in (1e-6, 1e-7)
]

DAY = 86_400_000
#: Buckets of the stored tables that meet without a shuffle: so many at least, and one for so many points, as a task joins a whole bucket.
BUCKETS = 8
BUCKET_POINTS = 250_000

#: The published grid over tracks whose coordinates ask for lower rates.
PUBLISHED_GRID = sweep_grid(REGULAR.with_(horizon=SWEEP_HORIZON), rates=[r * 1e-4 for r in SWEEP_RATES])

Query = Callable[[SparkSession, str], DataFrame]


def forecast_config(variant: str, irregular: bool = False) -> ModelConfig:
    if irregular:
        return RAW.with_(variant=variant, horizon=4)
    return REGULAR.with_(variant=variant)


def _r(name: str, digits: int = 6) -> Column:
    return (F.round(name, digits) + 0.0).alias(name)  # no negative zeros


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[_r(c, digits) if t == "double" else F.col(c) for c, t in df.dtypes])


def _cells(p: int) -> dict[str, int]:
    return {f"a{r + 1}{c + 1}": r * p + c for r in range(p) for c in range(p)}


def _entries(array: str, picks: dict[str, int], digits: int = 9) -> list[Column]:
    return [(F.round(F.get(array, F.lit(k)), digits) + 0.0).alias(n) for n, k in picks.items()]


def _forecast_out(df: DataFrame) -> DataFrame:
    return _rounded(df.drop("variant", "config_id"))


def _decode(fields: int) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = spark.read.parquet(f"{sf_dir}/events.parquet")
        v = F.col("value")
        text = F.concat_ws(
            ",",
            F.col("user_id").cast("string"),
            epoch_ms("ts").cast("string"),
            *[c.cast("string") for c in (v, v + 1, v * 2, F.col("event_id") % 360)],
        )
        return decode_points(events.select(F.encode(text, "UTF-8").alias("value")), fields)

    return query


def _history(*columns: str, **layout) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return track_history(traj_raw(spark, sf_dir), RAW, **layout).select("id", "timestamp", "segment", *columns)

    return query


def _pairs(variant: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = training_pairs(traj_regular(spark, sf_dir), REGULAR.with_(variant=variant, window=6, train=4))
        return rows.select(
            "id", "segment", "timestamp", "k", "attribute",
            *_entries("features", {f"x{j + 1}": j for j in range(4)}), _r("target", 9),
        )

    return query


def _weights(variant: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        cfg = REGULAR.with_(variant=variant)
        rows = fit_weights(traj_regular(spark, sf_dir), cfg)
        matrix = _entries("a", _cells(3)) if cfg.newton else []
        return rows.select(
            "id", "segment", "timestamp", "attribute", *_entries("w", {f"w{j + 1}": j for j in range(3)}), *matrix
        )

    return query


def _backtest(variant: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        cfg = REGULAR.with_(variant=variant, window=5, train=3)
        return _rounded(one_step_backtest(traj_regular(spark, sf_dir), cfg))

    return query


def _forecast(cfg: ModelConfig, irregular: bool = False, **layout) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        points = traj_raw(spark, sf_dir) if irregular else traj_regular(spark, sf_dir)
        return _forecast_out(forecast(points, cfg, **layout))

    return query


def _legs(*columns: str, digits: int = 6, **layout) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = track_legs(traj_raw(spark, sf_dir), **layout).select("id", "timestamp", *columns)
        return rows.select(*[_r(c, 9 if c == "distance_units" else digits) if t == "double" else F.col(c) for c, t in rows.dtypes])

    return query


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track_segments(traj_raw(spark, sf_dir), RAW.gap_threshold)


def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(track_diff(traj_raw(spark, sf_dir), RAW.gap_threshold), 9)


def _resample(**layout) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(resample(traj_raw(spark, sf_dir), RAW.sampling, RAW.gap_threshold, **layout))

    return query


def _init_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = init_weights(traj_raw(spark, sf_dir), RAW)
    return rows.select(
        "id", "segment", "attribute",
        *_entries("w", {"w1": 0, "w2": 1, "w3": 2}), *_entries("a", _cells(3)),
    )


def _init_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = init_weights(traj_raw(spark, sf_dir), RAW.with_(vector_init="random", seed=7))
    return rows.select("id", "segment", "attribute", *_entries("w", {"w1": 0, "w2": 1, "w3": 2}))


def _scored(spark: SparkSession, sf_dir: str, horizon: int | None = None) -> DataFrame:
    points = traj_regular(spark, sf_dir)
    label = settings_label(SCORED, F.col("horizon"))
    wanted = None if horizon is None else (horizon,)
    return score(forecast(points, SCORED, wanted), actuals(spark, sf_dir), label, horizon)


def _accuracy(horizon: int | None = None) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _scored(spark, sf_dir, horizon).withColumn("dist_lon_lat", _r("dist_lon_lat", 4))

    return query


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(score_summary(_scored(spark, sf_dir)), 3)


def _by_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    true = actuals(spark, sf_dir)
    tables = {"clean": true, "shifted": true.withColumn("longitude", F.col("longitude") + 0.001)}
    forecasts = forecast(traj_regular(spark, sf_dir), PUBLISHED, EVALUATED_HORIZONS)
    return _rounded(accuracy_by_horizon(forecasts, tables, settings_label(PUBLISHED)), 3)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = forecast(traj_regular(spark, sf_dir), SCORED)
    label = settings_label(SCORED, F.col("horizon")).alias("settings")
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("n_forecasts"))


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return error_counts(forecast(traj_regular(spark, sf_dir), SCORED)).drop("config_id")


def _sweep(configs: list[ModelConfig]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        forecasts = sweep(traj_regular(spark, sf_dir), configs, actuals(spark, sf_dir))
        return _rounded(score_summary(score(forecasts, None, F.col("config_id"))), 3)

    return query


def _sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts and their errors go through the stored tables; one forecast row out per row stored."""
    path, truth, scores = (scratch_path(spark, n) for n in ("forecasts", "actuals", "accuracy"))
    write_forecasts(forecast(traj_regular(spark, sf_dir), forecast_config("corr_arma_gd")), path)
    stored = read_forecasts(spark, path)
    actuals(spark, sf_dir).write.parquet(truth)
    write_accuracy(score(stored, read_actuals(spark, truth), settings_label(SCORED)), scores)
    return _forecast_out(stored.select(*FORECAST_COLUMNS))


def _stored_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as read back from the accuracy table, of stored forecasts against stored true positions."""
    path, truth, scores = (scratch_path(spark, n) for n in ("forecasts", "actuals", "accuracy"))
    write_forecasts(forecast(traj_regular(spark, sf_dir), SCORED), path)
    actuals(spark, sf_dir).write.parquet(truth)
    label = settings_label(SCORED, F.col("horizon"))
    write_accuracy(score(read_forecasts(spark, path), read_actuals(spark, truth), label), scores)
    return spark.read.schema(ACCURACY).parquet(scores).withColumn("dist_lon_lat", _r("dist_lon_lat", 4))


def _bucketed_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of forecasts and true positions that are stored in buckets by (id, timestamp): the join has no shuffle."""
    stored = {}
    buckets = max(BUCKETS, -(-traj_raw(spark, sf_dir).count() // BUCKET_POINTS))
    made = {"forecasts": forecast(traj_regular(spark, sf_dir), SCORED), "actuals": actuals(spark, sf_dir)}
    for kind, rows in made.items():
        path = scratch_path(spark, f"bucketed-{kind}")
        stored[kind] = (name := path.rpartition("/")[2].replace("-", "_"))
        append_bucketed(rows, name, path, kind, buckets)
    label = settings_label(SCORED, F.col("horizon"))
    scored = score(spark.table(stored["forecasts"]), spark.table(stored["actuals"]), label)
    return scored.withColumn("dist_lon_lat", _r("dist_lon_lat", 4))


def _stream(cfg: ModelConfig, irregular: bool = False, sink: Callable = stream_forecasts_to) -> Query:
    """The points are replayed as a file stream; the drained result equals the batch job."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        source, out, state = (scratch_path(spark, n) for n in ("points", "forecasts", "state"))
        points = traj_raw(spark, sf_dir) if irregular else traj_regular(spark, sf_dir)
        points.write.parquet(source)
        stream = spark.readStream.schema(points.schema).parquet(source)
        sink(forecast_stream(stream, cfg, idle_timeout_ms=0), out, state, trigger=None).awaitTermination()
        return _forecast_out(read_forecasts(spark, out).select(*FORECAST_COLUMNS))

    return query


def _arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points arrive out of time order: each is late by 400 events for every unit of its number modulo five."""
    points = traj_raw(spark, sf_dir).withColumn("seq", F.col("seq") + 400 * (F.col("seq") % 5))
    return _forecast_out(forecast(points, ARRIVED))


def _micro_batches(cfg: ModelConfig, irregular: bool = False) -> Query:
    """A folder grows by some points of every track at a time; the stream goes on from its checkpoint and takes them."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        staged, source, out, state = (scratch_path(spark, n) for n in ("staged", "points", "forecasts", "state"))
        points = track_positions(traj_raw(spark, sf_dir) if irregular else traj_regular(spark, sf_dir))
        batch = ((F.col("pos") - 1) / MICRO_BATCH_POINTS).cast("int")
        points.withColumn("batch", batch).drop("pos").repartition("batch", "id").write.partitionBy("batch").parquet(staged)
        schema = points.drop("pos").schema
        last = spark.read.schema("batch int").parquet(staged).agg(F.max("batch")).first()[0]
        for number in range(0 if last is None else last + 1):
            spark.read.schema(schema).parquet(f"{staged}/batch={number}").write.mode("append").parquet(source)
            stream = spark.readStream.schema(schema).parquet(source)
            stream_forecasts_to(forecast_stream(stream, cfg), out, state, trigger=None).awaitTermination()
        return _forecast_out(read_forecasts(spark, out).select(*FORECAST_COLUMNS))

    return query


def _reordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points arrive up to four days late, some at a time, and are put in time order; a last, much later point of another object lets
    the stream take what it still holds."""
    staged, source, out, state = (scratch_path(spark, n) for n in ("staged", "points", "forecasts", "state"))
    points = traj_raw(spark, sf_dir)
    schema = points.schema
    late = points.withColumn("arrival", F.col("timestamp") + F.col("seq") % 5 * DAY)
    first, last = late.agg(F.min("arrival"), F.max("arrival")).first()
    if first is not None:
        batch = ((F.col("arrival") - first) / ((last - first) // 4 + 1)).cast("int")
        late.withColumn("batch", batch).drop("arrival").repartition("batch").write.partitionBy("batch").parquet(staged)
    end = spark.createDataFrame([(-1, (last or 0) + 100 * DAY, 0.0, 0.0, 0.0, 0.0, -1)], "id int, timestamp bigint, longitude double, latitude double, speed double, heading double, seq bigint")
    for number in range(5):
        arrived = end if number == 4 or first is None else spark.read.schema(schema).parquet(f"{staged}/batch={number}")
        arrived.select(*schema.fieldNames()).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        ordered = forecast_stream(stream, RAW.with_(variant="arima_gd", horizon=4), reorder_ms=5 * DAY)
        stream_forecasts_to(ordered, out, state, trigger=None).awaitTermination()
    return _forecast_out(read_forecasts(spark, out).select(*FORECAST_COLUMNS))


def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "points-csv")
    traj_raw(spark, sf_dir).select(*POINT.fieldNames()).write.option("header", True).csv(path)
    return read_points_csv(spark, path)


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {
        "decode_points_6": _decode(6),
        "decode_points_4": _decode(4),
        "csv_roundtrip": _csv,
        "track_segments": _segments,
        "history_bounds": _history("n_visible", "first_ts"),
        "sampling_regularity": _history("irregular"),
        "span_guard": _history("span_ok", "z_len"),
        "step_counter": _history("i"),
        "track_diff": _diff,
        "training_pairs_level": _pairs("arma_gd"),
        "training_pairs_diff": _pairs("arima_gd"),
        "track_legs": _legs("dt_ms", "distance_m", "distance_units"),
        "leg_speed": _legs("speed_knots"),
        "leg_bearing": _legs("bearing_deg"),
        "resample_spline": _resample(),
        "init_linear": _init_linear,
        "init_random": _init_random,
        "backtest_gd": _backtest("arma_gd"),
        "backtest_ns": _backtest("arma_ns"),
        "weights_gd_level": _weights("arma_gd"),
        "weights_ns_level": _weights("arma_ns"),
        "weights_gd_diff": _weights("arima_gd"),
        "weights_ns_diff": _weights("arima_ns"),
    }
    for variant in VARIANTS:
        out[f"forecast_{variant}"] = _forecast(forecast_config(variant))
        out[f"forecast_{variant}_hot"] = _forecast(forecast_config(variant), **HOT_ROUNDS)
        out[f"forecast_{variant}_irregular"] = _forecast(forecast_config(variant, irregular=True), irregular=True)
    out |= {
        "forecast_wide_window": _forecast(forecast_config("arima_ns").with_(window=6, train=3)),
        "forecast_derived_motion": _forecast(DERIVED),
        "forecast_arrival": _arrival,
        **{name: _micro_batches(cfg, name.endswith("_irregular")) for name, cfg in MICRO_BATCHES.items()},
        "settings_label": _labels,
        "accuracy": _accuracy(),
        "horizon_accuracy": _accuracy(3),
        "accuracy_summary": _summary,
        "accuracy_by_horizon": _by_horizon,
        "error_counts": _errors,
        "sweep_accuracy": _sweep(SWEEP_CONFIGS),
        "sweep_published": _sweep(PUBLISHED_GRID),
        "sink_roundtrip": _sinks,
        "accuracy_stored": _stored_accuracy,
        "accuracy_bucketed": _bucketed_accuracy,
        "stream_forecast": _stream(forecast_config("corr_arima_gd")),
        "stream_forecast_batches": _stream(forecast_config("arma_ns"), sink=stream_batches_to),
        "stream_forecast_reordered": _reordered,
        "stream_forecast_irregular": _stream(forecast_config("arima_gd", irregular=True), irregular=True),
        "track_history_hot": _history("n_visible", "first_ts", "irregular", "span_ok", "z_len", "i", **HOT),
        "track_legs_hot": _legs("dt_ms", "distance_m", "distance_units", **HOT),
        "resample_spline_hot": _resample(**HOT),
    }
    return out
