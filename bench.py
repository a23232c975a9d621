"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs three times and counts with its median. ``large`` has forecasts over many copies of the tracks, in events per second.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from movecast.operators.forecast import forecast
from movecast.plans.inputs import REGULAR, traj_regular
from movecast.plans.queries import queries
from movecast.shipping import ship

REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))
#: Events of the large run.
LARGE = 4_000_000

HEADLINE = (
    "track_segments",
    "step_counter",
    "track_legs",
    "resample_spline",
    "training_pairs_diff",
    "weights_gd_level",
    "weights_ns_level",
    "forecast_arma_gd",
    "forecast_arma_ns",
    "forecast_arima_gd",
    "forecast_arima_ns",
    "forecast_corr_arma_gd",
    "forecast_corr_arma_ns",
    "forecast_corr_arima_gd",
    "forecast_corr_arima_ns",
    "forecast_arma_gd_irregular",
    "forecast_corr_arima_ns_irregular",
    "forecast_derived_motion",
    "accuracy_summary",
    "accuracy_by_horizon",
    "sweep_accuracy",
    "forecast_arrival",
    "stream_forecast",
)


def seconds_of(df: DataFrame) -> float:
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def large_runs(spark: SparkSession, sf_dir: str) -> dict:
    """Forecasts of one step over copies of the regular tracks; points are read from a stored copy."""
    points = traj_regular(spark, sf_dir)
    copies = -(-LARGE // points.count())
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/bench-points-{os.getpid()}"
    spread = points.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    spread.withColumn("id", F.col("id") + F.col("copy") * 100_000).drop("copy").write.parquet(folder)
    points = spark.read.parquet(folder)
    events, out = points.count(), {}
    for variant in ("arma_gd", "arima_ns", "corr_arima_gd"):
        cfg = REGULAR.with_(variant=variant)
        out[variant] = round(events / statistics.median(seconds_of(forecast(points, cfg)) for _ in range(REPEATS)))
    return {"events": events, "events_per_sec": out}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("movecast-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    ship(spark)
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()
    registered["forecast_arma_gd"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm the JVM
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(REPEATS):
            start = time.perf_counter()
            registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(runs), 3)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    variants = [n for n in seconds if n.startswith(("forecast_", "stream_"))]
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "events": events,
        "events_per_sec": {n: round(events / seconds[n]) for n in variants},
        "large": large_runs(spark, sf_dir),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
