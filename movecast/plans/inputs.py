"""Point tables derived from the ``events`` table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ModelConfig
from ..operators.tracks import track_positions

# Irregular tracks: gaps of two days, a six-hour step. Regular tracks: the default four-second step.
RAW = ModelConfig(sampling=21_600_000, gap_threshold=172_800_000, lrate=1e-6, speed_threshold=40.0)
REGULAR = ModelConfig(horizon=8, lrate=1e-6, speed_threshold=40.0)
REGULAR_START = 1_704_067_200_000


def epoch_ms(column: str) -> Column:
    """Milliseconds of a time without zone, read as UTC whatever the session's zone is."""
    local = F.col(column).cast("timestamp")
    return F.unix_millis(F.from_utc_timestamp(local, F.current_timezone()))


def traj_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One track per user, at the times of its events."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("double")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").cast("int").alias("id"),
        epoch_ms("ts").alias("timestamp"),
        (F.lit(-5.0) + F.col("value") / 100).alias("longitude"),
        (F.lit(36.0) + k / 100).alias("latitude"),
        (F.col("value") / 10).alias("speed"),
        (k * 3.6).alias("heading"),
        F.col("event_id").alias("seq"),
    )


def traj_regular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same points, one every four seconds."""
    at = F.lit(REGULAR_START) + F.lit(REGULAR.sampling) * (F.col("pos") - 1)
    return track_positions(traj_raw(spark, sf_dir)).withColumn("timestamp", at).drop("pos")


def actuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traj_regular(spark, sf_dir).select("id", "timestamp", "longitude", "latitude")
