"""Legs between consecutive points of a track."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ModelConfig
from ..functions.geo import bearing_deg, euclidean, haversine_m, speed_knots
from .tracks import ENDLESS, event_parts, union_parts


def track_legs(points: DataFrame, gap: int | None = None, order: str = "event", **layout) -> DataFrame:
    """One row per point with a predecessor: distance, time, speed in knots and bearing of the leg that ends there.

    Without ``gap`` the whole track is one line; with it, legs do not cross gaps.
    """
    cfg = ModelConfig(gap_threshold=ENDLESS if gap is None else gap, order=order, window=3, train=2)
    was = F.col("prior")
    at = (was["latitude"], was["longitude"], F.col("latitude"), F.col("longitude"))
    keep = [
        "id",
        "timestamp",
        F.col("segment").cast("bigint").alias("segment"),
        (F.col("timestamp") - was["timestamp"]).alias("dt_ms"),
        haversine_m(*at).alias("distance_m"),
        euclidean(*at).alias("distance_units"),
        speed_knots(haversine_m(*at), F.col("timestamp") - was["timestamp"]).alias("speed_knots"),
        bearing_deg(*at).alias("bearing_deg"),
    ]
    frames = [p.df.where(was.isNotNull()).select(*keep) for p in event_parts(points, cfg, **layout)]
    return union_parts(frames)
