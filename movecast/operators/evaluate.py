"""Forecasts against true positions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ModelConfig
from ..functions.geo import haversine_m

# The horizons a run is evaluated at.
EVALUATED_HORIZONS = (1, 2, 4, 8, 16, 32)


def settings_label(cfg: ModelConfig, horizon: Column | None = None) -> Column:
    """Label of a run: its settings, and the horizon when given."""
    rate = F.replace(F.lit(float(cfg.lrate)).cast("string"), F.lit("."), F.lit(""))
    stem = cfg.path.removesuffix(".csv")
    parts = [
        F.lit(f"{cfg.variant}_historical_positions{cfg.window}_predicted_locations{cfg.horizon}"),
        F.lit(f"_sampling_{cfg.sampling}_lrate_"),
        rate,
        F.lit(f"_train_{cfg.train}_{stem}"),
    ]
    if horizon is not None:
        parts += [F.lit("_Horizon_"), horizon.cast("string")]
    return F.concat(*parts)


def score(
    forecasts: DataFrame, actuals: DataFrame | None, settings: Column | str, horizon: int | None = None
) -> DataFrame:
    """Great-circle error of every unflagged forecast that has a true position at its (id, timestamp).

    An inner equi-join: several true positions give several rows, none gives none. ``actuals`` is None where the forecasts were made
    with the true positions (column ``truth``); these give the rows of the same join.
    """
    settings = F.lit(settings) if isinstance(settings, str) else settings
    rows = forecasts.where(~F.col("error"))
    if horizon is not None:
        rows = rows.where(F.col("horizon") == horizon)
    tables = [] if actuals is None else [c for c in ("actuals",) if c in actuals.columns]
    if actuals is None:
        pairs = rows.select(*[c for c in rows.columns if c != "truth"], F.inline("truth"))
    else:
        truth = actuals.select(
            "id", "timestamp", F.col("longitude").alias("true_longitude"), F.col("latitude").alias("true_latitude"), *tables
        )
        pairs = rows.join(truth, ["id", "timestamp"])
    at = (F.col("latitude"), F.col("longitude"), F.col("true_latitude"), F.col("true_longitude"))
    return pairs.select(
        settings.alias("settings"),
        F.col("timestamp").alias("prediction_timestamp"),
        "horizon",
        haversine_m(*at).alias("dist_lon_lat"),
        F.lit(0.0).alias("altitude"),
        *tables,
    )


def error_counts(forecasts: DataFrame) -> DataFrame:
    """Forecasts and flagged forecasts per configuration and horizon."""
    return forecasts.groupBy("variant", "config_id", "horizon").agg(
        F.count(F.lit(1)).alias("n_forecasts"), F.count_if(F.col("error")).alias("n_errors")
    )


def score_summary(scored: DataFrame, by: tuple[str, ...] = ("settings", "horizon")) -> DataFrame:
    """Count, mean and root mean square of the errors per run and horizon."""
    d = F.col("dist_lon_lat")
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_scored"), F.avg(d).alias("mean_m"), F.sqrt(F.avg(d * d)).alias("rms_m")
    )


def accuracy_by_horizon(
    forecasts: DataFrame,
    actuals: Mapping[str, DataFrame],
    settings: Column | str,
    horizons: tuple[int, ...] = EVALUATED_HORIZONS,
) -> DataFrame:
    """Errors per true-position table and horizon, all in one join and one aggregate."""
    tables = None
    for name, df in actuals.items():
        df = df.select("id", "timestamp", "longitude", "latitude", F.lit(name).alias("actuals"))
        tables = df if tables is None else tables.unionByName(df)
    wanted = forecasts.where(F.col("horizon").isin(*horizons))
    return score_summary(score(wanted, tables, settings), ("actuals", "settings", "horizon"))
