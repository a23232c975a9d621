"""Forecast jobs over a table of points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ATTRIBUTES, ModelConfig
from ..functions import wavefront as wf
from ..functions.geo import bearing_deg, haversine_m, speed_error, speed_knots
from ..functions.recurrence import linear_start
from ..schema import FORECAST_COLUMNS
from .models import random_start, run_models
from .tracks import event_parts, track_segments, union_parts


def forecast(points: DataFrame, cfg: ModelConfig, horizons: tuple[int, ...] | None = None, **layout) -> DataFrame:
    """Forecast rows of one configuration: one per (trainable event, step), or those of the wanted horizon labels only."""
    return forecast_many(points, [cfg], horizons, **layout)


def forecast_many(
    points: DataFrame,
    configs: list[ModelConfig],
    horizons: tuple[int, ...] | None = None,
    actuals: DataFrame | None = None,
    **layout,
) -> DataFrame:
    """Forecast rows of several configurations that share sampling, gap and order, in one pass over the points.

    With ``actuals`` each row brings the true positions at its (id, timestamp) along (``truth``, an array), for ``score``.
    """
    return forecast_rows(run_models(points, configs, "forecast", actuals, **layout), configs, horizons)


def forecast_rows(runs: DataFrame, configs: list[ModelConfig], horizons: tuple[int, ...] | None = None) -> DataFrame:
    """Explode the forecast arrays of ``run_models``; with ``horizons`` only their entries become rows.

    ``step`` counts from the observed point (0). ``horizon`` is the label under which the job stores the row: plain jobs
    count from 0 = one step ahead, and the plain level gradient job leaves that first row out; jobs that start from the
    observed point count from it.
    """
    facts = F.get(
        F.array(
            *[
                F.struct(
                    F.lit(c.variant).alias("variant"),
                    F.lit(c.config_id).alias("config_id"),
                    F.lit(c.from_observed).alias("from_observed"),
                    F.lit(c.speed_threshold).alias("speed_threshold"),
                    F.lit(c.motion == "derived").alias("derived"),
                    F.lit(c.variant == "arma_gd" and not c.from_observed).alias("skip_first"),
                )
                for c in configs
            ]
        ),
        F.col("config"),
    )
    runs = runs.withColumn("job", facts)
    sampling = configs[0].sampling
    derived = any(c.motion == "derived" for c in configs)
    parts = list(ATTRIBUTES)
    if derived:  # the position before each one travels with it
        for name in ("longitude", "latitude"):
            shifted = F.concat(F.slice(name, 1, 1), F.slice(name, 1, F.size(name) - 1))
            runs = runs.withColumn(f"from_{name}", shifted)
            parts.append(f"from_{name}")
    truth = ["truth"] if "truth" in runs.columns else []
    parts += truth
    keep = ["id", "segment", "origin_timestamp", "base_ts", "job"]
    if horizons is None:
        rows = runs.select(*keep, F.posexplode(F.arrays_zip(*parts)).alias("at", "p"))
    else:
        wanted = F.explode(F.array(*[F.lit(h) for h in sorted(set(horizons))])).alias("at")
        rows = runs.select(*keep, *parts, wanted).where((F.col("at") >= 0) & (F.col("at") < F.size(parts[0])))
        rows = rows.select(*keep, "at", F.struct(*[F.get(c, F.col("at")).alias(c) for c in parts]).alias("p"))
    rows = rows.where(~(F.col("job.skip_first") & (F.col("at") == 0)))
    step = F.col("at") + F.when(F.col("job.from_observed"), 0).otherwise(1)
    rows = rows.withColumn("step", step.cast("int"))
    observed = F.col("step") == 0
    ahead = F.col("base_ts") + F.col("step").cast("bigint") * F.lit(sampling)
    rows = rows.withColumns({a: F.col("p")[a] for a in ATTRIBUTES})
    if derived:
        rows = _derived_motion(rows, sampling)
    at = F.when(observed, F.col("origin_timestamp")).otherwise(ahead)
    return rows.select(
        "id",
        at.alias("timestamp"),
        *ATTRIBUTES,
        (~observed & speed_error(F.col("speed"), F.col("job.speed_threshold"))).alias("error"),
        F.col("at").cast("int").alias("horizon"),
        "step",
        "origin_timestamp",
        "segment",
        F.col("job.variant").alias("variant"),
        F.col("job.config_id").alias("config_id"),
        *[F.col("p")[c].alias(c) for c in truth],
    ).select(*FORECAST_COLUMNS, *truth)


def _derived_motion(rows: DataFrame, sampling: int) -> DataFrame:
    """Speed and heading of each forecast from the leg that leads to it; step 0 keeps the observed values."""
    leg = (F.col("p.from_latitude"), F.col("p.from_longitude"), F.col("latitude"), F.col("longitude"))
    first = F.col("base_ts") + F.lit(sampling) - F.col("origin_timestamp")
    dt = F.when(F.col("step") == 1, first).otherwise(F.lit(sampling))
    moved = {"speed": speed_knots(haversine_m(*leg), dt), "heading": bearing_deg(*leg)}
    use = F.col("job.derived") & (F.col("step") > 0)
    return rows.withColumns({name: F.when(use, leg_value).otherwise(F.col(name)) for name, leg_value in moved.items()})


def fit_weights(points: DataFrame, cfg: ModelConfig, **layout) -> DataFrame:
    """Weights after every trainable event: one row per (event, attribute); ``a`` is the flat Newton matrix."""
    p = cfg.train
    runs = run_models(points, [cfg], "weights", **layout)
    each = F.array(
        *[
            F.struct(
                F.lit(name).alias("attribute"),
                F.slice("w", k * p + 1, p).alias("w"),
                F.slice("a", k * p * p + 1, p * p).alias("a"),
            )
            for k, name in enumerate(ATTRIBUTES)
        ]
    )
    return runs.select("id", "segment", F.col("origin_timestamp").alias("timestamp"), F.inline(each))


def one_step_backtest(points: DataFrame, cfg: ModelConfig, **layout) -> DataFrame:
    """Predicted against actual value of the newest training pair, before the weights saw it.

    ``mean_residual`` averages prediction minus actual over all training pairs of the event; ``corrected`` is the
    prediction shifted down by its size, as the corrected jobs do.
    """
    pairs = cfg.window - cfg.train
    runs = run_models(points, [cfg], "backtest", **layout)

    def of(name: str, k: int) -> Column:
        return F.slice(name, k * pairs + 1, pairs)

    each = F.array(
        *[
            F.struct(F.lit(name).alias("attribute"), of("predicted", k).alias("guess"), of("actual", k).alias("truth"))
            for k, name in enumerate(ATTRIBUTES)
        ]
    )
    residuals = F.zip_with("guess", "truth", lambda g, y: g - y)
    mean = F.aggregate(residuals, F.lit(0.0), lambda acc, r: acc + r) / pairs
    predicted, actual = F.get("guess", F.lit(pairs - 1)), F.get("truth", F.lit(pairs - 1))
    rows = runs.select("id", "segment", F.col("origin_timestamp").alias("timestamp"), F.inline(each))
    return rows.withColumn("mean_residual", mean).select(
        "id",
        "segment",
        "timestamp",
        "attribute",
        predicted.alias("predicted"),
        actual.alias("actual"),
        (predicted - actual).alias("residual"),
        "mean_residual",
        (predicted - F.abs("mean_residual")).alias("corrected"),
    )


def _regular_series(name: str, window: int, diff: bool) -> Column:
    """Training series of an event on the grid. Differences of a history without a point before the window start with a zero
    position and the raw speed and heading."""
    values = F.col("history")[name]
    if not diff:
        return F.slice(values, -window, window)
    changes = F.zip_with(F.slice(values, 2, window), F.slice(values, 1, F.size(values) - 1), lambda b, a: b - a)
    start = F.lit(0.0) if name in ("longitude", "latitude") else F.get(values, F.lit(0))
    return F.when(F.size(values) > window, changes).otherwise(F.concat(F.array(start), changes))


def training_pairs(points: DataFrame, cfg: ModelConfig, diff: bool | None = None, **layout) -> DataFrame:
    """Sliding training pairs of every trainable event: ``features`` (newest first) and ``target`` per attribute."""
    diff = cfg.diff if diff is None else diff
    history = F.array_sort("history") if cfg.order == "arrival" else F.col("history")
    segment = F.col("segment").cast("bigint").alias("segment")
    events = union_parts(
        [
            p.df.where(F.col("z_len") >= cfg.window).select("id", segment, "timestamp", "irregular", history.alias("history"))
            for p in event_parts(points, cfg, history=True, **layout)
        ]
    )
    # Series on the grid are slices of the history; only the others go to the spline task.
    sampled = wf.resampled_series(cfg.window, cfg.sampling, cfg.train, diff)(F.when(F.col("irregular"), F.col("history")))
    events = events.withColumn("sampled", sampled)
    series = events.select(
        "id",
        "segment",
        "timestamp",
        *[
            F.when(F.col("irregular"), F.col("sampled")[a]).otherwise(_regular_series(a, cfg.window, diff)).alias(a)
            for a in ATTRIBUTES
        ],
    )
    each = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).alias("v")) for a in ATTRIBUTES])
    rows = series.select("id", "segment", "timestamp", F.inline(each))
    k = F.explode(F.sequence(F.lit(cfg.train), F.lit(cfg.window - 1)))
    return rows.select("id", "segment", "timestamp", "attribute", "v", k.alias("k")).select(
        "id",
        "segment",
        "timestamp",
        "k",
        "attribute",
        F.reverse(F.slice("v", F.col("k") - cfg.train + 1, F.lit(cfg.train))).alias("features"),
        F.get("v", F.col("k")).alias("target"),
    )


def init_weights(points: DataFrame, cfg: ModelConfig, **layout) -> DataFrame:
    """Start weights and Newton matrix of every (track, attribute)."""
    p = cfg.train
    tracks = track_segments(points, cfg.gap_threshold, cfg.order, **layout).select("id", "segment").distinct()
    if cfg.vector_init == "random":
        w = random_start(cfg)
    else:
        w = F.array(*[F.lit(float(v)) for _ in ATTRIBUTES for v in linear_start(p)])
    matrix = F.array(*[F.lit(cfg.epsilon if r == c else 0.0) for r in range(p) for c in range(p)])
    each = F.array(
        *[
            F.struct(F.lit(name).alias("attribute"), F.slice("w", k * p + 1, p).alias("w"))
            for k, name in enumerate(ATTRIBUTES)
        ]
    )
    return tracks.withColumn("w", w).select("id", "segment", F.inline(each)).withColumn("a", matrix)
