"""Many configurations over one set of tracks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from ..config import ModelConfig
from .forecast import forecast_many
from .tracks import track_parts, union_parts

# The published sweep grid (windows with their orders, and learning rates).
SWEEP_WINDOWS = ((4, 3), (6, 5), (8, 7), (10, 9))
SWEEP_RATES = (0.0001, 0.001, 0.01)
SWEEP_HORIZON = 32
SWEEP_VARIANTS = ("arma_gd", "arma_ns", "arima_gd", "arima_ns")


def sweep_grid(base: ModelConfig, windows=SWEEP_WINDOWS, rates=SWEEP_RATES, variants=SWEEP_VARIANTS):
    """Configurations of a grid; each rate is also the start diagonal of the Newton matrix, as published."""
    return [
        base.with_(
            variant=v, window=h, train=p, lrate=r, epsilon=r, config_id=f"{v}_w{h}_t{p}_r{r:.0e}"
        )
        for h, p in windows
        for r in rates
        for v in variants
    ]


def sweep(points: DataFrame, configs: Iterable[ModelConfig], actuals: DataFrame | None = None, **layout) -> DataFrame:
    """Forecasts of every configuration, told apart by ``config_id``.

    Configurations with the same sampling, gap and order share one layout, one sort and one pass, whatever their windows: a task keeps the
    points of the largest window of each track, and smaller windows are the ends of it. Points are not multiplied by the number
    of configurations. With ``actuals`` each forecast brings its true positions along (``truth``): they are looked up once per event, and
    ``score`` has nothing to join, so forecasts, far more than the points, are not shuffled.
    """
    groups: dict[tuple, list[ModelConfig]] = {}
    for c in configs:
        groups.setdefault((c.sampling, c.gap_threshold, c.order), []).append(c)
    if not groups:
        raise ValueError("no configurations")
    ids = [c.config_id for group in groups.values() for c in group]
    if len(set(ids)) < len(ids):
        raise ValueError("config_id must be unique")
    rule = {k: layout.pop(k) for k in ("piece_rows", "round_pieces") if k in layout}
    parts = {order: track_parts(points, order, **layout) for order in {order for *_, order in groups}}
    return union_parts([forecast_many(parts[key[-1]], group, actuals=actuals, **rule) for key, group in groups.items()])
