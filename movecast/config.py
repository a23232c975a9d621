"""Model settings: one frozen record per forecast job."""

from __future__ import annotations

from dataclasses import dataclass, replace

# Job families. "level" models learn on positions, "diff" models on first differences; "gd" steps along the gradient,
# "ns" takes Newton steps; the corrected jobs shift every forecast by the mean training residual.
VARIANTS = {
    "arma_gd": ("level", "gd", False),
    "arma_ns": ("level", "ns", False),
    "arima_gd": ("diff", "gd", False),
    "arima_ns": ("diff", "ns", False),
    "corr_arma_gd": ("level", "gd", True),
    "corr_arma_ns": ("level", "ns", True),
    "corr_arima_gd": ("diff", "gd", True),
    "corr_arima_ns": ("diff", "ns", True),
}

ATTRIBUTES = ("longitude", "latitude", "speed", "heading")


@dataclass(frozen=True)
class ModelConfig:
    """Settings of one forecast job; the defaults are those of the model's published settings file."""

    variant: str = "arma_gd"
    window: int = 4  # points of history used for training
    train: int = 3  # order of the autoregression, smaller than the window
    horizon: int = 16  # steps to forecast
    lrate: float = 0.00001
    sampling: int = 4000  # fixed step in ms
    epsilon: float = 0.0003  # initial diagonal of the Newton matrix
    gap_threshold: int = 1_800_000  # ms without a point after which a track starts afresh
    speed_threshold: float = 2000.0  # forecasts above this speed are flagged
    vector_init: str = "linear"  # or "random"
    seed: int = 0  # of the random initial weights
    order: str = "event"  # "event": by time; "arrival": by the `seq` column, late points stay late
    motion: str = "model"  # "derived": speed and heading from consecutive forecast positions
    semantics: str = "reference"  # "fixed": corrected difference jobs forecast from differences
    path: str = ""  # name of the input, used in the run label
    config_id: str = ""

    def __post_init__(self) -> None:
        if self.variant not in VARIANTS:
            raise ValueError(f"unknown variant {self.variant!r}; one of {sorted(VARIANTS)}")
        if self.train < 2:
            raise ValueError("train must be at least 2: the linear start vector has two entries")
        if self.train >= self.window:
            raise ValueError("train must be smaller than window")
        if self.horizon < 1 or self.sampling < 1:
            raise ValueError("horizon and sampling must be positive")
        if self.vector_init not in ("linear", "random"):
            raise ValueError("vector_init is 'linear' or 'random'")
        if self.order not in ("event", "arrival"):
            raise ValueError("order is 'event' or 'arrival'")
        if self.motion not in ("model", "derived"):
            raise ValueError("motion is 'model' or 'derived'")
        if self.motion == "derived" and self.corrected:
            raise ValueError("derived motion goes with the uncorrected jobs")
        if self.semantics not in ("reference", "fixed"):
            raise ValueError("semantics is 'reference' or 'fixed'")

    @property
    def diff(self) -> bool:
        return VARIANTS[self.variant][0] == "diff"

    @property
    def newton(self) -> bool:
        return VARIANTS[self.variant][1] == "ns"

    @property
    def corrected(self) -> bool:
        return VARIANTS[self.variant][2]

    @property
    def from_observed(self) -> bool:
        """True when forecasts start with the last observed point as step 0."""
        return self.corrected or self.motion == "derived"

    def with_(self, **changes) -> ModelConfig:
        return replace(self, **changes)
