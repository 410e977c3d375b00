"""Dates, thresholds and grids of the stock-out analytics."""

from __future__ import annotations

from dataclasses import dataclass, field

HORIZON = 12
DEMAND_LAGS = (1, 2, 4, 8, 12, 13, 26, 52)
HIGH_SEASON_WEEKS = (20, 35)
ACTIVE_AMPLITUDE = 10.0
VIP_CUSTOMERS = 50
#: Rounds of the paired bootstrap.
ROUNDS = 5000
HIGH_SEASON_WEIGHT = 1.25
TOP_K = 10
#: Quantile levels that conformal lookups hold, in percent, and normal constants where none applies.
LEVELS = (75, 80, 85, 90, 95, 99)
NORMAL_Z = {75: 1.036, 80: 1.282, 85: 1.440, 90: 1.645, 95: 1.960, 99: 2.576}
MIN_CHILD, MIN_SEASON = 30, 20
#: Share of the validation weeks that tune.
TUNE_SHARE = 0.67
ACCURACY = 100_000


@dataclass(frozen=True)
class Splits:
    """First and last decision weeks of the panel and of its parts."""

    start: str = "1995-01-02"
    end: str = "2001-10-29"
    train_end: str = "1998-12-31"
    calib_end: str = "1999-12-31"
    val_start: str = "2000-01-03"
    val_end: str = "2000-12-31"


@dataclass(frozen=True)
class CalibrationGrid:
    scale: tuple[float, ...] = (0.85, 0.90, 0.92, 0.95, 1.00)
    q90: tuple[int, ...] = (90, 91, 92)
    q95: tuple[int, ...] = (95, 96)
    clip_high: tuple[float, ...] = (0.80, 0.90, 1.00, 1.10, 1.20, 1.50)
    clip_low: float = 0.80


#: zero_run, gap, hist_positive, season, p_oos, recent drop (fixed values)
OOS_WEIGHTS = {
    "A1": (0.40, 0.20, 0.15, 0.10, 0.10, 0.05),
    "A2": (0.35, 0.25, 0.15, 0.10, 0.10, 0.05),
    "B1": (0.15, 0.40, 0.20, 0.10, 0.10, 0.05),
    "B2": (0.20, 0.35, 0.20, 0.10, 0.10, 0.05),
    "C1": (0.15, 0.20, 0.35, 0.15, 0.10, 0.05),
    "C2": (0.15, 0.20, 0.30, 0.20, 0.10, 0.05),
    "D1": (0.25, 0.25, 0.20, 0.15, 0.10, 0.05),
    "D2": (0.20, 0.20, 0.20, 0.20, 0.15, 0.05),
    "E1": (0.45, 0.20, 0.15, 0.10, 0.05, 0.05),
    "E2": (0.50, 0.15, 0.15, 0.10, 0.05, 0.05),
}
OOS_THRESHOLDS = (0.30, 0.40, 0.50, 0.60)
SEASON_COMPONENT = {"ALWAYS_ON": 1.0, "IN_SEASON": 0.80, "TRANSITION_UP": 0.75, "TRANSITION_DOWN": 0.60, "INTERMITTENT_RANDOM": 0.50, "REST_OFFPEAK": 0.35}
SEASON_DEFAULT = 0.20


@dataclass(frozen=True)
class LayerGrid:
    """Gates (forecast, expected loss, suspicion, probability), percentiles and quotas by season (fixed values)."""

    gates: dict = field(default_factory=lambda: {"A": (5.0, 1.0, 0.05, 0.05), "B": (3.0, 0.5, 0.03, 0.03), "C": (1.0, 0.25, 0.01, 0.01)})
    percentiles: dict = field(default_factory=lambda: {"P1": (0.94, 0.94), "P2": (0.90, 0.92), "P3": (0.85, 0.87)})
    quotas: dict = field(default_factory=lambda: {"Q1": (5, 8), "Q2": (10, 15), "Q3": (20, 30)})


@dataclass(frozen=True)
class RecallGrid:
    """Gates, percentiles and quotas of the third layer, (high season, rest) (fixed values)."""

    gates: tuple[str, ...] = ("C", "D", "E")
    percentiles: dict = field(default_factory=lambda: {"P1": (0.87, 0.85), "P2": (0.83, 0.80), "P3": (0.80, 0.75)})
    quotas: dict = field(default_factory=lambda: {"Q1": (30, 20), "Q2": (60, 40), "Q3": (90, 60)})


@dataclass(frozen=True)
class Service:
    """Least, most and ideal share of demand served, most stock to demand, most stock where nothing sells (fixed values)."""

    fill_target: float = 0.9091
    fill_max: float = 0.9180
    fill_ideal: float = 0.912
    ratio_max: float = 1.80
    zeros_max: int = 120_000


SPLITS = Splits()
