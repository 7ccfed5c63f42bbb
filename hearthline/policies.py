"""Tunable choices of the valuation and forecast jobs, with the published values as defaults."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from . import constants as K


@dataclass(frozen=True)
class SearchPolicy:
    radius_steps_m: tuple[float, ...] = (400, 800, 1600, 3200, 6400)
    min_comparables: int = 3
    target_comparables: int = 15
    months: int = 60
    nearest: int = K.NEAREST_LIMIT


GB_POLICY = SearchPolicy()
FR_POLICY = SearchPolicy(radius_steps_m=(200, 450, 900, 1800, 3600), months=48)


@dataclass(frozen=True)
class ForecastPolicy:
    long_months: int = K.LONG_MONTHS
    short_months: int = K.SHORT_MONTHS
    min_months: int = K.MIN_FIT_MONTHS
    drift: float = K.DRIFT_SHARE
    momentum: float = K.MOMENTUM_SHARE
    damping: float = K.DAMPING
    shrink_months: float = K.SHRINK_MONTHS
    max_horizon: int = K.MAX_HORIZON_MONTHS
    horizons: tuple[int, ...] = tuple(K.HORIZONS)
    min_origin_year: int = 2005
    min_observations: int = K.MIN_BACKTEST_OBS


@dataclass(frozen=True)
class Clock:
    """The day a job treats as today; no job reads the system clock."""
    today: date = field(default_factory=lambda: date(2001, 11, 30))
