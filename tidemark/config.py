"""Settings with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date


@dataclass(frozen=True)
class SessionSpec:
    zone: str = "America/New_York"
    open_minute: int = 18 * 60
    close_minute: int = 17 * 60
    rth_open: int = 9 * 60 + 30
    rth_close: int = 16 * 60

    @property
    def minutes(self) -> int:
        return (self.close_minute - self.open_minute) % 1440


@dataclass(frozen=True)
class Windows:
    opening: tuple[int, ...] = (5, 15, 30, 60)
    lags: tuple[int, ...] = (1, 5, 15, 30, 60)
    vol: tuple[int, ...] = (15, 30, 60)
    ranges: tuple[int, ...] = (15, 60)
    regime_long: int = 20
    regime_short: int = 5
    trend: float = 0.005
    low: float = 0.75
    high: float = 1.25


@dataclass(frozen=True)
class Research:
    """Split ranges (name, first, last day), of which the locked one needs an explicit unlock."""

    splits: tuple = (("development", date(2021, 7, 28), date(2024, 7, 26)), ("validation", date(2024, 7, 29), date(2025, 7, 25)), ("final_test", date(2025, 7, 28), date(2026, 7, 27)))
    locked: str = "final_test"
    tick: float = 0.25
    confidence: float = 0.95
    min_stability: int = 30
    anchor_step: int = 5
    horizons: tuple[int, ...] = (1, 5, 15, 30, 60)
    roll_lookback: int = 35
    roll_confirm: int = 2
    roll_fallback: int = 5
    chunk_days: int = 7
    backoff: tuple[int, ...] = (1, 2, 4, 8, 16)


@dataclass(frozen=True)
class Inference:
    replicates: int = 5000
    seed: int = 20260729
    seed_v2: int = 20260730
    min_sample: int = 100
    alpha: float = 0.05
    history: int = 60
    min_history: int = 40
    low_q: float = 0.20
    high_q: float = 0.80
    pressure_q: float = 0.90
    activity_q: float = 0.50
    trailing: int = 5
    extra: dict = field(default_factory=dict)


SESSION, WINDOWS, RESEARCH, INFERENCE = SessionSpec(), Windows(), Research(), Inference()
