"""Parameters with their usual values."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date


@dataclass(frozen=True)
class StressWindow:
    """A closed interval of dates, and where the estimation period before it begins."""

    key: str
    label: str
    start: date
    end: date
    lookback_start: date


def window(key: str, label: str, start: str, end: str) -> StressWindow:
    first = date.fromisoformat(start)
    return StressWindow(key, label, first, date.fromisoformat(end), first.replace(year=first.year - 3))


@dataclass(frozen=True)
class Config:
    trading_days: int = 252
    risk_free: float = 0.0275
    capital: float = 10_000.0
    cost_bps: float = 10.0
    cost_levels: tuple[float, ...] = (0.0, 25.0, 50.0, 100.0)
    max_cost_bps: float = 500.0
    cost_halvings: int = 16
    top_n: int = 10
    momentum_days: int = 252
    low_vol_days: int = 60
    low_vol_coverage: float = 0.9
    min_history: float = 0.95
    var_confidence: float = 0.95
    var_window: int = 250
    z_scores: tuple[tuple[float, float], ...] = ((0.95, -1.645), (0.99, -2.326))
    chi2_critical: tuple[float, float] = (3.841, 5.991)
    basel_limits: tuple[int, int] = (4, 9)
    rolling_days: int = 90
    chart_points: int = 180
    rolling_points: int = 250
    min_coverage: float = 0.9
    frontier_rows: int = 20
    frontier_points: int = 50
    frontier_steps: int = 600
    cloud_points: int = 2000
    golden_steps: int = 40
    paths: int = 10_000
    bins: int = 32
    stale_days: int = 4
    max_lookback: int = 45
    max_move: float = 0.40
    restate_tolerance: float = 1e-4
    restate_share: float = 0.01
    holdings: int = 8
    windows: tuple[StressWindow, ...] = field(
        default=(
            window("w1998", "1998-99", "1998-06-18", "1999-03-09"),
            window("w1999", "1999-00", "1999-06-20", "2000-01-20"),
            window("w2000", "Early 2000", "2000-02-19", "2000-03-23"),
            window("w2001", "2001", "2001-01-04", "2001-10-14"),
        )
    )


DEFAULT = Config()
