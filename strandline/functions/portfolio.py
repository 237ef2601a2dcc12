"""Numeric kernels of long-only portfolios on one mean vector and covariance matrix."""

from __future__ import annotations

import numpy as np

from strandline.config import Config


def on_simplex(v: np.ndarray) -> np.ndarray:
    """The nearest weights that are not negative and add up to 1."""
    down = np.sort(v)[::-1]
    over = (np.cumsum(down) - 1) / np.arange(1, len(v) + 1)
    return np.maximum(v - over[np.flatnonzero(down > over)[-1]], 0)


def least_variance(cov: np.ndarray, steps: int) -> np.ndarray:
    w = np.full(len(cov), 1 / len(cov))
    rate = 0.5 / (np.trace(cov) or 1e-12)
    for _ in range(steps):
        w = on_simplex(w - rate * (cov @ w))
    return w


def most_utility(mu: np.ndarray, cov: np.ndarray, caution: float, steps: int, start: np.ndarray) -> np.ndarray:
    w, rate = start, 0.5 / max(caution * np.trace(cov), 1e-9)
    for _ in range(steps):
        w = on_simplex(w + rate * (mu - caution * (cov @ w)))
    return w


def point(w: np.ndarray, mu: np.ndarray, cov: np.ndarray, cfg: Config) -> tuple[float, float, float]:
    """Annual volatility, return and Sharpe ratio (0 without volatility)."""
    vol = float(np.sqrt(max(0.0, w @ cov @ w) * cfg.trading_days))
    back = float(w @ mu) * cfg.trading_days
    return vol, back, (back - cfg.risk_free) / vol if vol > 0 else 0.0


def frontier_of(mu: np.ndarray, cov: np.ndarray, cfg: Config) -> list[tuple[str, np.ndarray]]:
    """(kind, weights): the sweep over risk aversion by rising volatility, the least variance and the best Sharpe ratio.

    The best ratio of the sweep is refined by a golden section over the whole
    range of aversions, tenfold wider at both ends, from the least variance.
    """
    steps = cfg.frontier_steps
    lowest = least_variance(cov, steps)
    natural = (mu.max() - mu.min() or 1e-9) / (np.trace(cov) / len(mu) or 1e-9)
    scales = np.logspace(-4, 4, cfg.frontier_points)[::-1]
    swept, w = [], lowest
    for s in scales:
        w = most_utility(mu, cov, natural * s, steps, w)
        swept.append(w)
    swept.sort(key=lambda x: point(x, mu, cov, cfg)[0])
    ratio = lambda x: point(x, mu, cov, cfg)[2]
    best = lowest
    for x in swept:
        if ratio(x) > ratio(best):
            best = x
    low, high = np.log(natural * scales.min() / 10), np.log(natural * scales.max() * 10)
    golden = (np.sqrt(5) - 1) / 2
    at = lambda x: most_utility(mu, cov, float(np.exp(x)), steps, lowest)
    a, b = high - golden * (high - low), low + golden * (high - low)
    fa, fb = at(a), at(b)
    for _ in range(cfg.golden_steps):
        if ratio(fa) > ratio(fb):
            high, b, fb = b, a, fa
            a = high - golden * (high - low)
            fa = at(a)
        else:
            low, a, fa = a, b, fb
            b = low + golden * (high - low)
            fb = at(b)
    refined = fa if ratio(fa) > ratio(fb) else fb
    if ratio(refined) > ratio(best):
        best = refined
    return [*(("frontier", x) for x in swept), ("min_variance", lowest), ("max_sharpe", best)]
