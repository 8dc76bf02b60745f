"""Local extrema of one short window (a bounded frame, never a whole series)."""

from __future__ import annotations

import numpy as np


def peak_positions(x: np.ndarray, distance: int) -> np.ndarray:
    """Interior maxima (plateaus by their middle), thinned so that higher peaks win within ``distance``."""
    if len(x) < 3:
        return np.empty(0, dtype=int)
    starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    ends = np.r_[starts[1:] - 1, len(x) - 1]
    level = x[starts]
    top = np.zeros(len(level), dtype=bool)
    top[1:-1] = (level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])
    peaks = (starts[top] + ends[top]) // 2
    keep = np.ones(len(peaks), dtype=bool)
    for i in np.argsort(x[peaks], kind="stable")[::-1]:
        if keep[i]:
            near = np.abs(peaks - peaks[i]) < distance
            near[i] = False
            keep[near] = False
    return peaks[keep]


def levels_around(values, n: int, distance: int) -> tuple[float, float]:
    x = np.asarray(values, dtype=float)
    if len(x) < n:
        return 0.0, 0.0
    price = x[-1]
    lows, highs = x[peak_positions(-x, distance)], x[peak_positions(x, distance)]
    support = resistance = 0.0
    if price > 0 and len(lows):
        under = lows[lows <= price]
        support = (price - (under.max() if len(under) else lows.min())) / price
    if price > 0 and len(highs):
        over = highs[highs >= price]
        resistance = ((over.min() if len(over) else highs.max()) - price) / price
    return float(support), float(resistance)
