"""Online change-point detection: a step function that takes one key's rows many stretches at a time.

A step is a few dozen operations on some hundred run lengths, so one row after another is mostly the cost of calls. Long runs
of rows are cut into stretches of equal length that advance side by side. All start from a run length of zero; then each runs
again from the end of the one before, only until it meets its own first run. What the detector knew before that row no
longer counts, so its later rows are those of the sequential order. A stretch that never meets it passes its new end on.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd

from tidemark.plans.folds import ALIKE, TINY

BOCD_SCHEMA = "probability double, run_length bigint, recent_std double, level string"
LANES = 32
PIECE = 512  # steps between comparisons of a second run with the first
SLOTS = 4096  # steps before the columns in use move back to the right end
WINDOWS = 128  # rows whose windows are worked on at once


class RunLengths:
    """Constants by run length, and steps of the run-length distribution for several stretches at once."""

    def __init__(self, longest: int, alpha0: float, beta0: float, kappa0: float, mu0: float):
        n = np.arange(longest, dtype=float)
        alpha, kappa = alpha0 + n / 2, kappa0 + n
        stretch = (kappa + 1) / (alpha * kappa)
        lead = np.exp([math.lgamma(a + 0.5) - math.lgamma(a) - 0.5 * math.log(2 * a * math.pi) for a in alpha])
        spread = 2 * alpha * stretch
        self.longest, self.mu0 = longest, mu0
        self.share = np.where(n > 0, 1 / np.maximum(n, 1), 0.0)
        self.of_mean, self.of_prior = n / kappa, kappa0 * mu0 / kappa
        self.of_squares, self.of_gap = 0.5 * n / np.maximum(n - 1, 1) * spread, 0.5 * n * kappa0 / kappa * spread
        self.base = (beta0 + np.where(n == 1, 0.5, 0.0)) * spread  # the variance of one value counts as 1
        self.power, self.lead = -(alpha + 0.5), lead * np.sqrt(spread / stretch)

    def run(self, ahead: np.ndarray, x: np.ndarray, hazard: np.ndarray, probs: np.ndarray, every: int | None = None):
        """Steps along the rows of ``x`` (stretch, step) with their ``hazard``. ``ahead`` has the ``longest - 1`` values before
        each stretch, ``probs`` the distributions there. Returns change probabilities, likeliest run lengths, and the
        distributions after each ``every`` steps and the last one.

        Run length r sees the last r values, the newest among them. Its mean and sum of squares stay in one column while
        r grows, as the columns in use (r ascending) move left by one a step.
        """
        most, size, (count, steps) = self.longest, probs.shape[1], x.shape
        slots = max(SLOTS, most)
        mean, squares, weight = (np.zeros((count, slots + most)) for _ in range(3))
        t1, t2, t3 = (np.empty((count, most)) for _ in range(3))
        values, hazards, begin = np.ascontiguousarray(np.concatenate([ahead, x], axis=1).T)[:, :, None], hazard.T, ahead.shape[1]
        changes, likely, ends = np.zeros((steps, count)), np.zeros((steps, count), dtype=np.int64), []
        o = slots
        with np.errstate(all="ignore"):
            for t, v in enumerate(values, -begin):
                if t == 0:
                    weight[:, o: o + size] = probs
                if o == 0:
                    o = slots
                    for columns in (mean, squares, weight):
                        columns[:, o:] = columns[:, :most]
                        columns[:, :o] = 0.0
                m, s = mean[:, o: o + most], squares[:, o: o + most]
                np.subtract(v, m, out=t1)
                np.multiply(t1, self.share, out=t2)
                m += t2
                np.subtract(t1, t2, out=t2)
                t2 *= t1
                s += t2
                mean[:, o] = squares[:, o] = 0.0  # run length 0 has no values
                if t < 0:
                    o -= 1
                    continue
                m, a, b, q = mean[:, o: o + size], t1[:, :size], t2[:, :size], t3[:, :size]
                if self.mu0:
                    np.subtract(m, self.mu0, out=a)
                    a *= a
                else:
                    np.multiply(m, m, out=a)
                a *= self.of_gap[:size]
                np.multiply(squares[:, o: o + size], self.of_squares[:size], out=b)
                b += a
                b += self.base[:size]
                np.multiply(m, self.of_mean[:size], out=q)
                if self.mu0:
                    q += self.of_prior[:size]
                np.subtract(v, q, out=q)
                q *= q
                q /= b
                q += 1.0
                np.log(q, out=q)
                q *= self.power[:size]
                np.exp(q, out=q)
                np.sqrt(b, out=b)
                q /= b
                q *= self.lead[:size]
                np.maximum(q, 1e-10, out=q)
                h = hazards[t]
                change = q[:, 0] * h
                q *= weight[:, o: o + size]
                kept = min(size, most - 1)
                grown = q[:, :kept].sum(axis=1) * (1 - h)
                total = grown + change
                if kept < size:
                    total += q[:, kept] * (1 - h)
                p = np.minimum(np.where(total > 0, change / total, 0.0), 1.0)
                mass = grown + p
                np.multiply(q, ((1 - h) / mass)[:, None], out=weight[:, o: o + size])
                weight[:, o - 1] = p / mass
                lost = ~(mass > 0)
                if lost.any():
                    weight[lost, o: o + kept] = 0.0
                    weight[lost, o - 1] = 1.0
                o -= 1
                size = kept + 1
                changes[t] = p
                likely[t] = weight[:, o: o + size].argmax(axis=1)
                if t + 1 == steps or every and (t + 1) % every == 0:
                    ends.append(weight[:, o: o + size].copy())
        return changes.T, likely.T, ends


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of distributions agree, value by value."""
    return (np.abs(a - b) <= ALIKE * np.maximum(a, b) + TINY).all(axis=1)


def bocd_step(value: str, keep: list[str], hazard: float = 1 / 250, longest: int = 500, warmup: int = 10, adaptive: bool = False,
              alpha0: float = 1.0, beta0: float = 1.0, kappa0: float = 1.0, mu0: float = 0.0, memory: int = 1000, lanes: int = LANES):
    """Online change-point probabilities with a Student-t predictive from the last r values. With ``adaptive`` the hazard
    follows recent volatility and trend. At most ``lanes`` stretches of rows advance side by side.
    """
    table = RunLengths(longest, alpha0, beta0, kappa0, mu0)
    keep_values = max(memory, longest) if adaptive else longest
    ramp = np.arange(20) - 9.5

    def hazards_of(data: np.ndarray) -> np.ndarray:
        """The hazard after each row of ``data``, of one length of at least 50."""
        whole, trend = data.std(axis=1), data[:, -20:]
        factor = np.where(whole > 0, 1 + 0.5 * (data[:, -50:].std(axis=1) / whole - 1), 1.0)
        slope = (ramp * (trend - trend.mean(axis=1, keepdims=True))).sum(axis=1) / (ramp * ramp).sum()
        factor *= 1 + 0.3 * np.abs(slope) / (trend.std(axis=1) + 1e-8)
        return hazard * np.clip(factor, 0.1, 5.0)

    def hazards(values: np.ndarray, skip: int, before: float) -> np.ndarray:
        """The hazard at each position from ``skip`` on, from up to ``memory`` values ahead of it; ``before`` where there are
        fewer than 50."""
        out = np.full(len(values) - skip, before)
        if not adaptive:
            return out
        if memory < 50:
            out[max(0, 50 - skip):] = hazard
            return out
        with np.errstate(all="ignore"):
            for i in range(max(skip, 50), min(memory, len(values))):
                out[i - skip] = hazards_of(values[None, :i])[0]
            first = max(skip, memory)
            if first < len(values):
                ahead = np.lib.stride_tricks.sliding_window_view(values, memory)
                for i in range(first, len(values), WINDOWS):
                    j = min(i + WINDOWS, len(values))
                    out[i - skip: j - skip] = hazards_of(ahead[i - memory: j - memory])
        return out

    def recent_deviation(values: np.ndarray, skip: int) -> np.ndarray:
        """Population deviation of the last 20 values at each position from ``skip`` on."""
        out = np.empty(len(values) - skip)
        for i in range(skip, min(19, len(values))):
            out[i - skip] = values[: i + 1].std()
        if len(values) >= 20:
            last = np.lib.stride_tricks.sliding_window_view(values, 20)
            for i in range(max(skip, 19), len(values), SLOTS):
                j = min(i + SLOTS, len(values))
                out[i - skip: j - skip] = last[i - 19: j - 19].std(axis=1)
        return out

    def side_by_side(values: np.ndarray, h: np.ndarray, begin: int, count: int, length: int, probs: np.ndarray):
        """``count`` stretches of ``length`` values from ``begin`` on, as if one after the other."""
        at = begin + length * np.arange(count)
        cuts = [*range(0, length, PIECE), length]

        def run(of: np.ndarray, start: np.ndarray, a: int, b: int, every: int | None = None):
            cells = at[of][:, None] + np.arange(a, b)
            back = at[of][:, None] + np.arange(a - longest + 1, a)
            return table.run(np.where(back < 0, 0.0, values[np.maximum(back, 0)]), values[cells], h[cells], start, every)

        start = np.zeros((count, probs.shape[0]))
        start[0], start[1:, 0] = probs, 1.0
        changes, likely, ends = run(np.arange(count), start, 0, length, PIECE)
        again, start = np.arange(1, count), ends[-1][:-1].copy()
        while len(again):
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                changes[again, a:b], likely[again, a:b], (end,) = run(again, start, a, b)
                differ = ~alike(end, ends[k][again])
                ends[k][again] = end
                again, start = again[differ], end[differ]
                if not len(again):
                    break
            start = start[again + 1 < count]  # ends that changed start the stretches behind them anew
            again = again[again + 1 < count] + 1
        return changes.ravel(), likely.ravel(), ends[-1][-1]

    def step(rows: pd.DataFrame, state):
        seen, h, past, probs = state or (0, hazard, (), (1.0,))
        probs = np.asarray(probs, float)
        skip, n = len(past), len(rows)
        values = np.r_[np.asarray(past, float), rows[value].to_numpy(float)]
        rates = np.r_[np.zeros(skip), hazards(values, skip, h)]
        idle = min(n, max(0, warmup - 1 - seen))
        p_out, likely_out = np.zeros(n), np.full(n, probs.argmax(), dtype=np.int64)
        i = idle
        while i < n:
            # run lengths are added one a row at first; later the rows are cut into stretches, and a few are left over
            growing = longest - len(probs)
            count = 1 if growing else max(1, min(lanes, int(((n - i) / 250) ** 0.5)))
            length = min(n - i, growing) if growing else (n - i) // count
            j = i + count * length
            p_out[i:j], likely_out[i:j], probs = side_by_side(values, rates, skip + i, count, length, probs)
            i = j
        level = np.select([p_out >= 0.9, p_out >= 0.7, p_out >= 0.5], ["very_high", "high", "medium"], "low")
        out = rows[keep].reset_index(drop=True)
        out = out.assign(probability=p_out, run_length=likely_out, recent_std=recent_deviation(values, skip), level=level)
        h = float(rates[-1]) if n else h
        return out, (min(seen + n, warmup), h, tuple(values[-keep_values:].tolist()), tuple(probs.tolist()))

    return step
