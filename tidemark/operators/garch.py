"""Rolling GARCH(1,1) forecasts. Each refit looks at one bounded window, so refits run in parallel."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidemark.plans.series import Series, with_blocks

GARCH_SCHEMA = "mu double, omega double, alpha double, beta double, variance double, volatility double, band double, aic double, bic double, n_fit bigint, converged boolean"
# rows of a block: some two hundred refits at the default step
BLOCK_ROWS = 2048


def nelder_mead(f: Callable[[np.ndarray], float], x0: np.ndarray, step: float = 0.25, rounds: int = 1000, tol: float = 1e-9) -> tuple[np.ndarray, bool]:
    """Simplex search for the few parameters of one window, and whether it came to rest within ``rounds``."""
    pts = [x0] + [x0 + step * e for e in np.eye(len(x0))]
    pts = sorted(((f(p), p) for p in pts), key=lambda t: t[0])
    for _ in range(rounds):
        if pts[-1][0] - pts[0][0] < tol:
            break
        centre = np.mean([p for _, p in pts[:-1]], axis=0)
        worst = pts[-1][1]
        tries = [centre + (centre - worst)]
        val = f(tries[0])
        if val < pts[0][0]:
            far = centre + 2 * (centre - worst)
            fv = f(far)
            new = (fv, far) if fv < val else (val, tries[0])
        elif val < pts[-2][0]:
            new = (val, tries[0])
        else:
            near = centre + 0.5 * ((tries[0] if val < pts[-1][0] else worst) - centre)
            nv = f(near)
            new = (nv, near) if nv < min(val, pts[-1][0]) else None
        if new is None:
            best = pts[0][1]
            pts = [pts[0]] + [(f(q), q) for q in (best + 0.5 * (p - best) for _, p in pts[1:])]
        else:
            pts[-1] = new
        pts.sort(key=lambda t: t[0])
    return pts[0][1], pts[-1][0] - pts[0][0] < tol


def fit_garch(returns: np.ndarray) -> tuple[float, ...] | None:
    """Maximum likelihood of a constant-mean GARCH(1,1): (mu, omega, alpha, beta, loglik, next variance, converged)."""
    n = len(returns)
    var = float(returns.var())
    if n < 2 or var == 0 or not np.isfinite(var):
        return None
    tau = min(75, n)
    w = 0.94 ** np.arange(tau)
    w /= w.sum()

    def unpack(x: np.ndarray) -> tuple[float, float, float, float]:
        a, b = 1 / (1 + math.exp(-min(30.0, max(-30.0, x[2])))), 1 / (1 + math.exp(-min(30.0, max(-30.0, x[3]))))
        persist = 0.9999 * b
        alpha = persist * a
        return x[0], var * math.exp(min(20.0, max(-20.0, x[1]))), alpha, persist - alpha

    def path(x: np.ndarray) -> tuple[float, float]:
        mu, omega, alpha, beta = unpack(x)
        e2 = (returns - mu) ** 2
        s2 = float((w * e2[:tau]).sum())
        ll, prev = 0.0, s2
        s2 = omega + (alpha + beta) * s2
        for e in e2.tolist():
            ll += math.log(s2) + e / s2
            s2 = omega + alpha * e + beta * s2
        return ll, s2

    x, rest = nelder_mead(lambda v: path(v)[0], np.array([float(returns.mean()), math.log(0.05), -2.0, 2.2]))
    ll, nxt = path(x)
    mu, omega, alpha, beta = unpack(x)
    return mu, omega, alpha, beta, -0.5 * (ll + n * math.log(2 * math.pi)), nxt, rest


def rolling_garch(df: DataFrame, value: str, s: Series, keep: list[str], window: int = 252, least: int = 50, every: int = 10) -> DataFrame:
    """Forecasts of the volatility of 100 * percent change of ``value``: the model is refitted on the last
    ``window`` rows from row ``least`` on, every ``every`` rows, and its forecast holds until the next fit.

    Blocks carry a halo of one window plus one refit step, so no fit needs rows of another block, and hold so few
    rows that the refits of one key spread over many tasks.
    """
    columns = list(dict.fromkeys([*s.keys, *s.order, *keep, value]))
    blocks = with_blocks(df.select(*columns), s, before=window + every, most=BLOCK_ROWS)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    ddl = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", " + GARCH_SCHEMA

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos", ignore_index=True)
        x, pos = pdf[value].to_numpy(float), pdf["_pos"].to_numpy(np.int64)
        own = ~pdf["_halo"].to_numpy(bool)
        out = np.full((len(pdf), 11), np.nan)
        fitted = None
        # a block of halo rows alone, behind the last row of a key, fits nothing
        first_own = int(np.argmax(own)) if own.any() else len(pdf) + every
        for i in range(len(pdf)):
            due = pos[i] >= least and (pos[i] - least) % every == 0
            if due and i + every >= first_own:  # fits that can still hold inside the block
                seen = x[max(0, i - window + 1): i + 1]
                with np.errstate(divide="ignore", invalid="ignore"):
                    ret = 100 * (seen[1:] / seen[:-1] - 1)
                ret = ret[np.isfinite(ret)]
                fit = fit_garch(ret) if len(ret) >= least - 1 else None
                if fit is not None:
                    mu, omega, alpha, beta, ll, nxt, rest = fit
                    n = len(ret)
                    fitted = (mu, omega, alpha, beta, nxt, math.sqrt(nxt), 0.0, 8 - 2 * ll, 4 * math.log(n) - 2 * ll, n, rest)
            if fitted is not None:
                out[i] = fitted
                out[i, 6] = 1.96 * math.sqrt(fitted[4] / min(pos[i], window))
        names = [c.split()[0] for c in GARCH_SCHEMA.split(", ")]
        res = pd.concat([pdf[keep], pd.DataFrame(out, columns=names)], axis=1)[own]
        res["n_fit"] = res["n_fit"].astype("Int64")
        res["converged"] = res["converged"].astype("boolean")
        return res

    return blocks.groupBy(*s.keys, "_blk").applyInPandas(run, ddl)
