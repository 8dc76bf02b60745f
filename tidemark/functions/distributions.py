"""Tail probabilities of the t and F distributions for small result tables (one row per comparison)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, functions as F


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float, df: float) -> float:
    if t is None or df is None or math.isnan(t) or math.isnan(df) or df <= 0:
        return float("nan")
    return beta_inc(df / 2.0, 0.5, df / (df + t * t))


def f_cdf(f: float, d1: float, d2: float) -> float:
    if f is None or math.isnan(f):
        return float("nan")
    return beta_inc(d1 / 2.0, d2 / 2.0, d1 * f / (d1 * f + d2)) if f > 0 else 0.0


def t_p_value(t: Column, df: Column) -> Column:
    """Two-sided p-value of a t statistic."""
    def run(ts: pd.Series, dfs: pd.Series) -> pd.Series:
        return pd.Series([t_two_sided(a, b) for a, b in zip(ts.astype(float), dfs.astype(float))])

    run.__annotations__ = {"ts": pd.Series, "dfs": pd.Series, "return": pd.Series}
    return F.nanvl(F.pandas_udf(run, "double")(t, df.cast("double")), F.lit(None).cast("double"))


def f_p_value(f: Column, d1: Column, d2: Column) -> Column:
    """Two-sided p-value of an F statistic."""
    def run(fs: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        cdf = [f_cdf(x, p, q) for x, p, q in zip(fs.astype(float), a.astype(float), b.astype(float))]
        return pd.Series([2 * min(c, 1 - c) for c in cdf])

    run.__annotations__ = {"fs": pd.Series, "a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.nanvl(F.pandas_udf(run, "double")(f, d1.cast("double"), d2.cast("double")), F.lit(None).cast("double"))
