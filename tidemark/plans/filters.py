"""A two-state Kalman filter along a series, in parallel.

Gains and covariances depend on a row's position alone, and settle after some hundred rows. With the gains known the
state is an affine function of the state before, so a block of rows composes to one 2x2 matrix and one vector: blocks
are reduced in parallel, the blocks of a key are chained, and the blocks are replayed from their true start. The
number of passes does not depend on the number of blocks. Inside a block the same is done over strips of rows, which
advance side by side.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidemark.plans.series import Series, join_on_keys, with_blocks
from tidemark.plans.sizing import is_small
from tidemark.session import checkpointed

OUT = ("hedge_ratio", "velocity", "variance", "half_width", "innovation", "innovation_variance", "log_likelihood")
# relative change of the covariance under which it counts as settled: a few units in the last place
SETTLED = 1e-15


def gains(rows: int, q: float, r: float, p0: float) -> np.ndarray:
    """Columns k1, k2, variance, innovation variance for positions 1, 2, ...: ``rows`` of them, or fewer where the
    covariance settles before (later positions have the last row). With q = 0 it never settles."""
    p11, p12, p22, out = p0, 0.0, p0, []
    for _ in range(rows):
        a, b, c = p11 + 2 * p12 + p22 + q, p12 + p22, p22 + 0.1 * q
        s = a + r
        k1, k2 = a / s, b / s
        g = 1 - k1
        new = (g * g * a + k1 * k1 * r, g * (b - k2 * a) + k1 * k2 * r, c - 2 * k2 * b + k2 * k2 * a + k2 * k2 * r)
        out.append((k1, k2, new[0], s))
        if max(abs(n - o) / (abs(n) or 1.0) for n, o in zip(new, (p11, p12, p22))) < SETTLED:
            break
        p11, p12, p22 = new
    return np.array(out).reshape(-1, 4)


def _strips(x: np.ndarray, width: int) -> np.ndarray:
    """Row j holds the j-th value of every strip of ``width`` values; the last strip is filled up with zeros."""
    return np.r_[x, np.zeros(-len(x) % width)].reshape(-1, width).T


def _advance(m, v, z, k1, k2):
    m = m + v
    e = z - m
    return m + k1 * e, v + k2 * e, e


def _composed(z: np.ndarray, k: np.ndarray, width: int) -> np.ndarray:
    """Per strip the images of the states (1, 0) and (0, 1) without observations and of (0, 0) with them."""
    zs, k1, k2, live = _strips(z, width), _strips(k[:, 0], width), _strips(k[:, 1], width), _strips(np.ones(len(z)), width) > 0
    m, v = np.zeros((3, zs.shape[1])), np.zeros((3, zs.shape[1]))
    m[0], v[1] = 1.0, 1.0
    seen = np.zeros_like(m)
    for j in range(width):
        seen[2] = zs[j]
        m1, v1, _ = _advance(m, v, seen, k1[j], k2[j])
        m, v = np.where(live[j], m1, m), np.where(live[j], v1, v)
    return np.stack([m, v])


def _chained(parts: np.ndarray, m: float, v: float) -> np.ndarray:
    """States before each part and after the last one; ``parts`` is state x (two units, observations) x part."""
    states = np.empty((parts.shape[2] + 1, 2))
    states[0] = m, v
    for i in range(parts.shape[2]):
        states[i + 1] = parts[:, :2, i] @ states[i] + parts[:, 2, i]
    return states


def _at(pos: np.ndarray, q: float, r: float, p0: float) -> np.ndarray:
    table = gains(int(pos[-1]), q, r, p0)
    return table[np.minimum(pos, len(table)) - 1]


def _summary(z: np.ndarray, k: np.ndarray) -> list[float]:
    """One block as six numbers: the images of the two unit states, then that of the zero state."""
    parts = _composed(z, k, math.isqrt(len(z) - 1) + 1)
    still = parts.copy()
    still[:, 2] = 0.0
    ends = _chained(still, 1.0, 0.0)[-1], _chained(still, 0.0, 1.0)[-1], _chained(parts, 0.0, 0.0)[-1]
    return [float(x) for end in ends for x in end]


def _replayed(z: np.ndarray, k: np.ndarray, m: float, v: float) -> np.ndarray:
    """The columns ``OUT`` of one block from the state before it."""
    width = math.isqrt(len(z) - 1) + 1
    starts = _chained(_composed(z, k, width), m, v)[:-1]
    zs, k1, k2 = _strips(z, width), _strips(k[:, 0], width), _strips(k[:, 1], width)
    ms, vs, es = np.empty_like(zs), np.empty_like(zs), np.empty_like(zs)
    a, b = starts[:, 0], starts[:, 1]
    for j in range(width):
        a, b, es[j] = _advance(a, b, zs[j], k1[j], k2[j])
        ms[j], vs[j] = a, b
    level, velocity, e = (x.T.ravel()[: len(z)] for x in (ms, vs, es))
    var, s = k[:, 2], k[:, 3]
    return np.c_[level, velocity, var, 1.96 * np.sqrt(var), e, s, -0.5 * (math.log(2 * math.pi) + np.log(s) + e * e / s)]


def kalman_scan(df: DataFrame, s: Series, value: str, keep: list[str], ratio: float = 1.0, q: float = 1e-5, r: float = 1e-3, p0: float = 1.0) -> DataFrame:
    """``keep`` and the columns ``OUT`` of a level-and-velocity filter of ``value`` along each key.

    A null or NaN observation leaves the state undefined from there on, as the sequential filter does; null keys are a
    key of their own; an empty table gives no rows.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    ddl = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"{c} double" for c in OUT)])
    order = list(s.order)
    df = df.select(*dict.fromkeys([*s.keys, *s.order, *keep, value]))

    def framed(pdf: pd.DataFrame, pos: np.ndarray, m: float, v: float) -> pd.DataFrame:
        out = _replayed(pdf[value].to_numpy(float), _at(pos, q, r, p0), m, v)
        return pd.concat([pdf[keep], pd.DataFrame(out, columns=list(OUT))], axis=1)

    if s.bounded or is_small(df):
        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(order, kind="stable", ignore_index=True)
            return framed(pdf, np.arange(1, len(pdf) + 1), ratio, 0.0)

        return df.groupBy(*s.keys).applyInPandas(whole, ddl)

    blocks = checkpointed(with_blocks(df, s).drop("_own", "_halo"))
    cols = [*s.keys, "_blk"]
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema if f.name in cols)

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos", ignore_index=True)
        numbers = _summary(pdf[value].to_numpy(float), _at(pdf["_pos"].to_numpy(), q, r, p0))
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in cols}, "_sum": [numbers]})[[*head_columns, "_sum"]]

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_blk", ignore_index=True)
        states = _chained(np.array(pdf["_sum"].tolist()).reshape(-1, 3, 2).transpose(2, 1, 0), ratio, 0.0)
        return pdf[head_columns].assign(_m=states[:-1, 0], _v=states[:-1, 1])

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos", ignore_index=True)
        return framed(pdf, pdf["_pos"].to_numpy(), float(pdf["_m"].iloc[0]), float(pdf["_v"].iloc[0]))

    head_columns = [f.name for f in blocks.schema if f.name in cols]
    sums = blocks.select(*cols, "_pos", value).groupBy(*cols).applyInPandas(reduce, f"{head}, _sum array<double>")
    starts = sums.groupBy(*s.keys).applyInPandas(chain, f"{head}, _m double, _v double")
    return join_on_keys(blocks, starts, cols).groupBy(*cols).applyInPandas(replay, ddl)
