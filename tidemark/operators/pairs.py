"""Correlated pairs of symbols as blocked matrix products: only pairs that pass become rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.plans.sizing import settled

# symbols of a block, and numbers of a block at most (longer series make narrower blocks)
BLOCK = 256
NUMBERS = 1 << 21
# variance below this share of the mean square is rounding: the values are constant
CONSTANT = 1e-12


def _moments(rows: pd.DataFrame, times: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per symbol and time: number, sum and sum of squares of the values about the symbol's mean, number of values that
    are not finite. Repeated rows of a time add up."""
    n, s1, s2, odd = (np.zeros((len(rows), len(times))) for _ in range(4))
    for i, (ts, xs) in enumerate(zip(rows["_ts"], rows["_xs"])):
        x, at = np.asarray(xs, float), np.searchsorted(times, ts)
        ok = np.isfinite(x)
        x = np.where(ok, x - (x[ok].mean() if ok.any() else 0.0), 0.0)
        for table, values in ((n, 1.0), (s1, x), (s2, x * x), (odd, ~ok * 1.0)):
            np.add.at(table[i], at, values)
    return n, s1, s2, odd


def _correlations(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Common rows and Pearson correlation of every row of ``a`` with every row of ``b``, 0 where undefined."""
    n = a[0] @ b[0].T
    sx, sy, sxx, syy, sxy = a[1] @ b[0].T, a[0] @ b[1].T, a[2] @ b[0].T, a[0] @ b[2].T, a[1] @ b[1].T
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    fine = (vx > CONSTANT * n * sxx) & (vy > CONSTANT * n * syy)
    if a[3].any() or b[3].any():
        fine &= (a[3] @ b[0].T + a[0] @ b[3].T) == 0
    with np.errstate(invalid="ignore", divide="ignore"):
        corr = np.where(fine, (n * sxy - sx * sy) / np.sqrt(vx * vy), 0.0)
    return n, np.clip(corr, -1.0, 1.0)


def correlated_pairs(df: DataFrame, value: str = "close", ts: str = "ts", group: Sequence[str] = (), least: int = 5,
                     at_least: float | None = None, at_most: float | None = None, strongest: int | None = None) -> DataFrame:
    """Group, a, b, n, corr (a < b) of pairs of symbols with ``least`` or more common rows whose Pearson correlation is
    ``at_least`` or more, or ``at_most`` or less; with ``strongest``, of the pairs that can be among so many of largest
    absolute value in their group (ties to the smaller names), and perhaps some more. Without any of the three: of all.

    Every (group, symbol) is one vector, which is sent to each block of symbols once, not to each symbol. A pair of
    blocks is a few dense products with masks for times that only one symbol has; pairs that do not pass are numbers
    in a matrix and never rows. A vector is one symbol's rows of a window or a calendar.

    Rows of null symbol, time, group or value take no part; values that are not finite make a correlation 0; repeated
    rows of a time each meet the other symbol's; an empty table gives no pairs.
    """
    group = list(group)
    rows = df.dropna(subset=[*group, "symbol", ts, value])
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    vectors = rows.groupBy(*group, "symbol").agg(F.array_sort(F.collect_list(F.struct(at.alias("t"), F.col(value).cast("double").alias("x")))).alias("_v"))
    # settled, as their number decides on the blocks before they are read again
    vectors = settled(vectors.select(*group, "symbol", F.col("_v.t").alias("_ts"), F.col("_v.x").alias("_xs")))
    width = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(NUMBERS) / F.max(F.size("_ts")))))
    sizes = vectors.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / width).cast("int").alias("_blocks"))
    placed = vectors.join(sizes, group) if group else vectors.crossJoin(F.broadcast(sizes))
    own, other = F.col("_own"), F.col("_other")
    cells = (
        placed.withColumn("_own", F.pmod(F.xxhash64("symbol"), F.col("_blocks")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .select(*group, "symbol", "_ts", "_xs", "_own", F.least(own, other).alias("_lo"), F.greatest(own, other).alias("_hi"))
    )
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    names = [*group, "a", "b", "n", "corr"]
    ddl = ", ".join([*(f"`{c}` {kinds[c]}" for c in group), f"a {kinds['symbol']}", f"b {kinds['symbol']}", "n bigint", "corr double"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("symbol", ignore_index=True)
        lo, hi = pdf["_lo"].iloc[0], pdf["_hi"].iloc[0]
        left, right = (pdf[pdf["_own"] == k].reset_index(drop=True) for k in (lo, hi))
        times = np.unique(np.concatenate([np.asarray(t) for t in pdf["_ts"]]))
        a = _moments(left, times)
        n, corr = _correlations(a, a if lo == hi else _moments(right, times))
        passes = n >= least
        if lo == hi:
            passes &= np.arange(len(left))[:, None] < np.arange(len(left))
        if at_least is not None or at_most is not None:
            passes &= (corr >= (2.0 if at_least is None else at_least)) | (corr <= (-2.0 if at_most is None else at_most))
        i, j = np.nonzero(passes)
        x, y = left["symbol"].to_numpy()[i], right["symbol"].to_numpy()[j]
        swap = x > y
        out = pd.DataFrame({"a": np.where(swap, y, x), "b": np.where(swap, x, y), "n": n[i, j].astype("int64"), "corr": corr[i, j]})
        if strongest is not None:
            out = out.assign(_s=-out["corr"].abs()).sort_values(["_s", "a", "b"], ignore_index=True).head(strongest)
        for c in group:
            out[c] = pdf[c].iloc[0]
        return out[names]

    return cells.groupBy(*group, "_lo", "_hi").applyInPandas(meet, ddl)
