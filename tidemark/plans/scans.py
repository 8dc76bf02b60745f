"""First-order linear recursions y[t] = m[t] * y[t-1] + b[t] along a series, in parallel.

Both coefficients are known per row, so a block of rows composes to one pair (M, B): blocks are reduced
in parallel, the few block pairs of a key are chained, and the blocks are replayed from their true start.
Moving averages of the exponential kind, cost bases and variance recursions are of this form.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.plans.series import Series, join_on_keys, with_blocks
from tidemark.plans.sizing import is_small, settled


def _walk(m: np.ndarray, b: np.ndarray, y: float) -> np.ndarray:
    out = np.empty(len(m))
    for i, (mi, bi) in enumerate(zip(m.tolist(), b.tolist())):
        y = mi * y + bi
        out[i] = y
    return out


def affine_scan(df: DataFrame, s: Series, m: str, b: str, out: str, start: float = 0.0) -> DataFrame:
    """Add ``out`` = the recursion over the rows of each key in order, from ``start``."""
    return affine_scans(df, s, {out: (m, b)}, start)


def affine_scans(df: DataFrame, s: Series, specs: Mapping[str, tuple[str, str]], start: float = 0.0) -> DataFrame:
    """Several recursions in one pass over the rows: ``specs`` maps a new column to its columns ``(m, b)``."""
    columns, used = df.columns, {c for pair in specs.values() for c in pair}
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"`{n}` double" for n in specs)])
    order = list(s.order)

    def walked(pdf: pd.DataFrame, starts: Sequence[float]) -> pd.DataFrame:
        ends = {n: _walk(pdf[m].to_numpy(float), pdf[b].to_numpy(float), y) for (n, (m, b)), y in zip(specs.items(), starts)}
        return pdf[columns].assign(**ends)

    if s.bounded or is_small(df):
        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            return walked(pdf.sort_values(order, kind="stable", ignore_index=True), [start] * len(specs))

        return df.groupBy(*s.keys).applyInPandas(whole, ddl)

    blocks = settled(with_blocks(df, s).drop("_own", "_halo"))
    cols = [*s.keys, "_blk"]
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema}
    head = ", ".join(f"`{c}` {kinds[c]}" for c in cols)

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos")
        pairs = []
        for m, b in specs.values():
            mm, bb = 1.0, 0.0
            for mi, bi in zip(pdf[m].tolist(), pdf[b].tolist()):
                mm, bb = mm * mi, mi * bb + bi
            pairs += [mm, bb]
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in cols}, "_pairs": [pairs]})

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_blk", ignore_index=True)
        pairs = np.array(pdf["_pairs"].tolist()).reshape(len(pdf), -1, 2)
        starts = [np.r_[start, _walk(pairs[:, i, 0], pairs[:, i, 1], start)[:-1]] for i in range(len(specs))]
        return pdf[cols].assign(_starts=np.stack(starts, axis=1).tolist())

    needed = blocks.select(*cols, "_pos", *sorted(used))
    pairs = needed.groupBy(*cols).applyInPandas(reduce, f"{head}, _pairs array<double>")
    starts = pairs.groupBy(*s.keys).applyInPandas(chain, f"{head}, _starts array<double>")

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        return walked(pdf.sort_values("_pos", ignore_index=True), pdf["_starts"].iloc[0])

    return join_on_keys(blocks, starts, cols).groupBy(*cols).applyInPandas(replay, ddl)
