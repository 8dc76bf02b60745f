"""Sums of wide vectors over all rows: one partial vector per task, added up by position in the cluster."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


def summed(df: DataFrame, part: Callable[[pd.DataFrame], np.ndarray], width: int) -> np.ndarray:
    """The sum of ``part(batch)``, a vector of ``width`` numbers, over the batches of ``df``.

    What comes to the driver are ``width`` numbers, however many tasks there are.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(width)
        for pdf in batches:
            if len(pdf):
                total += part(pdf)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": at.astype(np.int32), "v": total[at]})

    rows = df.mapInPandas(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(width)
    for r in rows:
        out[r["at"]] = r["v"]
    return out
