"""The step functions of the recursive operators, run per key over a stream."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.plans.folds import Step


def stream_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], step: Step, schema: str) -> DataFrame:
    """Apply ``step`` to each key's rows as they arrive; the state is one value per key in the state store.

    Rows of one micro-batch are put in order; micro-batches are expected in order. A micro-batch bounds
    what one key can bring at once.
    """
    order = list(order)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames), ignore_index=True).sort_values(order, kind="stable", ignore_index=True)
        past = pickle.loads(state.get[0]) if state.exists else None
        out, new = step(rows, past)
        state.update((pickle.dumps(new),))
        yield out

    return df.groupBy(*keys).applyInPandasWithState(run, schema, "blob binary", "append", GroupStateTimeout.NoTimeout)
