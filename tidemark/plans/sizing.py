"""Size checks that decide between a one-shuffle plan and a split plan.

The optimizer's size estimate of the input is read without running a job. Small inputs take the
plain plan (one task can hold any key); anything else takes the plan that splits hot keys.
``tidemark.layout`` = ``plain`` / ``split`` overrides the check, which the tests use to run every
query both ways.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from tidemark.session import checkpointed

MB = 1024 * 1024
DEFAULT_SMALL_MB = 128
DEFAULT_BROADCAST_MB = 32


def estimated_bytes(df: DataFrame) -> int | None:
    """Optimizer estimate of the output size, or None where the session cannot tell."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # a remote session has no plan handle
        return None


# a join's estimate is the product of its sides; inputs times this factor is nearer the truth
JOIN_GROWTH = 4


def input_bytes(df: DataFrame) -> int | None:
    """Total estimated size of the tables a plan reads, or None where the session cannot tell."""
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    except Exception:  # a remote session has no plan handle
        return None


def is_small(df: DataFrame, most_mb: int | None = None) -> bool:
    """True when every key of ``df`` fits one task by the size of what it is computed from. Where a join
    grows more than expected the plain plan is slower but still right. ``most_mb`` lowers the limit, for work that is
    heavy per row."""
    conf = df.sparkSession.conf
    mode = conf.get("tidemark.layout", "auto")
    if mode in ("plain", "split"):
        return mode == "plain"
    limit = int(conf.get("tidemark.small.mb", str(DEFAULT_SMALL_MB))) * MB
    limit = limit if most_mb is None else min(limit, most_mb * MB)
    whole, inputs = estimated_bytes(df), input_bytes(df)
    if whole is None or inputs is None:
        return False
    return min(whole, inputs * JOIN_GROWTH) <= limit


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Broadcast hint only under a checked size; otherwise leave the join to the optimizer."""
    size = estimated_bytes(df)
    limit = int(df.sparkSession.conf.get("tidemark.broadcast.mb", str(DEFAULT_BROADCAST_MB))) * MB
    return F.broadcast(df) if size is not None and size <= limit else df


# operators after which reading an input twice would repeat a shuffle
_HEAVY = re.compile(r"^[\s:+|-]*'?(Join|Aggregate|Window|Generate|Sort|RepartitionByExpression|Distinct|FlatMap\w*|MapIn\w*|CoGroup\w*)\b", re.M)


def settled(df: DataFrame) -> DataFrame:
    """Checkpoint an input that a split plan is about to read more than once, unless it is a plain scan.

    Split primitives read rows and summaries of the same input; without this a chain of them would redo
    the chain's shuffles once per reader.
    """
    try:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
    except Exception:  # a remote session has no plan handle
        return checkpointed(df)
    return checkpointed(df) if _HEAVY.search(plan) else df
