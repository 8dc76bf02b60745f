"""Exact linear-interpolated percentiles, per key, without holding a key's values in one buffer."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.plans.series import join_on_keys
from tidemark.plans.sizing import is_small, settled

RANK_ACCURACY = 100_000


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """One row per key with the requested percentiles of the non-null values.

    Small inputs use the built-in ``percentile``. Larger ones use two passes: a mergeable sketch brackets
    each rank within 1/RANK_ACCURACY of the key's rows, then only the rows inside the brackets are
    counted by value and the rank is read off, so the answer is exact.
    """
    keys = list(keys)
    data = df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v is not null")
    if is_small(df):
        aggs = [F.percentile("_v", F.lit(p)).alias(n) for n, p in probs.items()]
        return data.groupBy(*keys).agg(*aggs)

    data = settled(data)
    eps = 2.0 / RANK_ACCURACY
    names = list(probs)
    grid = [x for n in names for x in (max(0.0, probs[n] - eps), min(1.0, probs[n] + eps))]
    sketch = data.groupBy(*keys).agg(
        F.percentile_approx("_v", grid, RANK_ACCURACY).alias("_q"),
        F.count(F.lit(1)).alias("_n"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
    )
    wanted = F.array(*[
        F.struct(
            F.lit(i).alias("i"),
            F.when(F.lit(probs[n] - eps) <= 0, F.col("_min")).otherwise(F.col("_q")[2 * i]).alias("lo"),
            F.when(F.lit(probs[n] + eps) >= 1, F.col("_max")).otherwise(F.col("_q")[2 * i + 1]).alias("hi"),
            (F.lit(probs[n]) * (F.col("_n") - 1)).alias("rank"),
        )
        for i, n in enumerate(names)
    ])
    brackets = sketch.select(*keys, wanted.alias("_w"))
    joined = join_on_keys(data, brackets, keys) if keys else data.crossJoin(F.broadcast(brackets))
    # Every row falls below, inside or above the bracket of each rank. Inside, rows are counted by value;
    # outside only the count and the value next to the bracket are kept, as the rank can lie one row off.
    marks = joined.select(*keys, "_v", F.explode("_w").alias("_b"))
    side = F.when(F.col("_v") < F.col("_b.lo"), 0).when(F.col("_v") <= F.col("_b.hi"), 1).otherwise(2)
    counted = marks.groupBy(
        *keys, F.col("_b.i").alias("_i"), F.col("_b.rank").alias("_rank"), side.alias("_side"),
        F.when(side == 1, F.col("_v")).alias("_x"),
    ).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    w = Window.partitionBy(*keys, "_i").orderBy("_side", "_x")
    ranked = counted.withColumn("_end", F.sum("_c").over(w)).withColumn("_start", F.col("_end") - F.col("_c"))
    ranked = ranked.withColumn("_x", F.when(F.col("_side") == 0, F.col("_most")).otherwise(F.col("_least")))
    lower = (F.floor("_rank") >= F.col("_start")) & (F.floor("_rank") < F.col("_end"))
    upper = (F.ceil("_rank") >= F.col("_start")) & (F.ceil("_rank") < F.col("_end"))
    picked = ranked.groupBy(*keys, "_i", "_rank").agg(
        F.max(F.when(lower, F.col("_x"))).alias("_lo"), F.max(F.when(upper, F.col("_x"))).alias("_hi")
    )
    frac = F.col("_rank") - F.floor("_rank")
    value_at = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * frac
    return picked.groupBy(*keys).agg(*[F.max(F.when(F.col("_i") == i, value_at)).alias(n) for i, n in enumerate(names)])
