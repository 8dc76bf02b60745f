"""Ordering, top-k and set operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.plans.series import Series
from tidemark.plans.sizing import is_small


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    """First n rows per key. A salted pre-pass keeps n rows per (key, salt), so a hot key is never
    sorted by one task; ``order`` must be total for a repeatable result."""
    rows = df
    if not is_small(df):
        salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(256))
        pre = Window.partitionBy(*keys, "_salt").orderBy(*order)
        rows = df.withColumn("_salt", salt).withColumn("_k", F.row_number().over(pre)).filter(F.col("_k") <= n).drop("_salt", "_k")
    name = rank or "_rank"
    out = rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def latest_per_key(df: DataFrame, s: Series, n: int, rank: str | None = None) -> DataFrame:
    return top_per_key(df, s.keys, [F.col(c).desc() for c in s.order], n, rank)


SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1}


def severity_rank(c: str = "severity") -> Column:
    out = None
    for name, n in SEVERITY_RANK.items():
        out = F.when(F.col(c) == name, n) if out is None else out.when(F.col(c) == name, n)
    return out.otherwise(0)


def dedupe_rank_anomalies(df: DataFrame, kind: str = "anomaly_type", ts: str = "ts", tie: str = "seq") -> DataFrame:
    """The most confident anomaly of each kind and hour, worst severity first, then confidence. The
    winners come from a partial aggregation, not from sorting each hour."""
    row = F.struct(*[F.col(c) for c in df.columns])
    best = df.groupBy(kind, F.date_trunc("hour", ts).alias("_h")).agg(F.max_by(row, F.struct(F.col("confidence"), -F.col(tie))).alias("_r"))
    return best.select("_r.*").orderBy(severity_rank().desc(), F.col("confidence").desc(), F.col(tie))


def rank_opportunities(df: DataFrame) -> DataFrame:
    """Score = expected return * confidence, raised for pairs inside a cluster and lowered for extreme z."""
    score = F.col("expected_return") * F.col("confidence")
    score = score * F.when(F.col("kind") == "intra_cluster", 1.2).otherwise(1.0) * F.when(F.abs("z") > 3, 0.8).otherwise(1.0)
    return df.withColumn("score", score).orderBy(F.col("score").desc())


def top_edges(pairs: DataFrame, window: Sequence[str], threshold: float = 0.3, max_edges: int = 200) -> DataFrame:
    """Edges of each window whose absolute weight passes the threshold, in both directions, at most
    ``max_edges`` by strength; where none passes, the strongest ``max_edges // 2`` pairs."""
    strength = F.abs("weight")
    best = [strength.desc(), F.col("a"), F.col("b")]
    strong = pairs.filter(strength >= threshold)
    if window:
        none = pairs.join(strong.select(*window).distinct(), list(window), "left_anti")
    else:
        flag = strong.agg(F.count(F.lit(1)).alias("_n"))
        none = pairs.crossJoin(F.broadcast(flag)).filter("_n = 0").drop("_n")
    kept = strong.unionByName(top_per_key(none, window, best, max_edges // 2))
    both = kept.unionByName(kept.withColumns({"a": F.col("b"), "b": F.col("a")}))
    return top_per_key(both, window, best, max_edges)


def top_features(df: DataFrame, n: int = 10, name: str = "feature", score: str = "importance") -> DataFrame:
    return df.orderBy(F.col(score).desc(), name).limit(n)


def union_sources(*frames: DataFrame) -> DataFrame:
    """Rows of several sources under one schema; absent columns read null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def timestamp_union(a: DataFrame, b: DataFrame, ts: str = "ts") -> DataFrame:
    return a.select(ts).union(b.select(ts)).distinct()


def timestamp_intersection(a: DataFrame, b: DataFrame, ts: str = "ts") -> DataFrame:
    return a.select(ts).intersect(b.select(ts))


def symbol_coverage(clustered: DataFrame, universe: DataFrame) -> DataFrame:
    """Counts of covered, uncovered and unknown symbols, and the covered share. One row."""
    a, b = clustered.select("symbol").distinct(), universe.select("symbol").distinct()
    n = lambda d, name: d.agg(F.count(F.lit(1)).alias(name))
    out = n(a.intersect(b), "covered").crossJoin(n(b.exceptAll(a), "uncovered")).crossJoin(n(a.exceptAll(b), "unknown"))
    return out.withColumn("coverage", F.try_divide(F.col("covered"), F.col("covered") + F.col("uncovered")))


def merge_intervals(df: DataFrame, s: Series, end: str = "end") -> DataFrame:
    """Union of overlapping or touching intervals per key; ``s.order`` starts with the interval start."""
    from tidemark.plans.series import by_key_size

    return by_key_size(df, s, lambda d, own: _merge_intervals(d, own, end))


def _merge_intervals(df: DataFrame, s: Series, end: str) -> DataFrame:
    from tidemark.plans.series import over_rows, running

    start = s.order[0]
    d = running(df, s, {"_far": ("max", F.col(end))})
    d = over_rows(d, s, lambda x, w: x.withColumn("_past", F.lag("_far", 1).over(w)), before=1)
    d = d.withColumn("_new", F.when(F.col("_past").isNull() | (F.col(start) > F.col("_past")), 1).otherwise(0))
    d = running(d, s, {"_island": ("sum", F.col("_new"))})
    return d.groupBy(*s.keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")
