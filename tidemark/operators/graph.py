"""Correlation graphs over symbols: nodes, edges, pair opportunities, neighbour features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.maths import ratio
from tidemark.operators import rolling as R
from tidemark.operators.features import apply_scale, fit_scale
from tidemark.operators.pairs import correlated_pairs
from tidemark.operators.ranking import latest_per_key, top_edges
from tidemark.plans.series import BARS, Series
from tidemark.plans.sizing import broadcast_if_small

NODE_FEATURES = ("price_norm", "momentum_5", "momentum_24", "volatility_5", "volatility_24", "volume_log", "recent_return", "return_std", "skewness", "kurtosis", "rsi", "range_position")


def prepared_bars(df: DataFrame, s: Series = BARS) -> DataFrame:
    """Bars with the series features that nodes read at the end of a window."""
    d = R.bar_features(df, "close", s)
    d = R.rsi_simple(d, "close", 13, s, unit=True)
    return R.price_range_position(d, "close", 20, s)


def graph_nodes(windows: DataFrame, scaled: bool = True) -> DataFrame:
    """Node features per (window_id, symbol) from windowed ``prepared_bars``; undefined values read 0."""
    at, x = F.col("window_row"), F.col("ret")
    close_at = lambda back: F.max(F.when(at == F.col("_size") - back, F.col("close")))
    sizes = windows.groupBy("window_id", "symbol").agg(F.count(F.lit(1)).alias("_size"))
    d = windows.join(sizes, ["window_id", "symbol"])
    last, first = close_at(1), F.max(F.when(at == 0, F.col("close")))
    a = d.groupBy("window_id", "symbol").agg(
        F.when(first > 0, ratio(last, first)).otherwise(1.0).alias("price_norm"),
        (ratio(last, close_at(5)) - 1).alias("momentum_5"), (ratio(last, close_at(24)) - 1).alias("momentum_24"),
        F.max_by("volatility_5", at).alias("volatility_5"), F.max_by("volatility_24", at).alias("volatility_24"),
        F.ln(F.coalesce(ratio(F.max_by("volume", at), F.avg("volume")), F.lit(1.0)) + 1).alias("volume_log"),
        F.max_by("ret", at).alias("recent_return"), F.stddev_pop(x).alias("return_std"),
        F.when(F.count(x) > 3, F.skewness(x)).otherwise(0.0).alias("skewness"), F.when(F.count(x) > 3, F.kurtosis(x)).otherwise(0.0).alias("kurtosis"),
        F.max_by("rsi", at).alias("rsi"), F.max_by("range_position", at).alias("range_position"),
    )
    a = a.withColumns({c: F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)) for c in NODE_FEATURES})
    if not scaled:
        return a
    first_window = a.agg(F.min("window_id").alias("_w"))
    fit_on = a.crossJoin(F.broadcast(first_window)).filter("window_id = _w")
    return apply_scale(a, fit_scale(fit_on, NODE_FEATURES, "robust"))


def graph_edges(windows: DataFrame, value: str = "ret", threshold: float = 0.3, max_edges: int = 200) -> DataFrame:
    """Edges of each window between symbols whose correlation passes the threshold, both directions."""
    corr = correlated_pairs(windows, value, group=["window_id"], strongest=max_edges)
    return top_edges(corr.select("window_id", "a", "b", F.col("corr").alias("weight")), ["window_id"], threshold, max_edges)


def liquid_symbols(df: DataFrame, least: float = 1e6, n: int = 30, s: Series = BARS) -> DataFrame:
    """Symbols whose mean volume over their last n bars reaches the minimum."""
    return latest_per_key(df, s, n).groupBy(*s.keys).agg(F.avg("volume").alias("avg_volume")).filter(F.col("avg_volume") >= least)


def intra_cluster_pairs(df: DataFrame, clusters: DataFrame, corr: DataFrame, least_corr: float = 0.8, least_z: float = 2.0) -> DataFrame:
    """Pairs of one cluster with high correlation whose normalised price gap is far from its mean.

    Pairs come from the correlation table (one row per pair); prices join to those pairs only."""
    base = df.groupBy("symbol").agg(F.min_by("close", "ts").alias("_first"))
    norm = df.join(broadcast_if_small(base), "symbol").select("symbol", "ts", ratio("close", "_first").alias("p"))
    a, b = (clusters.select(F.col("symbol").alias(n), F.col("label").alias(f"_{n}")) for n in ("a", "b"))
    pairs = corr.filter(F.col("corr") >= least_corr).join(broadcast_if_small(a), "a").join(broadcast_if_small(b), "b").filter("_a = _b")
    pairs = pairs.select("a", "b", "corr", F.col("_a").alias("label"))
    both = broadcast_if_small(pairs).join(norm.select(F.col("symbol").alias("a"), "ts", F.col("p").alias("pa")), "a")
    both = both.join(norm.select(F.col("symbol").alias("b"), "ts", F.col("p").alias("pb")), ["b", "ts"])
    gap = F.abs(F.col("pa") - F.col("pb"))
    d = both.groupBy("a", "b", "label", "corr").agg(F.max_by(gap, "ts").alias("spread"), F.avg(gap).alias("mean"), F.stddev_pop(gap).alias("std"))
    d = d.withColumn("z", ratio(F.col("spread") - F.col("mean"), "std")).filter(F.abs("z") >= least_z)
    return d.withColumns({"expected_return": F.abs("z") * F.col("std"), "confidence": F.least("corr", F.lit(1.0)), "kind": F.lit("intra_cluster"), "reverting": F.col("z") > 0})


def cross_cluster_pairs(df: DataFrame, clusters: DataFrame, corr: DataFrame, most_corr: float = -0.5, least_gap: float = 0.05, largest: int = 20, s: Series = BARS) -> DataFrame:
    """Representatives (by recent volume) of two clusters, negatively correlated, with diverging momentum."""
    sizes = clusters.groupBy("label").agg(F.count(F.lit(1)).alias("size")).filter((F.col("size") >= 2) & (F.col("size") <= largest))
    recent = latest_per_key(df, s, 30).groupBy(*s.keys).agg(F.avg("volume").alias("v"))
    reps = recent.join(clusters, "symbol").join(sizes, "label").groupBy("label").agg(F.max_by("symbol", F.struct("v", "symbol")).alias("symbol"))
    mom = R.positional_momentum(df, "close", (10,), s).groupBy("symbol").agg(F.max_by("pos_momentum_10", "ts").alias("m"))
    r = reps.join(mom, "symbol")
    a, b = (r.select(F.col("symbol").alias(n), F.col("label").alias(f"label_{n}"), F.col("m").alias(f"m_{n}")) for n in ("a", "b"))
    d = corr.filter(F.col("corr") <= most_corr).join(broadcast_if_small(a), "a").join(broadcast_if_small(b), "b").filter("label_a <> label_b")
    d = d.withColumn("divergence", F.abs(F.col("m_a") - F.col("m_b"))).filter(F.col("divergence") >= least_gap)
    return d.withColumns({"expected_return": F.col("divergence") * 0.5, "confidence": F.abs("corr"), "kind": F.lit("cross_cluster")})


def neighbour_embeddings(nodes: DataFrame, edges: DataFrame, features: Sequence[str], rounds: int = 2, own: float = 0.5) -> DataFrame:
    """Rounds of mixing each node's features with the weighted mean of its neighbours'."""
    d = nodes.select("window_id", "symbol", *features)
    w = F.abs("weight")
    for _ in range(rounds):
        near = edges.select("window_id", F.col("a").alias("symbol"), F.col("b").alias("_n"), w.alias("_w")).join(
            d.select("window_id", F.col("symbol").alias("_n"), *features), ["window_id", "_n"])
        mean = near.groupBy("window_id", "symbol").agg(*[ratio(F.sum(F.col(c) * F.col("_w")), F.sum("_w")).alias(f"_{c}") for c in features])
        d = d.join(mean, ["window_id", "symbol"], "left").select(
            "window_id", "symbol", *[(own * F.col(c) + (1 - own) * F.coalesce(F.col(f"_{c}"), F.col(c))).alias(c) for c in features])
    return d
