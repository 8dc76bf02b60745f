"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.session import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """Each node of ``edges(a, b)`` (long) with the smallest node it reaches: ``node``, ``root``.

    Every round hooks larger neighbours to the smallest one (large star), then smaller ones (small star); the
    number of rounds grows with the logarithm of the longest path. Loops and repeated edges are ignored, an
    empty table gives none. Each round is checkpointed, so a lost executor costs one round at most.
    """
    edges = checkpointed(_tidy(edges.select("a", "b")))
    state = _digest(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = _tidy(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = checkpointed(_tidy(small.union(least.select("a", F.col("m").alias("b")))))
        before, state = state, _digest(edges)
        if before == state:
            break
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())
