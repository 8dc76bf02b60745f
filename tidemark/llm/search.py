"""A stated query set against all vectors, in blocks.

Vectors are dealt into blocks of about BLOCK rows and queries into blocks of about ASKED rows; each pair of blocks
meets in one task, which builds what it needs of its vectors first and then streams its queries past it. Work per
task is bounded at every size, and a lost task is one pair of blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.common import text_batches, written

BLOCK = 8192
ASKED = 1 << 16
BATCH = 128


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``id`` and ``v`` (array of double) of rows with an id whose vector is neither null nor holds null or non-finite components."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(F.coalesce(fine, F.lit(False)))


def askers(vectors: DataFrame, every: int) -> DataFrame:
    """Rows whose id is divisible by ``every``; of rows that share an id the one of the smallest vector asks."""
    return vectors.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))


def nearest_in_blocks(vectors: DataFrame, queries: DataFrame, k: int, index: Callable, kind: str, block: int = BLOCK, asked: int = ASKED) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the ``k`` best per query, ties to the smaller id.

    ``index(ids, matrix)`` makes the answerer of a block: it takes query ids and their matrix and yields, for each
    query, candidate ids and scores. Vectors of different lengths are padded with zeros.
    """
    spark = vectors.sparkSession
    text_batches(spark, BATCH)
    # numbered and written once, so that a part computed again deals its rows to the same blocks
    vectors = written(vectors.withColumn("number", F.monotonically_increasing_id()))
    n, width = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    blocks, parts = max(1, -(-n // block)), max(1, -(-queries.count() // asked))
    own = F.pmod(F.xxhash64("number"), F.lit(blocks)).cast("int")
    left = vectors.select(own.alias("b"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("p"), F.lit(0).alias("role"), "id", "v")
    part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), part.alias("p"), F.lit(1).alias("role"), "id", "v")
    met = left.unionByName(right).repartition(min(20_000, 2 * blocks * parts), "b", "p").sortWithinPartitions("b", "p", "role", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, answer = None, [], None
        for batch in batches:
            at = np.stack([batch.column(c).to_numpy() for c in range(3)])
            edges = np.flatnonzero(np.r_[True, (at[:, 1:] != at[:, :-1]).any(0), True])
            for a, e in zip(edges[:-1], edges[1:]):
                b, p, role = at[:, a]
                ids, rows = batch.column(3).to_numpy()[a:e], matrix(batch.column(4).slice(a, e - a), width)
                if now != (b, p):
                    now, held, answer = (b, p), [], None
                if role == 0:
                    held.append((ids, rows))
                    continue
                if answer is None and held:
                    answer = index(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
                    held = []
                if answer is None:
                    continue
                found = [(q, *best(c, s, k)) for q, c, s in answer(ids, rows)]
                if found:
                    sizes = [len(f[1]) for f in found]
                    columns = [np.repeat([f[0] for f in found], sizes), np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found])]
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2])], ["query_id", "vec_id", "score"])

    found = met.mapInArrow(run, f"query_id long, vec_id long, score {kind}")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """Rows of a list column as a matrix, short rows padded with zeros."""
    flat, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy()
    sizes = np.diff(offsets)
    if (sizes == width).all():
        return flat.reshape(len(lists), width)
    out = np.zeros((len(lists), width))
    row = np.repeat(np.arange(len(lists)), sizes)
    out[row, np.arange(len(flat)) - (offsets[:-1] - offsets[0])[row]] = flat
    return out


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` highest scores and their ids, ties to the smaller id."""
    if len(ids) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[scores >= least], scores[scores >= least]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]
