"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order of nearness. A block of vectors posts each one, with the
place of the pivot in its order, in the inverted files of its nearest pivots. A query reads the files of its own
nearest pivots and adds up, for each vector posted there, how much nearer its order is than one that shares no
pivot (the induced footrule distance). The best share of a block is reranked by the exact measure, with all that tie
with the last of it. Equal vectors are one entry of the files and count once in the share; a hit stands for the smallest
ids it has. To rank inner products, vectors get one more component that brings all to the same length; queries have zero
there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.search import BLOCK, askers, nearest_in_blocks, usable

#: Size of the pivot sample, taken by the hash of distinct vectors; places kept of an order; distinct vectors that are
#: reranked as a share of a block's rows, and the least number of them.
PIVOTS = 128
PLACES = 64  # up to 255, whose worth 16 bits hold
SHARE = 0.25
LEAST = 200


def orders(matrix: np.ndarray, pivots: np.ndarray, places: int) -> np.ndarray:
    """The nearest pivots of each row, nearest first."""
    near = matrix @ pivots.T
    few = np.argpartition(-near, places - 1, axis=1)[:, :places] if places < near.shape[1] else np.tile(np.arange(near.shape[1]), (len(near), 1))
    return np.take_along_axis(few, np.argsort(-np.take_along_axis(near, few, 1), axis=1, kind="stable"), 1)


class Files:
    """Inverted files of a block: for each pivot, the distinct vectors that have it among their places, by place."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, pivots: np.ndarray, length: float, places: int, share: float, k: int):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.pivots, self.places, self.k = ids[by_id], pivots, places, k
        self.x, self.of = np.unique(matrix[by_id] + 0.0, axis=0, return_inverse=True)
        self.of = self.of.reshape(-1)
        n = len(self.x)
        # rows by vector and id: where each vector's rows begin, and each row's place among them
        rows = np.argsort(self.of, kind="stable")
        begins = np.searchsorted(self.of[rows], np.arange(n + 1))
        self.nth = np.empty(len(ids), np.int64)
        self.nth[rows] = np.arange(len(ids)) - np.repeat(begins[:-1], np.diff(begins))
        self.least, self.most = self.ids[rows[begins[:-1]]], self.ids[rows[begins[1:] - 1]]
        more = np.sqrt(np.maximum(length - (self.x**2).sum(1), 0))
        place_of = orders(np.c_[self.x, more], pivots, places)
        # a file a pivot: what each vector's place of it is worth, nothing where it has none
        self.files = np.zeros((len(pivots), n), np.int16)
        self.files[place_of, np.arange(n)[:, None]] = places - np.arange(places)
        self.reranked = max(LEAST, int(np.ceil(share * len(ids))))

    def __call__(self, query_ids: np.ndarray, matrix: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        asked = orders(np.c_[matrix, np.zeros(len(matrix))], self.pivots, self.places)
        n = len(self.x)
        shared, worth = np.empty((self.places, n), np.int16), (self.places - np.arange(self.places, dtype=np.int16))[:, None]
        read = np.empty_like(self.x)
        for q, order, vector in zip(query_ids, asked, matrix):
            np.take(self.files, order, axis=0, out=shared, mode="clip")
            np.minimum(shared, worth, out=shared)
            nearer = np.add.reduce(shared, axis=0, dtype=np.int16)
            nearer[(self.least == q) & (self.most == q)] = -1
            last = np.partition(nearer, n - self.reranked)[n - self.reranked] if n > self.reranked else 0
            few = np.flatnonzero(nearer >= max(last, 0))
            exact = np.einsum("ij,j->i", np.take(self.x, few, axis=0, out=read[: len(few)], mode="clip"), vector)
            if len(few) > self.k + 1:
                # the own vector aside, k vectors of higher scores leave no place to a lower one
                least = np.partition(exact, len(few) - self.k - 1)[len(few) - self.k - 1]
                few, exact = few[exact >= least], exact[exact >= least]
            score = np.full(n, -np.inf)
            score[few] = exact
            own = self.ids == q
            rows = np.flatnonzero((score > -np.inf)[self.of] & (self.nth < self.k + own.sum()) & ~own)
            yield q, self.ids[rows], score[self.of[rows]]


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, key: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS, places: int = PLACES, share: float = SHARE, block: int = BLOCK) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` (double): the ``k`` largest inner products found for each query.

    Queries are rows whose id is divisible by ``every``, candidates all rows of another id. Vectors null, zero or
    with null or non-finite components and rows without an id take no part; short vectors are padded with zeros;
    repeated rows are candidates each. Blocks of up to LEAST distinct vectors are reranked whole. An empty table gives none.
    """
    rows = usable(vectors, key, vector).where(F.exists("v", lambda x: x != 0))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    length, width = rows.agg(F.max(square), F.max(F.size("v"))).first()
    padded = F.transform(F.concat("v", F.array_repeat(F.lit(0.0), F.lit(width or 0) - F.size("v"))), lambda x: x + F.lit(0.0))
    vector_hash = rows.select(F.xxhash64(padded).alias("h"), "v")
    least = [r.h for r in vector_hash.select("h").distinct().orderBy("h").limit(pivots).collect()]
    sample = vector_hash.where(F.col("h").isin(least)).groupBy("h").agg(F.min("v").alias("v")).orderBy("h").collect()
    chosen = np.zeros((max(1, len(sample)), (width or 0) + 1))
    for r, s in enumerate(sample):
        chosen[r, : len(s.v)] = s.v
        chosen[r, -1] = np.sqrt(max(0.0, length - float(np.dot(s.v, s.v))))
    kept = min(places, len(chosen))
    return nearest_in_blocks(rows, askers(rows, every), k, lambda ids, matrix: Files(ids, matrix, chosen, length, kept, share, k), "double", block)
