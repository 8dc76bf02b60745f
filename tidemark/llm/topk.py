"""Exact top-k inner products by aggregation without random access.

For each component a block keeps the list of its rows by falling magnitude. Lists are read side by side, a slice
at a time. What has been read of a row gives a partial score; an unread component is no larger than the last one
read from its list, and all unread ones together no larger than what their row's length leaves (Cauchy-Schwarz), so
every row has a lower and an upper bound. Reading stops for a query once few rows can still qualify, that is, have
an upper bound no lower than the k-th lower bound; their scores are then resolved in integers. The reading order
depends on no query, so one pass over the lists serves all queries of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from tidemark.llm.search import BLOCK, askers, nearest_in_blocks, usable

SCALE = 256
#: Doubles up to here are integers' own, and one in a list that holds larger ones is scaled down for the bounds.
LARGE = 1 << 27
#: Depths of the lists at which bounds are compared, and the rows that may be left to resolve before the last.
DEPTHS = (0.4, 0.6, 0.8, 1.0)
LEFT = 64
LONG = (1 << 63) - 1


def whole(matrix: np.ndarray) -> np.ndarray:
    """Integer components, floor(256 x), as doubles; those beyond the largest double count as it."""
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(SCALE * matrix))


def scaled(matrix: np.ndarray) -> tuple[np.ndarray, float]:
    """The matrix times a power of two that leaves no component above LARGE, and that power."""
    most = np.abs(matrix).max(initial=0)
    power = 0.0 if most <= LARGE else float(np.frexp(LARGE)[1] - np.frexp(most)[1] - 1)
    return (matrix if power == 0 else np.ldexp(matrix, int(power))), power


def products(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products of a query with the columns of ``rows``; those beyond a long count as its limits."""
    if float(np.abs(query).max(initial=0)) * float(np.abs(rows).max(initial=0)) * len(query) < 2.0**62:
        return query.astype(np.int64) @ rows.astype(np.int64)
    own = [int(v) for v in query]
    exact = (sum(a * int(b) for a, b in zip(own, column) if a) for column in rows.T)
    return np.array([max(-LONG - 1, min(LONG, v)) for v in exact], np.int64)


class Lists:
    """Sorted lists of a block and, for each depth, what has been read of them."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.exact = np.ascontiguousarray(whole(matrix).T)
        self.x, self.power = scaled(self.exact)
        size = np.abs(self.x)
        order = np.argsort(-size, axis=1, kind="stable")
        n = len(ids)
        known, unseen, left = np.zeros_like(self.x), np.ones_like(self.x), (self.x**2).sum(0)
        self.most = size.max(1, initial=0)
        self.stages, at = [], 0
        for depth in DEPTHS:
            to = n if depth == 1.0 else int(n * depth)
            for d, row in enumerate(order[:, at:to]):
                known[d, row], unseen[d, row] = self.x[d, row], 0
                left[row] -= self.x[d, row] ** 2
            frontier = np.array([size[d, order[d, to]] if to < n else 0.0 for d in range(len(order))])
            self.stages.append((known.copy(), unseen.copy(), np.maximum(left, 0), frontier))
            at = to

    def __call__(self, query_ids: np.ndarray, matrix: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        integers, ids = whole(matrix), query_ids
        asked, power = scaled(integers)
        most = np.ldexp(1.0, 63 + int(power + self.power))  # what a long holds, in the same scale
        slack = 1e-9 * (np.abs(asked) @ self.most) + 1e-6
        for known, unseen, left, frontier in self.stages:
            score = asked @ known
            gap = np.minimum((np.abs(asked) * frontier) @ unseen, np.sqrt(((asked**2) @ unseen) * left)) + slack[:, None]
            own = ids[:, None] == self.ids
            low = np.where(own, -np.inf, score - gap)
            floor = np.partition(low, -self.k, axis=1)[:, -self.k] if low.shape[1] > self.k else np.full(len(ids), -np.inf)
            fit = (np.clip(score + gap, -most, most) >= np.clip(floor, -most, most)[:, None] * (1 - 1e-9 * np.sign(floor))[:, None]) & ~own
            done = (fit.sum(1) <= LEFT) | (frontier.max(initial=0) == 0)
            for r in np.flatnonzero(done):
                few = np.flatnonzero(fit[r])
                yield ids[r], self.ids[few], products(integers[r], self.exact[:, few])
            asked, integers, ids, slack = asked[~done], integers[~done], ids[~done], slack[~done]
            if not len(ids):
                return


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` (long): the ``k`` largest integer inner products of each query.

    Queries are rows whose id is divisible by ``every``, candidates all rows of another id. Vectors null or with null
    or non-finite components and rows without an id take no part; short vectors are padded with zeros, empty ones
    score 0; repeated rows are candidates each. Scores are exact; one that a long cannot hold counts as its limit, and
    a component above 7e305 as the largest double. An empty table gives none.
    """
    rows = usable(vectors, key, vector)
    return nearest_in_blocks(rows, askers(rows, every), k, lambda ids, matrix: Lists(ids, matrix, k), "long", block)
