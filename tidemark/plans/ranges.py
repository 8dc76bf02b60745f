"""Searches and extremes over ranges of a long series, without joining every row pair.

A series is cut into blocks of consecutive rows. A query first looks inside the block it starts in, then
among the extremes of its key's blocks for the next block that can answer, then inside that block. Chunks of
queries meet blocks and extremes in groups; chunks are cut anew for the block they go to, so the rows shipped
grow with queries plus series. The work per query is logarithmic in the block and in the number of blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.plans.series import DEFAULT_BLOCK_ROWS, Series, asof, join_on_keys, with_blocks, with_position
from tidemark.plans.sizing import is_small


def first_at_or_below(values: np.ndarray, starts: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """For each query, the first index >= start whose value is <= limit, or -1; all queries at once."""
    size = 1 << max(0, int(np.ceil(np.log2(max(1, len(values))))))
    levels = [np.full(size, np.inf)]
    levels[0][: len(values)] = values
    while len(levels[-1]) > 1:
        levels.append(np.minimum(levels[-1][0::2], levels[-1][1::2]))
    node, found = starts.astype(np.int64).copy(), np.full(len(starts), -1)

    def test(tree: np.ndarray, level: int, mask: np.ndarray) -> None:
        mask = mask & (node < len(tree))
        mask[mask] = tree[node[mask]] <= limits[mask]
        found[mask] = level

    for level, tree in enumerate(levels):  # climb: this node, its neighbour if that is a right child, then up
        test(tree, level, found < 0)
        node[found < 0] += 1
        odd = (found < 0) & (node % 2 == 1)
        test(tree, level, odd)
        node[odd & (found < 0)] += 1
        node[found < 0] >>= 1
    out = np.full(len(starts), -1, dtype=np.int64)
    for level in range(len(levels) - 1, -1, -1):  # descend to the leftmost answer
        here = found >= 0
        at = here & (found == level)
        if level == 0:
            out[at] = node[at]
            break
        left = node[at] * 2
        take_left = levels[level - 1][left] <= limits[at]
        node[at] = np.where(take_left, left, left + 1)
        found[at] = level - 1
    return out


def range_extremes(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimum and maximum of values[lo..hi] (inclusive) for each query, by doubling tables."""
    span = (hi - lo + 1).astype(np.int64)
    level = np.floor(np.log2(span)).astype(np.int64)
    lows, highs = np.empty(len(lo)), np.empty(len(lo))
    mn = mx = values
    for k in range(int(level.max()) + 1 if len(level) else 0):
        if k:
            half = 1 << (k - 1)
            mn = np.minimum(mn[:-half], mn[half:])
            mx = np.maximum(mx[:-half], mx[half:])
        at = level == k
        a, b = lo[at], hi[at] - (1 << k) + 1
        lows[at] = np.minimum(mn[a], mn[b])
        highs[at] = np.maximum(mx[a], mx[b])
    return lows, highs


def _meet(queries: DataFrame, blocks: DataFrame, cols: Sequence[str], fn, ddl: str) -> DataFrame:
    """Bring query chunks and series blocks together: groups of at most one block of each."""
    chunks = queries.select(*[F.col(c).alias(c) for c in (*cols, "_chunk")]).distinct()
    series = join_on_keys(blocks, chunks, list(cols))
    series = series.select(*[F.col(c).alias(c) for c in series.columns])  # fresh column ids for the cogroup
    both = [*cols, "_chunk"]
    return queries.groupBy(*both).cogroup(series.groupBy(*both)).applyInPandas(fn, ddl)


def _per_key(queries: DataFrame, series: DataFrame, keys: Sequence[str], fn, added: str) -> DataFrame:
    """The small-input plan: one group per key, queries beside their series."""
    kinds = {f.name: f.dataType.simpleString() for f in queries.schema}
    ddl = ", ".join([f"`{c}` {kinds[c]}" for c in (*keys, "_qid")] + [added])
    series = series.select(*[F.col(c).alias(c) for c in series.columns])
    return queries.groupBy(*keys).cogroup(series.groupBy(*keys)).applyInPandas(fn, ddl)


def _chunked(queries: DataFrame, s: Series) -> DataFrame:
    """``_chunk``: numbers of consecutive queries of a key, of at most a block's rows each."""
    rows = int(queries.sparkSession.conf.get("tidemark.block.rows", str(DEFAULT_BLOCK_ROWS)))
    placed = with_position(queries, s, "_qpos")
    return placed.withColumn("_chunk", F.expr(f"(_qpos - 1) div {rows}")).drop("_qpos")


def first_touch(
    queries: DataFrame, series: DataFrame, s: Series, qid: str, limit: str, value: str, below: bool = True, ts: str = "ts"
) -> DataFrame:
    """For each query (keys, ts, qid, limit), the position of the first series row at or after its time
    whose value is at or below (or, with ``below=False``, at or above) the limit. Adds ``hit_pos``, which
    joins to ``with_position(series)``; null where nothing touches."""
    sign = 1.0 if below else -1.0
    keys = list(s.keys)
    data = series.select(*keys, *s.order, (F.col(value) * sign).alias("_v"))
    if s.bounded or is_small(queries) and is_small(series):
        asked = queries.select(*keys, F.col(ts).alias("_t"), F.col(qid).alias("_qid"), (F.col(limit) * sign).alias("_lim"))

        def touch(q: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(list(s.order))
            at = np.searchsorted(rows[s.order[0]].to_numpy(), q["_t"].to_numpy(), side="left")
            hit = first_at_or_below(rows["_v"].to_numpy(float), at, q["_lim"].to_numpy(float))
            return q[[*keys, "_qid"]].assign(hit_pos=hit + 1)[hit >= 0]

        return _per_key(asked, data, keys, touch, "hit_pos bigint").withColumnRenamed("_qid", qid)
    blocks = with_blocks(data, s).select(*keys, "_blk", "_pos", "_v")
    starts = asof(
        queries.select(*keys, F.col(ts).alias(s.order[0]), F.col(qid).alias("_qid"), (F.col(limit) * sign).alias("_lim"), F.lit(0).cast("long").alias(s.order[1])),
        with_position(data, s, "_pos"), tuple(keys), {"_pos": "_p0"}, s.order[0], s.order[1], forward=True,
    ).filter("_p0 is not null")
    rows = int(queries.sparkSession.conf.get("tidemark.block.rows", str(DEFAULT_BLOCK_ROWS)))
    starts = starts.withColumn("_blk", F.expr(f"(_p0 - 1) div {rows}"))
    starts = _chunked(starts, Series(s.keys, (s.order[0], "_qid"))).select(*keys, "_blk", "_chunk", "_qid", "_lim", "_p0")
    kinds = {f.name: f.dataType.simpleString() for f in starts.schema}
    cols = [*keys, "_blk"]
    names = [*keys, "_blk", "_chunk", "_qid", "_lim", "hit_pos"]
    ddl = ", ".join(f"`{n}` {kinds.get(n, 'bigint')}" for n in names)

    def search(q: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_pos")
        q = q.copy()
        if len(rows) and len(q):
            first = int(rows["_pos"].iloc[0])
            at = np.maximum(q["_p0"].to_numpy(np.int64) - first, 0)
            hit = first_at_or_below(rows["_v"].to_numpy(float), at, q["_lim"].to_numpy(float))
            q["hit_pos"] = pd.array(np.where(hit >= 0, hit + first, 0), dtype="Int64")
        else:
            q["hit_pos"] = pd.array([0] * len(q), dtype="Int64")
        return q[names]

    own = _meet(starts, blocks, cols, search, ddl)
    done = own.filter("hit_pos > 0").select(*keys, "_qid", "hit_pos")
    extremes = blocks.groupBy(*cols).agg(F.min("_v").alias("_m"))

    def onward(q: pd.DataFrame, ext: pd.DataFrame) -> pd.DataFrame:
        ext = ext.sort_values("_blk")
        ids = ext["_blk"].to_numpy(np.int64)
        at = np.searchsorted(ids, q["_blk"].to_numpy(np.int64), side="right")
        hit = first_at_or_below(ext["_m"].to_numpy(float), at, q["_lim"].to_numpy(float))
        q = q[hit >= 0].copy()
        q["_blk"], q["_p0"] = ids[hit[hit >= 0]], 0
        return q[[*cols, "_qid", "_lim", "_p0"]]

    later = own.filter("hit_pos = 0").select(*cols, "_chunk", "_qid", "_lim")
    later = _meet(later, extremes, keys, onward, ", ".join(f"`{n}` {kinds[n]}" for n in [*cols, "_qid", "_lim", "_p0"]))
    later = _chunked(later, Series((*keys, "_blk"), ("_qid",)))
    there = _meet(later.select(*cols, "_chunk", "_qid", "_lim", "_p0"), blocks, cols, search, ddl)
    return done.unionByName(there.filter("hit_pos > 0").select(*keys, "_qid", "hit_pos")).withColumnRenamed("_qid", qid)


def interval_extremes(queries: DataFrame, series: DataFrame, s: Series, qid: str, start: str, end: str, value: str) -> DataFrame:
    """Minimum and maximum of the series inside [start, end] of each query: ``low``, ``high``; queries
    without a row inside are left out."""
    keys = list(s.keys)
    ts, tie = s.order
    data = series.select(*keys, ts, tie, F.col(value).alias("_v"))
    if s.bounded or is_small(queries) and is_small(series):
        asked = queries.select(*keys, F.col(qid).alias("_qid"), F.col(start).alias("_t0"), F.col(end).alias("_t1"))

        def extremes_of(q: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(list(s.order))
            t = rows[ts].to_numpy()
            lo, hi = np.searchsorted(t, q["_t0"].to_numpy(), side="left"), np.searchsorted(t, q["_t1"].to_numpy(), side="right") - 1
            some = lo <= hi
            low, high = range_extremes(rows["_v"].to_numpy(float), lo[some], hi[some])
            return q[[*keys, "_qid"]][some].assign(low=low, high=high)

        return _per_key(asked, data, keys, extremes_of, "low double, high double").withColumnRenamed("_qid", qid)
    placed = with_position(data, s, "_pos")
    q = queries.select(*keys, F.col(qid).alias("_qid"), F.col(start).alias(ts), F.col(end).alias("_end"), F.lit(0).cast("long").alias(tie))
    q = asof(q, placed, tuple(keys), {"_pos": "_p0"}, ts, tie, right_ts="_t0", forward=True)
    q = q.drop(ts, "_t0").withColumnRenamed("_end", ts)
    q = asof(q, placed, tuple(keys), {"_pos": "_p1"}, ts, tie, right_ts="_t1").filter("_p0 <= _p1").drop("_t1")
    rows = int(queries.sparkSession.conf.get("tidemark.block.rows", str(DEFAULT_BLOCK_ROWS)))
    q = q.withColumns({"_b0": F.expr(f"(_p0 - 1) div {rows}"), "_b1": F.expr(f"(_p1 - 1) div {rows}")})
    blocks = with_blocks(data, s).select(*keys, "_blk", "_pos", "_v")
    pieces = q.select(*keys, "_qid", F.explode(F.array_distinct(F.array("_b0", "_b1"))).alias("_blk"), "_p0", "_p1")
    pieces = _chunked(pieces, Series((*keys, "_blk"), ("_qid",)))
    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema}
    ddl = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], f"`_qid` {kinds['_qid']}", "low double", "high double"])

    def inside(part: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("_pos")
        first, n = int(block["_pos"].iloc[0]), len(block)
        lo = np.maximum(part["_p0"].to_numpy(np.int64) - first, 0)
        hi = np.minimum(part["_p1"].to_numpy(np.int64) - first, n - 1)
        out = part[[*keys, "_qid"]].copy()
        out["low"], out["high"] = range_extremes(block["_v"].to_numpy(float), lo, hi)
        return out

    ends = _meet(pieces, blocks, [*keys, "_blk"], inside, ddl)
    extremes = blocks.groupBy(*keys, "_blk").agg(F.min("_v").alias("_mn"), F.max("_v").alias("_mx"))

    def between(part: pd.DataFrame, ext: pd.DataFrame) -> pd.DataFrame:
        ext = ext.sort_values("_blk")  # the blocks of a key are numbered without gaps
        first = int(ext["_blk"].iloc[0])
        lo, hi = part["_b0"].to_numpy(np.int64) + 1 - first, part["_b1"].to_numpy(np.int64) - 1 - first
        out = part[[*keys, "_qid"]].copy()
        out["low"] = range_extremes(ext["_mn"].to_numpy(float), lo, hi)[0]
        out["high"] = range_extremes(ext["_mx"].to_numpy(float), lo, hi)[1]
        return out

    wide = _chunked(q.filter("_b1 > _b0 + 1").select(*keys, "_qid", "_b0", "_b1"), Series(s.keys, ("_qid",)))
    middle = _meet(wide, extremes, keys, between, ddl)
    out = ends.unionByName(middle).groupBy(*keys, "_qid").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return out.withColumnRenamed("_qid", qid)
