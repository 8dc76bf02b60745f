"""Recursive per-key operators: one step function, run over sorted rows in batch and in streams.

``step(rows, state) -> (out, state)`` takes one key's next rows in order (a pandas frame) and the state
left by the rows before (None at the start). States are small picklable values.

Small or calendar-bounded keys run as one group each. Larger keys are cut into blocks of consecutive
rows. Every block first runs from the start state; then blocks whose true start (the end of the block
before) differs from the one they used run again, in parallel, until none is left. State machines forget
quickly, so this takes a couple of rounds. States that agree to 13 significant digits count as the same, so discrete
states are those of the sequential fold, and real ones differ from it by no more than such a difference does.

Steps that are heavy per row may name how many rows they mostly need to forget their start (``warm``). A block then starts
from what the step makes of so many rows ahead of it, and its rows are written as they come. Blocks whose start differs
from the end of the block before run again as above; where none does, each row was worked on once.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from dataclasses import replace
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.plans.series import HEAVY_SMALL_MB, Series, join_on_keys, with_blocks
from tidemark.plans.sizing import is_small
from tidemark.session import checkpointed, written

Step = Callable[[pd.DataFrame, Any], tuple[pd.DataFrame, Any]]

# warm starts and ends count as the same where no number differs by more than this part of it, or by TINY
ALIKE = 1e-13
TINY = 1e-300


def _rounded(value: Any) -> Any:
    """States are compared to 13 significant digits, below the noise of the arithmetic itself."""
    if isinstance(value, float):
        return float(f"{value:.13g}")
    if isinstance(value, (list, tuple)):
        return tuple(_rounded(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, _rounded(v)) for k, v in value.items()))
    if hasattr(value, "tolist"):
        return _rounded(value.tolist())
    return value


def _digest(blob: bytes | None) -> str:
    return "" if blob is None else repr(_rounded(pickle.loads(blob)))


def _same(a: Any, b: Any) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (a != a and b != b) or abs(a - b) <= ALIKE * max(abs(a), abs(b)) + TINY
    if isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)):
        return len(a) == len(b) and all(map(_same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(v, b[k]) for k, v in a.items())
    return a == b


def _differ(a: bytes | None, b: bytes | None) -> bool:
    return a is not b if a is None or b is None else a != b and not _same(pickle.loads(a), pickle.loads(b))


def fold(df: DataFrame, s: Series, step: Step, schema: str, rows: int | None = None, warm: int = 0) -> DataFrame:
    """Apply ``step`` along each key; ``schema`` is the DDL of the rows it returns. ``rows`` bounds the blocks of a long
    key, for steps that are heavy per row, which are cut from a smaller input on. With ``warm`` its blocks start from that
    many rows ahead of them."""
    order = list(s.order)
    if s.bounded or is_small(df, HEAVY_SMALL_MB if warm else None):
        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            return step(pdf.sort_values(order, kind="stable", ignore_index=True), None)[0]

        return df.groupBy(*s.keys).applyInPandas(whole, schema)

    if warm:
        return _fold_warm(df, s, step, schema, rows, warm)
    blocks = with_blocks(df, s, most=rows).drop("_own", "_halo")
    if not s.long and (blocks.agg(F.max("_blk")).first()[0] or 0) == 0:
        def single(pdf: pd.DataFrame) -> pd.DataFrame:
            return step(pdf.sort_values("_pos", ignore_index=True), None)[0]

        return blocks.groupBy(*s.keys).applyInPandas(single, schema)
    return _fold_blocks(checkpointed(blocks), s, step, schema)


def _fold_blocks(blocks: DataFrame, s: Series, step: Step, schema: str) -> DataFrame:
    cols = [*s.keys, "_blk"]
    key_ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.schema if f.name in cols)
    link_ddl = f"{key_ddl}, _used binary, _end binary"

    def link(rows: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        used = starts["_start"].iloc[0] if len(starts) else None
        state = None if used is None else pickle.loads(used)
        _, end = step(rows.sort_values("_pos", ignore_index=True), state)
        head = {c: [rows[c].iloc[0]] for c in cols}
        return pd.DataFrame({**head, "_used": [used], "_end": [pickle.dumps(end)]})

    digest = F.udf(_digest, "string")
    none = blocks.select(*cols).limit(0).withColumn("_start", F.lit(None).cast("binary"))
    run = lambda rows, starts: (
        rows.groupBy(*cols).cogroup(starts.groupBy(*cols)).applyInPandas(link, link_ddl)
    )
    links = checkpointed(run(blocks, none))
    while True:
        starts = links.select(*s.keys, (F.col("_blk") + 1).alias("_blk"), F.col("_end").alias("_start"))
        wrong = (
            join_on_keys(links.select(*cols, "_used"), starts, cols)
            .filter(digest("_used") != digest("_start"))
            .select(*cols, "_start")
        )
        wrong = checkpointed(wrong)
        if wrong.isEmpty():
            break
        again = run(join_on_keys(blocks, wrong.select(*cols), cols, "left_semi"), wrong)
        links = checkpointed(join_on_keys(links, wrong, cols, "left_anti").unionByName(again))

    def emit(rows: pd.DataFrame, begin: pd.DataFrame) -> pd.DataFrame:
        state = pickle.loads(begin["_start"].iloc[0]) if len(begin) else None
        return step(rows.sort_values("_pos", ignore_index=True), state)[0]

    starts = join_on_keys(starts, links.select(*cols), cols, "left_semi")  # the last block of a key starts nothing
    return blocks.groupBy(*cols).cogroup(starts.groupBy(*cols)).applyInPandas(emit, schema)


def _fold_warm(df: DataFrame, s: Series, step: Step, schema: str, rows: int | None, warm: int) -> DataFrame:
    cols = [*s.keys, "_blk"]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    marks = {k: f"_key{i}" for i, k in enumerate(s.keys)}  # the step need not return its keys
    ddl = f"{schema}, {', '.join(f'{m} {kinds[k]}' for k, m in marks.items())}, _blk bigint, _used binary, _end binary"
    # rows that tie in the order are told apart by their other columns, so that blocks are the same whenever they are made
    rest = [f.name for f in df.schema if f.name not in {*s.keys, *s.order} and not isinstance(f.dataType, T.MapType)]
    blocks = with_blocks(df, replace(s, order=(*s.order, *rest)), before=warm, most=rows).drop("_own")

    def run(pdf: pd.DataFrame, used: bytes | None) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos", ignore_index=True)
        ahead, own = pdf[pdf["_halo"]], pdf[~pdf["_halo"]].reset_index(drop=True)
        if own.empty:  # behind the last row of a key
            return pd.DataFrame()
        if used is None and len(ahead):
            used = pickle.dumps(step(ahead, None)[1])
        out, end = step(own, None if used is None else pickle.loads(used))
        nothing = [None] * (len(out) - 1)
        return out.assign(**{m: own[k].iloc[0] for k, m in marks.items()}, _blk=own["_blk"].iloc[0], _used=[*nothing, used], _end=[*nothing, pickle.dumps(end)])

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        return run(pdf, None)

    def again(pdf: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        return run(pdf, starts["_start"].iloc[0])

    def ends(done: DataFrame, turn: int) -> DataFrame:
        found = done.filter(F.col("_end").isNotNull())
        return found.select(*[F.col(m).alias(k) for k, m in marks.items()], "_blk", F.lit(turn).alias("_turn"), "_used", "_end")

    # blocks are dealt out by number: few large ones would else share tasks, as their bytes say nothing of their work
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if rows is not None:
        parts = max(parts, 4 * df.count() // rows)
    differ = F.udf(_differ, "boolean")
    turns = [written(blocks.repartition(parts, *cols).groupBy(*cols).applyInPandas(first, ddl))]
    links = checkpointed(ends(turns[0], 0))
    while True:
        starts = links.select(*s.keys, (F.col("_blk") + 1).alias("_blk"), F.col("_end").alias("_start"))
        wrong = checkpointed(join_on_keys(links.select(*cols, "_used"), starts, cols).filter(differ("_used", "_start")).select(*cols, "_start"))
        if wrong.isEmpty():
            break
        redone = join_on_keys(blocks, wrong.select(*cols), cols, "left_semi").groupBy(*cols).cogroup(wrong.groupBy(*cols)).applyInPandas(again, ddl)
        turns.append(written(redone))
        links = checkpointed(join_on_keys(links, wrong.select(*cols), cols, "left_anti").unionByName(ends(turns[-1], len(turns) - 1)))
    kept = [c for c in turns[0].columns if c not in {*marks.values(), "_blk", "_used", "_end"}]
    if len(turns) == 1:
        return turns[0].select(*kept)
    every = reduce(DataFrame.unionByName, [t.withColumn("_turn", F.lit(i)) for i, t in enumerate(turns)])
    last = links.select(*[F.col(k).alias(m) for k, m in marks.items()], "_blk", "_turn")
    return join_on_keys(every, last, [*marks.values(), "_blk", "_turn"], "left_semi").select(*kept)
