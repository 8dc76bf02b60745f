"""Purged cross-validation splits over a time axis."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.ranking import merge_intervals
from tidemark.plans.series import Series

HOUR_US = 3_600_000_000
SIZES, OFFSETS = 5, 8


def time_bounds(df: DataFrame, ts: str = "ts") -> DataFrame:
    """One row: first and last time in microseconds and their distance. Read once, as two numbers, so that
    the split tables built on it never scan the data again."""
    t0, t1 = df.agg(F.unix_micros(F.min(ts).cast("timestamp")), F.unix_micros(F.max(ts).cast("timestamp"))).first()
    one = df.sparkSession.range(1).select(F.lit(t0).cast("long").alias("t0"), F.lit(t1).cast("long").alias("t1"))
    return one.withColumn("span", (F.col("t1") - F.col("t0")).cast("double"))


def _at(micros: Column) -> Column:
    return F.timestamp_micros(F.floor(micros).cast("long"))


def test_periods(bounds: DataFrame, n: int = 10, size: float = 0.2) -> DataFrame:
    """n test periods spread evenly over the middle 80 % of the time axis."""
    ids = bounds.sparkSession.range(n).select(F.col("id").cast("long").alias("split_id"))
    d = ids.crossJoin(F.broadcast(bounds))
    room = F.col("span") * (0.8 - size)
    start = F.col("t0") + F.col("span") * 0.1 + room * F.col("split_id") / F.lit(float(n))
    return d.filter(room > 0).select("split_id", _at(start).alias("start"), _at(start + F.col("span") * size).alias("end"))


def candidate_periods(bounds: DataFrame) -> DataFrame:
    """Training candidates: five sizes from 10 % to 40 % of the axis at eight offsets each, numbered by time."""
    spark = bounds.sparkSession
    grid = spark.range(SIZES).select(F.col("id").alias("size_id")).crossJoin(spark.range(OFFSETS).select(F.col("id").alias("offset_id")))
    d = grid.crossJoin(F.broadcast(bounds))
    length = F.col("span") * (0.1 + 0.3 * F.col("size_id") / (SIZES - 1.0))
    start = F.col("t0") + (F.col("span") - length) * F.col("offset_id") / float(OFFSETS)
    d = d.select("size_id", "offset_id", _at(start).alias("start"), _at(start + length).alias("end"), F.col("span"))
    return d.withColumn("candidate", F.row_number().over(Window.orderBy("start", "end")).cast("long"))  # forty rows


def embargo_filter(candidates: DataFrame, tests: DataFrame, embargo_h: float = 24.0) -> DataFrame:
    """Candidates of each split that lie wholly outside its test period widened by the embargo."""
    gap = F.expr(f"make_dt_interval(0, 0, 0, {embargo_h * 3600})")
    t = tests.select("split_id", (F.col("start") - gap).alias("_lo"), (F.col("end") + gap).alias("_hi"))
    outside = (F.col("end") < F.col("_lo")) | (F.col("start") > F.col("_hi"))
    return candidates.join(F.broadcast(t), outside).drop("_lo", "_hi")


def select_periods(valid: DataFrame, low: float = 0.5, high: float = 0.7, max_periods: int = 8) -> DataFrame:
    """Best set of up to ``max_periods`` candidates per split: 0.7 closeness to the target duration plus
    0.3 coverage (shorter gaps between consecutive periods).

    Exact without listing every set: for a given last period, count and total length only the smallest
    gap can win, and lengths come in few steps, so each round keeps one row per such state.
    """
    us = F.unix_micros
    c = valid.select("split_id", F.col("candidate").alias("idx"), F.col("size_id").alias("step"), us("start").alias("s"), us("end").alias("e"), "span")
    # split chains of joins stay small: at most 40 periods x 33 length steps per split and round
    states = c.select("split_id", "span", F.col("idx").alias("last"), F.col("e").alias("last_end"), F.lit(1).alias("n"), F.col("step").alias("steps"),
                      (F.col("e") - F.col("s")).alias("length"), F.lit(0).cast("long").alias("gap"), F.array("idx").alias("path"))
    first, every = states, states
    for _ in range(max_periods - 1):  # states of up to k periods -> states of up to k + 1
        nxt = every.join(c.select("split_id", "idx", "step", "s", "e"), "split_id").filter(F.col("idx") > F.col("last"))
        gap = F.col("gap") + F.greatest(F.col("s") - F.col("last_end"), F.lit(0))
        best = F.min(F.struct(gap.alias("gap"), F.concat("path", F.array("idx")).alias("path"), (F.col("length") + F.col("e") - F.col("s")).alias("length"), F.col("e").alias("last_end"), F.col("span").alias("span")))
        grown = nxt.groupBy("split_id", F.col("idx").alias("last"), (F.col("n") + 1).alias("n"), (F.col("steps") + F.col("step")).alias("steps")).agg(best.alias("b"))
        every = first.unionByName(grown.select("split_id", "b.span", "last", "b.last_end", "n", "steps", "b.length", "b.gap", "b.path"))
    target = F.col("span") * (low + high) / 2
    closeness = 1 - F.abs(F.col("length") - target) / target
    coverage = 1 / (1 + F.col("gap") / F.col("length"))
    score = F.round(0.7 * closeness + 0.3 * coverage, 9)
    rank = F.struct(F.col("_score"), (-F.col("n")).alias("_n"), F.transform("path", lambda x: -x).alias("_p"))
    best = every.withColumn("_score", score).groupBy("split_id").agg(F.max(rank).alias("b"))
    chosen = best.select("split_id", F.col("b._score").alias("score"), F.explode(F.transform("b._p", lambda x: -x)).alias("candidate"))
    return chosen.join(valid.select("split_id", "candidate", "start", "end"), ["split_id", "candidate"])


def purge_periods(train: DataFrame, tests: DataFrame, purge_h: float = 12.0) -> DataFrame:
    """Merged purge intervals per split: around the test period, and beside each training period."""
    gap = F.expr(f"make_dt_interval(0, 0, 0, {purge_h * 3600})")
    t = tests.select("split_id", F.col("start").alias("ts0"), F.col("end").alias("ts1"))
    around = t.select("split_id", (F.col("ts0") - gap).alias("start"), (F.col("ts1") + gap).alias("end"))
    d = train.select("split_id", "start", "end").join(F.broadcast(t), "split_id")
    after = d.filter(F.col("end") < F.col("ts0")).select("split_id", F.col("end").alias("start"), F.least(F.col("end") + gap, F.col("ts0")).alias("end"))
    before = d.filter(F.col("start") > F.col("ts1")).select("split_id", F.greatest(F.col("start") - gap, F.col("ts1")).alias("start"), F.col("start").alias("end"))
    pieces = around.unionByName(after.filter("end > start")).unionByName(before.filter("end > start"))
    return merge_intervals(pieces, Series(("split_id",), ("start", "end"), bounded=True))


def interval_table(train: DataFrame, tests: DataFrame, purged: DataFrame | None = None) -> DataFrame:
    """All intervals of the splits: split_id, role, start, end."""
    parts = [(train, "train"), (tests, "test")] + ([(purged, "purged")] if purged is not None else [])
    out = None
    for d, role in parts:
        one = d.select("split_id", F.lit(role).alias("role"), "start", "end")
        out = one if out is None else out.unionByName(one)
    return out


def flag_rows(df: DataFrame, intervals: DataFrame, ts: str = "ts") -> DataFrame:
    """Each row once per split with train / test / purged flags, without shuffling rows: the split table
    (a few dozen intervals) rides along as one small array. Purging takes rows out of training only."""
    per = intervals.groupBy("split_id").agg(F.collect_list(F.struct("role", "start", "end")).alias("iv"))
    table = per.agg(F.collect_list(F.struct("split_id", "iv")).alias("_splits"))
    d = df.crossJoin(F.broadcast(table)).withColumn("_s", F.explode("_splits")).drop("_splits")
    at = F.col(ts)

    def inside(role: str) -> Column:
        return F.exists("_s.iv", lambda v: (v["role"] == role) & (at >= v["start"]) & (at <= v["end"]))

    d = d.withColumns({"split_id": F.col("_s.split_id"), "is_test": inside("test"), "is_purged": inside("purged"), "_tr": inside("train")})
    return d.withColumn("is_train", F.col("_tr") & ~F.col("is_purged")).drop("_s")


def validate_splits(flags: DataFrame) -> DataFrame:
    """Sizes and overlaps per split, from flagged rows, in one aggregation."""
    n = lambda c: F.count_if(c)
    d = flags.groupBy("split_id").agg(
        n(F.col("is_train")).alias("train_size"), n(F.col("is_test")).alias("test_size"), n(F.col("is_purged")).alias("purged_size"),
        F.bool_or(F.col("is_train") & F.col("is_test")).alias("train_test_overlap"),
        F.bool_or(F.col("is_train") & F.col("is_purged")).alias("train_purged_overlap"),
        F.bool_or(F.col("_tr") & F.col("is_test")).alias("leakage"),
    )
    return d.withColumn("valid", ~F.col("train_test_overlap") & ~F.col("train_purged_overlap"))


def coverage(flags: DataFrame, key: str) -> DataFrame:
    """Share of rows in training, in test, in either and in both, over all splits. The flags of one row
    meet inside its own row group, so the aggregation combines before the shuffle."""
    per = flags.groupBy(key).agg(F.bool_or("is_train").alias("tr"), F.bool_or("is_test").alias("te"))
    pct = lambda c: 100.0 * F.count_if(c) / F.count(F.lit(1))
    return per.agg(pct(F.col("tr")).alias("train"), pct(F.col("te")).alias("test"), pct(F.col("tr") | F.col("te")).alias("either"), pct(F.col("tr") & F.col("te")).alias("both"))


def run_splits(df: DataFrame, intervals: DataFrame, metric_fn: Callable[[DataFrame], DataFrame], ts: str = "ts") -> DataFrame:
    """Evaluate every split in one job: rows of each test period, then ``metric_fn`` keyed by split_id."""
    return metric_fn(flag_rows(df, intervals, ts).filter("is_test"))
