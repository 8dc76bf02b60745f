"""Event-time timers and entries in state: the same results for any micro-batches, and a state that shrinks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import states as ST
from tidemark.sources.files import scratch
from tidemark.streaming import kept, timers, windows

START = dt.datetime(2024, 1, 1)


def stream_of(spark, rows, schema, batches, delay="1 second"):
    """Rows as a file stream of so many micro-batches, in time order."""
    path = scratch(spark, "rows")
    rows = sorted(rows, key=lambda r: r[1])
    size = -(-len(rows) // batches)
    for k in range(0, len(rows), size):
        spark.createDataFrame(rows[k : k + size], schema).coalesce(1).write.mode("append").parquet(path)
    kinds = spark.read.parquet(path).schema
    return windows.watermarked(spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(path), delay)


def run(spark, df):
    """Collected rows, and entries in the state store after the last micro-batch."""
    name = "t" + scratch(spark, "q").rsplit("/", 1)[-1].replace("-", "_")
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", scratch(spark, "progress")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect(), [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


@pytest.mark.parametrize("batches", [1, 3, 9])
def test_lifecycle_timeouts_fire_without_a_row(spark, batches):
    rows = [("a", at(0), 1, "entry_signal"), ("b", at(1), 2, "entry_signal"), ("b", at(2), 3, "position_entered"), ("c", at(3), 4, "entry_signal"),
            ("c", at(303), 5, "position_entered"), ("a", at(500), 6, "reset"), ("d", at(700), 7, "pause"), ("d", at(90_000), 8, "resume"), ("e", at(200_000), 9, "entry_signal")]
    df = stream_of(spark, rows, "symbol string, ts timestamp, seq long, trigger string", batches)
    got, state = run(spark, timers.timed_fold(df, ["symbol"], timers.Lifecycle()))
    got = sorted((r.symbol, (r.ts - START).total_seconds(), r.seq, r.state, r.transition) for r in got)
    want = [("a", 0, 1, "ENTERING", "entry_signal"), ("a", 300, None, "ERROR", "entry_timeout"), ("a", 500, 6, "SEARCHING", "reset"),
            ("b", 1, 2, "ENTERING", "entry_signal"), ("b", 2, 3, "IN_POSITION", "position_entered"), ("b", 86_402, None, "EXITING", "position_timeout"), ("b", 86_702, None, "ERROR", "exit_timeout"),
            ("c", 3, 4, "ENTERING", "entry_signal"), ("c", 303, 5, "IN_POSITION", "position_entered"), ("c", 86_703, None, "EXITING", "position_timeout"), ("c", 87_003, None, "ERROR", "exit_timeout"),
            ("d", 700, 7, "PAUSED", "pause"), ("d", 90_000, 8, "SEARCHING", "resume"), ("e", 200_000, 9, "ENTERING", "entry_signal")]
    assert got == want


@pytest.mark.parametrize("batches", [1, 4])
def test_a_halt_is_released_at_its_longest_time(spark, batches):
    rows = [("a", at(0), 1, 0.95), ("b", at(10), 2, 0.2), ("b", at(20_000), 3, 0.2), ("b", at(40_000), 4, 0.1)]
    df = stream_of(spark, rows, "symbol string, ts timestamp, seq long, probability double", batches).withColumn("recent_std", F.lit(1.0))
    got, _ = run(spark, timers.timed_fold(df, ["symbol"], timers.Breaker()))
    a = sorted(((r.ts - START).total_seconds(), r.seq, r.state, r.event) for r in got if r.symbol == "a")
    assert a == [(0, 1, "HALT", "halt"), (ST.BREAKER["max_halt"], None, "RECOVERY", "forced_release")]


def test_entries_leave_the_state_of_silent_keys(spark):
    rows = [(f"k{i}", at(i), i, "view" if i % 2 else "click", float(i)) for i in range(40)]
    rows += [("late", at(10_000 + 100 * i), 100 + i, "view", 1.0) for i in range(4)]
    df = stream_of(spark, rows, "symbol string, ts timestamp, seq long, channel string, price double", 4)
    got, state = run(spark, kept.kept_entries(df, ["symbol"], kept.Latest("channel", "price", ["view"]), 60.0))
    assert len(got) == 24 and max(state) > 30 and state[-1] <= 4, state


@pytest.mark.parametrize("batches", [1, 5])
def test_book_levels_expire(spark, batches):
    rows = [("s", at(0), 1, "bid", 10.0, 1.0), ("s", at(5), 2, "bid", 9.0, 1.0), ("s", at(8), 3, "ask", 12.0, 2.0), ("s", at(11), 4, "ask", 11.0, 1.0), ("s", at(12), 5, "ask", 11.0, 0.0), ("s", at(30), 6, "bid", 1.0, 1.0)]
    df = stream_of(spark, rows, "symbol string, ts timestamp, seq long, side string, price double, quantity double", batches)
    got, _ = run(spark, kept.kept_entries(df, ["symbol"], kept.Book(), 10.0))
    want = [(1, 10.0, None, 1, 0), (2, 10.0, None, 2, 0), (3, 10.0, 12.0, 2, 1), (4, 9.0, 11.0, 1, 2), (5, 9.0, 12.0, 1, 1), (6, 1.0, None, 1, 0)]
    assert sorted((r.seq, r.best_bid, r.best_ask, r.n_bids, r.n_asks) for r in got) == want


def test_late_rows_read_one_row_of_the_past(spark):
    rows = [("s", at(100 * i), i) for i in range(20)] + [("s", at(5), 50)]
    path = scratch(spark, "rows")
    for k in range(0, 21, 3):
        spark.createDataFrame(rows[k : k + 3], "symbol string, ts timestamp, seq long").coalesce(1).write.mode("append").parquet(path)
    on, late, progress = (scratch(spark, x) for x in ("on", "late", "progress"))
    stream = spark.readStream.schema("symbol string, ts timestamp, seq long").option("maxFilesPerTrigger", 1).parquet(path)
    windows.split_late(stream, on, late, progress, "10 minutes")
    assert [r.seq for r in spark.read.parquet(late).collect()] == [50] and spark.read.parquet(on).count() == 20
    assert all(r["n"] == 1 for r in spark.read.parquet(f"{progress}-newest").groupBy("batch").agg(F.count("*").alias("n")).collect())


def test_alerts_fire_after_their_hold_time(spark, layout):
    from tidemark.operators.policy import alert_runs

    rows = [("a", "cpu_usage_percent", at(60 * i), i, v) for i, v in enumerate([90, 91, 92, 93, 94, 95, 96, 10, 99, 99, 5, None, 85, 81])]
    rows += [("a", "trading_halted", at(0), 1, 1.0), ("a", "trading_halted", at(0), 2, 0.0), ("a", "trading_halted", at(0), 3, 1.0), (None, "service_up", at(0), 1, 0.0), (None, "service_up", at(30), 2, 0.0), ("a", "unknown", at(0), 1, 1.0)]
    frame = spark.createDataFrame([(k, m, t, i, None if v is None else float(v)) for k, m, t, i, v in rows], "symbol string, metric string, ts timestamp, seq long, value double")
    seconds = lambda t: None if t is None else (t - START).total_seconds()
    got = sorted(((r.symbol, r.alert, seconds(r.started_at), seconds(r.fired_at), seconds(r.resolved_at)) for r in alert_runs(frame, ["symbol"]).collect()), key=str)
    assert got == sorted([("a", "HighCPUUsage", 0, 300, 420), ("a", "TradingHalted", 0, 0, 0), ("a", "TradingHalted", 0, 0, None), (None, "ServiceDown", 0, 30, None)], key=str)
    assert alert_runs(frame.limit(0), ["symbol"]).count() == 0
