"""Streaming queries (S7, S8, X1-X9 and folds over streams)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.base import query, r, rs, shaped, sql
from tidemark.catalog.recursive import BREAKER, KALMAN, NUM, TRIGGERS
from tidemark.operators import states as ST
from tidemark.sources import views as V
from tidemark.sources.files import scratch
from tidemark.streaming import kept as K
from tidemark.streaming import stateful as T
from tidemark.streaming import timers as E
from tidemark.streaming import topics as P
from tidemark.streaming import windows as W

TICK = "symbol string, ts timestamp, seq bigint, price double, channel string"
CUTS = ("2024-01-11", "2024-01-21")
DAY = 86_400.0
# files that each piece of a topic lands in at least, and that one micro-batch reads; rows of a file beyond that; rows of a
# key in a piece
FILES = 4
FILE_ROWS = 250_000
PIECE = 1_000_000


def _cuts(t, key):
    """Times that cut the table into slices of about equal size, three at least and as many as keep the rows of a key in a
    slice bounded; files of a slice. A key costs a call per slice, so slices do not grow in number with the keys."""
    rows, longest = t.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.max("n")).first()
    n = max(3, -(-longest // PIECE))
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = t.select(at.cast("double").alias("at")).approxQuantile("at", [i / n for i in range(1, n)], 0.1 / n)
    return [int(c) for c in cuts], max(FILES, -(-rows // (n * FILE_ROWS)))


def _topic(spark, sf, key="symbol"):
    """Ticks as a file topic, landed in time-ordered pieces, as many as the table needs, and the files of a piece. The table
    is read once into its pieces, and each piece once into the topic."""
    path = scratch(spark, "topic")
    t = V.ticks(spark, sf).select("symbol", "ts", "seq", "price", "channel")
    if not t.head(1):
        return path, FILES
    cuts, files = _cuts(t, key)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    staged = scratch(spark, "pieces")
    piece = sum((F.when(at >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    t.filter(at.isNotNull()).withColumn("piece", piece).write.partitionBy("piece").parquet(staged)
    pieces = spark.read.schema("symbol string, ts timestamp, seq bigint, price double, channel string, piece int").parquet(staged)
    for number in range(len(cuts) + 1):
        P.land_messages(pieces.filter(F.col("piece") == number).drop("piece").repartition(files), path, key)
    return path, files


def _stream(spark, sf):
    path, files = _topic(spark, sf)
    return P.read_topic(spark, path, TICK, files_per_trigger=files)


def _table(spark, stream, mode="append"):
    path = scratch(spark, "table")
    P.run_to_table(stream, path, scratch(spark, "progress"), mode)
    return spark.read.parquet(path)


@query("s07_read_topic", sql("ticks", f"SELECT symbol AS key, symbol, seq, channel, {r('price')} AS price FROM ticks"))
def read_topic(spark, sf):
    return shaped(_table(spark, _stream(spark, sf)), columns="key symbol seq channel price")


@query("s08_write_topic", sql("ticks", f"SELECT channel AS key, seq, {r('price')} AS price FROM ticks"))
def write_topic(spark, sf):
    out = scratch(spark, "out")
    P.write_topic(_stream(spark, sf).drop("key"), out, "channel", scratch(spark, "progress"))
    d = spark.read.schema("key string, value string").json(out).withColumn("m", F.from_json("value", TICK))
    return shaped(d.select("key", "m.seq", "m.price"))


@query("x01_late_rows", sql("ticks", "SELECT CASE WHEN seq % 10 = 0 AND ts < TIMESTAMP '2024-01-11' - INTERVAL 1 DAY THEN true ELSE false END AS late, count(*) AS n FROM ticks GROUP BY 1"))
def late_rows(spark, sf):
    """A tenth of the rows of the first piece arrive after the rest; rows a day behind go to the side table."""
    path = scratch(spark, "topic")
    t = V.ticks(spark, sf).select("symbol", "ts", "seq", "price", "channel")
    early, straggler = F.col("ts") < F.lit(CUTS[0]).cast("timestamp"), F.col("seq") % 10 == 0
    P.land_messages(t.filter(early & ~straggler).repartition(FILES), path, "symbol")
    P.land_messages(t.filter(early & straggler).repartition(FILES), path, "symbol")
    P.land_messages(t.filter(~early).repartition(FILES), path, "symbol")
    on, late = scratch(spark, "on"), scratch(spark, "late")
    W.split_late(P.read_topic(spark, path, TICK, files_per_trigger=FILES), on, late, scratch(spark, "progress"), "1 day")
    n = lambda p, flag: spark.read.parquet(p).agg(F.lit(flag).alias("late"), F.count(F.lit(1)).alias("n"))
    return n(on, False).unionByName(n(late, True))


@query("x02_tumbling_windows", sql("ticks", f"SELECT channel, time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP AS window_start, count(*) AS n, {r('sum(price)')} AS total FROM ticks GROUP BY 1, 2"))
def tumbling(spark, sf):
    d = W.windowed_totals(W.watermarked(_stream(spark, sf)), "channel", "price", "1 hour")
    return shaped(P.latest_rows(_table(spark, d, "update"), ["channel", "window_start"]))


@query("x03_sliding_windows", sql("ticks", f"""SELECT channel, time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP - k * INTERVAL 1 HOUR AS window_start, count(*) AS n, {r('sum(price)')} AS total FROM ticks, (SELECT unnest([0, 1, 2, 3, 4, 5]) AS k) GROUP BY 1, 2"""))
def sliding(spark, sf):
    d = W.windowed_totals(W.watermarked(_stream(spark, sf), "12 hours"), "channel", "price", "6 hours", "1 hour")
    return shaped(P.latest_rows(_table(spark, d, "update"), ["channel", "window_start"]))


@query("x04_session_windows", sql("ticks", """WITH m AS (SELECT max(ts) AS newest FROM ticks), a AS (SELECT *, lag(ts) OVER (PARTITION BY channel ORDER BY ts, seq) AS p FROM ticks),
s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS sid FROM a)
SELECT channel, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s, m GROUP BY channel, sid HAVING max(ts) + INTERVAL 30 MINUTE <= max(newest) - INTERVAL 10 MINUTE"""))
def sessions(spark, sf):
    return shaped(_table(spark, W.session_totals(W.watermarked(_stream(spark, sf)), "channel", "30 minutes")).drop("batch"))


@query("x05_stream_stream_join", sql("ticks", "SELECT l.symbol AS l_symbol, l.seq AS l_seq, r.seq AS r_seq FROM ticks l JOIN ticks r ON l.symbol = r.symbol AND l.channel = 'view' AND r.channel = 'click' AND r.ts BETWEEN l.ts AND l.ts + INTERVAL 6 HOUR"))
def stream_join(spark, sf):
    path, files = _topic(spark, sf)
    side = lambda c: W.watermarked(P.read_topic(spark, path, TICK, files_per_trigger=files).filter(F.col("channel") == c).select("symbol", "ts", "seq"), "1 hour")
    return _table(spark, W.interval_stream_join(side("view"), side("click"), "symbol", "6 hours")).select("l_symbol", "l_seq", "r_seq")


@query("x06_latest_with_ttl", sql("ticks", f"""WITH s AS (SELECT symbol, ts, seq, {", ".join(f"last_value(CASE WHEN channel = '{n}' THEN price END IGNORE NULLS) OVER q AS {n}, last_value(CASE WHEN channel = '{n}' THEN ts END IGNORE NULLS) OVER q AS t_{n}" for n in ("view", "click"))}
 FROM ticks WINDOW q AS (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)) SELECT symbol, seq, {rs('view click')} FROM s WHERE ts - t_view <= INTERVAL 2 DAY AND ts - t_click <= INTERVAL 2 DAY"""))
def latest_with_ttl(spark, sf):
    d = W.watermarked(_stream(spark, sf).drop("key"))
    return shaped(_table(spark, K.kept_entries(d, ["symbol"], K.Latest("channel", "price", ["view", "click"]), 2 * DAY)), columns="symbol seq view click")


@query("x07_restart_from_checkpoint", sql("ticks", f"SELECT symbol, seq, {r('price')} AS price FROM ticks"))
def restart(spark, sf):
    """The query stops after the first piece and goes on from its checkpoint when more arrives."""
    path, out, progress = scratch(spark, "topic"), scratch(spark, "table"), scratch(spark, "progress")
    t = V.ticks(spark, sf).select("symbol", "ts", "seq", "price", "channel")
    early = F.col("ts") < F.lit(CUTS[0]).cast("timestamp")
    for part in (t.filter(early), t.filter(~early)):
        P.land_messages(part.repartition(FILES), path, "symbol")
        P.run_to_table(P.read_topic(spark, path, TICK), out, progress)
    return shaped(spark.read.parquet(out), columns="symbol seq price")


@query("x08_kalman_stream", sql("ticks", f"WITH RECURSIVE {NUM}, {KALMAN} SELECT o.symbol, o.seq, {r('m')} AS hedge_ratio, {r('1.96 * sqrt(p11)')} AS half_width FROM o JOIN kr USING (symbol, k)"))
def kalman_stream(spark, sf):
    step = ST.kalman_step("z", ["symbol", "seq"])
    d = _stream(spark, sf).select("symbol", "ts", "seq", (F.col("price") / 50).alias("z"))
    out = T.stream_fold(d, ["symbol"], ["ts", "seq"], step, f"symbol string, seq bigint, {ST.KALMAN_SCHEMA}")
    return shaped(_table(spark, out), columns="symbol seq hedge_ratio half_width")


@query("x09_book_stream", sql("ticks", """WITH u AS (SELECT symbol, ts, seq, CASE WHEN channel IN ('view', 'click') THEN 'bid' ELSE 'ask' END AS side, floor(price / 20) AS price, CASE WHEN seq % 4 = 0 THEN 0 ELSE 1 END AS q FROM ticks),
e AS (SELECT *, lead(ts) OVER (PARTITION BY symbol, side, price ORDER BY ts, seq) AS until FROM u),
g AS (SELECT t.symbol, t.seq, max(e.price) FILTER (e.side = 'bid') AS best_bid, min(e.price) FILTER (e.side = 'ask') AS best_ask,
 count(e.price) FILTER (e.side = 'bid') AS n_bids, count(e.price) FILTER (e.side = 'ask') AS n_asks
 FROM u t LEFT JOIN e ON e.symbol = t.symbol AND e.ts <= t.ts AND (e.until IS NULL OR e.until > t.ts) AND e.q > 0 AND t.ts - e.ts <= INTERVAL 5 DAY GROUP BY 1, 2)
SELECT symbol, seq, best_bid, best_ask, n_bids, n_asks FROM g"""))
def book_stream(spark, sf):
    """Levels that nothing has touched for five days leave the book."""
    d = _stream(spark, sf).select("symbol", "ts", "seq", F.when(F.col("channel").isin("view", "click"), "bid").otherwise("ask").alias("side"),
                                  F.floor(F.col("price") / 20).cast("double").alias("price"), F.when(F.col("seq") % 4 == 0, 0.0).otherwise(1.0).alias("quantity"))
    return shaped(_table(spark, K.kept_entries(W.watermarked(d), ["symbol"], K.Book(), 5 * DAY)), columns="symbol seq best_bid best_ask n_bids n_asks")


# rows at deadlines have no seq; what happens at the end of the stream is what the last watermark allows
DELAY = "INTERVAL 10 MINUTE"


def _timed(spark, sf, machine, **columns):
    d = W.watermarked(_stream(spark, sf).select("symbol", "ts", "seq", *[c.alias(n) for n, c in columns.items()]))
    return _table(spark, E.timed_fold(d, ["symbol"], machine)).drop("batch")


LIFE_TIMED = f"""n AS (SELECT symbol, seq, channel, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS k FROM ticks
 UNION ALL SELECT symbol, NULL, NULL, any_value(w), count(*) + 1 FROM ticks, (SELECT epoch_us(max(ts) - {DELAY}) / 1e6 + 1e-7 AS w FROM ticks) GROUP BY symbol),
f AS (SELECT symbol, 0::BIGINT AS k, 'SEARCHING' AS mode, NULL::DOUBLE AS since, NULL::DOUBLE AS entered, NULL::DOUBLE AS d1, NULL::DOUBLE AS d2, NULL::VARCHAR AS first_timeout, false AS moved FROM (SELECT DISTINCT symbol FROM n)
 UNION ALL SELECT symbol, k, CASE WHEN moved THEN target ELSE m END, CASE WHEN moved THEN t ELSE s END, CASE WHEN moved AND channel = 'click' THEN t ELSE entered END, d1, d2, first_timeout, moved FROM (
 SELECT *, CASE channel WHEN 'view' THEN m = 'SEARCHING' WHEN 'click' THEN m = 'ENTERING' WHEN 'purchase' THEN m = 'IN_POSITION' WHEN 'signup' THEN m = 'EXITING' WHEN 'error' THEN m = 'ERROR' ELSE false END AS moved,
  CASE channel WHEN 'view' THEN 'ENTERING' WHEN 'click' THEN 'IN_POSITION' WHEN 'purchase' THEN 'EXITING' ELSE 'SEARCHING' END AS target FROM (
 SELECT *, CASE WHEN d2 IS NOT NULL THEN 'ERROR' WHEN d1 IS NOT NULL THEN CASE mode WHEN 'IN_POSITION' THEN 'EXITING' ELSE 'ERROR' END ELSE mode END AS m, coalesce(d2, d1, since) AS s,
  CASE WHEN d1 IS NOT NULL THEN CASE mode WHEN 'ENTERING' THEN 'entry_timeout' WHEN 'EXITING' THEN 'exit_timeout' ELSE 'position_timeout' END END AS first_timeout FROM (
 SELECT *, CASE WHEN mode = 'IN_POSITION' AND d1 + {DAY} < t THEN d1 + {DAY} END AS d2 FROM (
 SELECT n.symbol, n.k, n.channel, n.t, p.mode, p.since, p.entered, CASE WHEN p.mode IN ('ENTERING', 'EXITING') AND p.since + {DAY} < n.t THEN p.since + {DAY} WHEN p.mode = 'IN_POSITION' AND p.entered + {3 * DAY} < n.t THEN p.entered + {3 * DAY} END AS d1
 FROM f p JOIN n ON n.symbol = p.symbol AND n.k = p.k + 1)))))"""


@query("st05b_lifecycle_timers", sql("ticks", f"""WITH RECURSIVE {LIFE_TIMED}, j AS (SELECT n.*, f.* EXCLUDE (symbol, k) FROM n JOIN f USING (symbol, k))
SELECT symbol, seq, {r('t', 3)} AS at, mode AS state, CASE WHEN moved THEN CASE channel WHEN 'view' THEN 'entry_signal' WHEN 'click' THEN 'position_entered' WHEN 'purchase' THEN 'exit_signal' WHEN 'signup' THEN 'position_exited' ELSE 'reset' END END AS transition FROM j WHERE seq IS NOT NULL
UNION ALL SELECT symbol, NULL, {r('d1', 3)}, CASE first_timeout WHEN 'position_timeout' THEN 'EXITING' ELSE 'ERROR' END, first_timeout FROM j WHERE d1 IS NOT NULL
UNION ALL SELECT symbol, NULL, {r('d2', 3)}, 'ERROR', 'exit_timeout' FROM j WHERE d2 IS NOT NULL"""))
def lifecycle_timers(spark, sf):
    """Timeouts fire when they are due, whether or not a row follows."""
    trigger = F.create_map(*[x for k, v in TRIGGERS.items() for x in (F.lit(k), F.lit(v))])[F.col("channel")]
    d = _timed(spark, sf, E.Lifecycle(DAY, DAY, 3 * DAY), trigger=trigger)
    return shaped(_at(d), 3, "symbol seq at state transition")


def _at(d):
    return d.withColumn("at", F.unix_micros("ts") / 1e6)


SLOW_BREAKER = ST.BREAKER | {"min_halt": DAY, "max_halt": 2 * DAY, "stability": 4 * DAY}
BREAKER_TIMED = (BREAKER.replace("FROM f JOIN n ON", f"""FROM (SELECT f.* EXCLUDE (mode, recovering, seen), CASE WHEN due IS NULL THEN f.mode ELSE 'RECOVERY' END AS mode, coalesce(due, f.recovering) AS recovering, CASE WHEN due IS NULL THEN f.seen ELSE [] END AS seen FROM (
 SELECT f.* EXCLUDE (due), CASE WHEN f.mode = 'HALT' AND f.since + {2 * DAY} < n.t THEN f.since + {2 * DAY} END AS due FROM f JOIN n ON n.symbol = f.symbol AND n.k = f.k + 1) f) f JOIN n ON""")
                 .replace(">= 300 AND", f">= {DAY} AND").replace(">= 7200", f">= {2 * DAY}").replace("> 300 AND", f"> {4 * DAY} AND").replace("* 300.0::DOUBLE", f"* {4 * DAY}::DOUBLE")
                 .replace("NULL::VARCHAR AS event, NULL::VARCHAR AS severity FROM (SELECT DISTINCT", "NULL::VARCHAR AS event, NULL::VARCHAR AS severity, NULL::DOUBLE AS due FROM (SELECT DISTINCT")
                 .replace("ELSE 'RECOVERY_FAILED' END END FROM (", "ELSE 'RECOVERY_FAILED' END END, due FROM (").replace("f.recovering, f.seen, CASE WHEN mode IN", "f.recovering, f.seen, f.due, CASE WHEN mode IN"))


@query("st04b_breaker_timers", sql("ticks", f"""WITH RECURSIVE {BREAKER_TIMED}, j AS (SELECT n.symbol, n.seq, n.t, n.k, f.* EXCLUDE (symbol, k) FROM n JOIN f USING (symbol, k)),
last AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY k DESC) AS back FROM j)
SELECT symbol, seq, {r('t', 3)} AS at, mode AS state, event, severity FROM j
UNION ALL SELECT symbol, NULL, {r('due', 3)}, 'RECOVERY', 'forced_release', NULL FROM j WHERE due IS NOT NULL
UNION ALL SELECT symbol, NULL, {r(f'since + {2 * DAY}', 3)}, 'RECOVERY', 'forced_release', NULL FROM last WHERE back = 1 AND mode = 'HALT' AND since + {2 * DAY} <= (SELECT epoch_us(max(ts) - {DELAY}) / 1e6 FROM ticks)"""))
def breaker_timers(spark, sf):
    """A halt is released after its longest time without waiting for a row."""
    p = F.least(F.col("price") / 120, F.lit(1.0))
    d = W.watermarked(_stream(spark, sf)).filter(p > 0.1).select("symbol", "ts", "seq", p.alias("probability"), (F.col("seq") % 3 * 1.0 + 0.2).alias("recent_std"))
    d = _table(spark, E.timed_fold(d, ["symbol"], E.Breaker(SLOW_BREAKER)))
    return shaped(_at(d), 3, "symbol seq at state event severity")


SNAP = f"""n AS (SELECT symbol, seq, price, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS k FROM ticks
 UNION ALL SELECT symbol, NULL, NULL, any_value(w), count(*) + 1 FROM ticks, (SELECT epoch_us(max(ts) - {DELAY}) / 1e6 + 1e-7 AS w FROM ticks) GROUP BY symbol),
f AS (SELECT symbol, 0::BIGINT AS k, NULL::DOUBLE AS made, NULL::BIGINT AS waiting, NULL::DOUBLE AS due, NULL::BIGINT AS fired, false AS own FROM (SELECT DISTINCT symbol FROM n)
 UNION ALL SELECT symbol, k, CASE WHEN own THEN t ELSE m END, CASE WHEN own THEN NULL ELSE seq END, due, fired, own FROM (
 SELECT *, seq IS NOT NULL AND (m IS NULL OR t >= m + {DAY / 2}) AS own FROM (
 SELECT *, coalesce(due, made) AS m, CASE WHEN due IS NOT NULL THEN waiting END AS fired FROM (
 SELECT n.*, f.made, f.waiting, CASE WHEN f.waiting IS NOT NULL AND f.made + {DAY / 2} < n.t THEN f.made + {DAY / 2} END AS due FROM f JOIN n ON n.symbol = f.symbol AND n.k = f.k + 1))))"""


@query("b08b_snapshot_timers", sql("ticks", f"""WITH RECURSIVE {SNAP}, j AS (SELECT n.*, f.* EXCLUDE (symbol, k) FROM n JOIN f USING (symbol, k))
SELECT symbol, {r('t', 3)} AS at, seq AS snapshot_seq, {r('price')} AS value FROM j WHERE own
UNION ALL SELECT j.symbol, {r('due', 3)}, fired, {r('ticks.price')} FROM j JOIN ticks ON ticks.seq = fired WHERE due IS NOT NULL"""))
def snapshot_timers(spark, sf):
    """Twelve-hourly snapshots: at once when none was made for so long, else when that time is over."""
    d = W.watermarked(_stream(spark, sf)).select("symbol", "ts", "seq", F.col("price").alias("value"))
    d = _table(spark, E.timed_fold(d, ["symbol"], E.Snapshots(DAY / 2)))
    return shaped(_at(d), columns="symbol at snapshot_seq value", per={"at": 3})
