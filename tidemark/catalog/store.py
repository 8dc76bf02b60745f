"""Source, store, quality, ordering and set queries (S, D, O, U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.base import query, r, rs, shaped, sql
from tidemark.functions import rules as X
from tidemark.operators import ranking as O
from tidemark.operators import accounting as K
from tidemark.plans.series import TICKS, Series
from tidemark.sources import files as S
from tidemark.sources import store as T
from tidemark.sources import views as V

PAYLOAD_ROWS = 10_000
RANGE = ("2024-01-05", "2024-01-20")
IN_RANGE = "ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20'"


@query("s01_read_market_csv", sql("ticks", f"SELECT upper(channel) AS symbol, ts, {r('price')} AS price, (1 + seq % 9)::DOUBLE AS quantity, CASE WHEN seq % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, seq AS trade_id FROM ticks WHERE {IN_RANGE}"))
def read_market_csv(spark, sf):
    path = S.scratch(spark, "csv")
    d = V.channel_ticks(spark, sf).select("symbol", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), "price", (1 + F.col("seq") % 9).cast("double").alias("quantity"),
                                          F.when(F.col("seq") % 2 == 0, "buy").otherwise("sell").alias("side"), F.col("seq").alias("trade_id"))
    d.write.partitionBy("symbol").option("header", True).csv(path)
    return shaped(S.read_market_csv(spark, path, "trades", None, *RANGE))


@query("s01b_read_book_csv", sql("quotes", f"SELECT upper(channel) AS symbol, seq AS sequence_id, {rs('bid ask')}, bid_qty, 1::BIGINT AS n_asks FROM quotes"))
def read_book_csv(spark, sf):
    path = S.scratch(spark, "books")
    level = lambda p, q: F.concat(F.lit("[["), F.col(p).cast("string"), F.lit(", "), F.col(q).cast("string"), F.lit("]]"))
    d = V.quotes(spark, sf).select(F.col("channel").alias("symbol"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), level("bid", "bid_qty").alias("bids"), level("ask", "ask_qty").alias("asks"), F.col("seq").alias("sequence_id"))
    d.write.partitionBy("symbol").option("header", True).csv(path)
    b = S.read_market_csv(spark, path, "books")
    return shaped(b.select("symbol", "sequence_id", F.col("bids")[0]["price"].alias("bid"), F.col("asks")[0]["price"].alias("ask"), F.col("bids")[0]["quantity"].alias("bid_qty"), F.size("asks").alias("n_asks")))


@query("s02_read_market_parquet", f"SELECT event_id, ts, {r('value')} AS value FROM events WHERE {IN_RANGE}")
def read_market_parquet(spark, sf):
    return S.read_market_parquet(spark, f"{sf}/events.parquet", "ts", None, *RANGE).select("event_id", "ts", (F.floor(F.col("value") * 1e6 + 0.5003) / 1e6).alias("value"))


@query("s03_read_recordings", sql("quotes", f"SELECT upper(channel) AS symbol, ts, CASE WHEN channel = 'error' THEN 'trade_tick' ELSE 'order_book_update' END AS kind, CASE WHEN channel <> 'error' THEN seq ELSE 0 END AS sequence_id, {r('CASE WHEN channel <> ' + chr(39) + 'error' + chr(39) + ' THEN bid END')} AS bid FROM quotes WHERE {IN_RANGE}"))
def read_recordings(spark, sf):
    path = S.scratch(spark, "recordings")
    tick = F.col("channel") == "error"
    level = lambda p, q: F.when(~tick, F.array(F.array(F.col(p).cast("string"), F.col(q).cast("string"))))
    d = V.quotes(spark, sf).select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), F.when(tick, "trade_tick").otherwise("order_book_update").alias("type"),
        level("bid", "bid_qty").alias("bids"), level("ask", "ask_qty").alias("asks"), F.when(~tick, F.col("seq")).alias("final_update_id"),
        F.when(tick, F.col("bid").cast("string")).alias("price"), F.when(tick, F.lit("1")).alias("quantity"), "channel")
    named = F.concat_ws("_", "channel", F.date_format("timestamp", "yyyy-MM-dd"), F.date_format(F.date_add(F.to_date("timestamp"), 1), "yyyy-MM-dd"))
    d.withColumn("recording", named).drop("channel").write.partitionBy("recording").option("compression", "gzip").json(path)
    out = S.read_recordings(spark, path, *RANGE)
    return shaped(out.select("symbol", "ts", "kind", "sequence_id", F.col("bids")[0]["price"].alias("bid")))


@query("s04_symbol_catalog", sql("ticks", "SELECT symbol, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS rows FROM ticks GROUP BY 1"))
def symbol_catalog(spark, sf):
    return shaped(S.symbol_catalog(V.ticks(spark, sf)))


@query("s05_merge_symbols", sql("ticks", f"SELECT symbol, ts, seq, {r('price')} AS price FROM ticks WHERE channel IN ('view', 'click') ORDER BY ts, seq"))
def merge_symbols(spark, sf):
    t = V.ticks(spark, sf).select("symbol", "ts", "seq", "price", "channel")
    return shaped(S.merge_symbols(t.filter("channel = 'view'"), t.filter("channel = 'click'")), columns="symbol ts seq price")


def _orders(spark, sf):
    """The store's orders, and a batch of updates (with a few new orders) for them."""
    o = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("status"), (F.col("o_totalprice") / 100).alias("amount"),
                                            F.lit(0.0).alias("filled"), F.lit(None).cast("double").alias("remaining"), F.lit(None).cast("double").alias("cost"), F.lit(0).cast("long").alias("version"))
    li = V.table(spark, sf, "lineitem")
    u = li.groupBy(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").cast("long").alias("version")).agg(F.sum("l_quantity").alias("filled"), F.sum("l_extendedprice").alias("cost"), F.max("l_linestatus").alias("status"))
    u = u.withColumn("remaining", F.when(F.col("order_id") % 3 == 0, F.col("filled") * 2))
    return o, u


@query("s09_upsert_orders", f"""WITH u AS (SELECT l_orderkey AS order_id, l_linenumber::BIGINT AS version, sum(l_quantity) AS filled, sum(l_extendedprice) AS cost, max(l_linestatus) AS status FROM lineitem GROUP BY 1, 2),
l AS (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY version DESC) AS k FROM u)
SELECT o_orderkey AS order_id, coalesce(l.status, o_orderstatus) AS status, {r('o_totalprice / 100', 4)} AS amount, {r('coalesce(filled, 0)', 2)} AS filled, {r('cost', 2)} AS cost, coalesce(version, 0) AS version,
{r('CASE WHEN version IS NOT NULL AND order_id % 3 = 0 THEN filled * 2 ELSE o_totalprice / 100 - coalesce(filled, 0) END', 4)} AS remaining FROM orders LEFT JOIN (SELECT * FROM l WHERE k = 1) l ON o_orderkey = order_id""")
def upsert_orders(spark, sf):
    return shaped(T.upsert_orders(*_orders(spark, sf)), 4, "order_id status amount filled cost version remaining", per={"filled": 2, "cost": 2})


@query("s10_close_trades", f"""WITH x AS (SELECT l_orderkey AS trade_id, max(l_shipdate) AS exit_time, sum(l_extendedprice) AS pnl FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
SELECT o_orderkey AS trade_id, CASE WHEN x.trade_id IS NOT NULL THEN 'closed' ELSE 'open' END AS status, exit_time, {r('pnl', 2)} AS pnl FROM orders LEFT JOIN x ON o_orderkey = x.trade_id""")
def close_trades(spark, sf):
    trades = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("trade_id"), F.lit(None).cast("timestamp").alias("exit_time"), F.lit(None).cast("double").alias("pnl"))
    opened = T.append_open_trades(trades.filter("false").withColumn("status", F.lit("open")), trades)
    exits = V.table(spark, sf, "lineitem").filter("l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("trade_id")).agg(
        F.max("l_shipdate").cast("timestamp").alias("exit_time"), F.sum("l_extendedprice").alias("pnl"))
    return shaped(T.close_trades(opened, exits, columns=("exit_time", "pnl")), 2, "trade_id status exit_time pnl")


@query("s11_update_excursions", sql("closed_trades", f"""SELECT account AS trade_id, {r('greatest(100.0, max(pnl), 0)', 4)} AS mfe, {r('greatest(50.0, -min(pnl), 0)', 4)} AS mae FROM closed_trades GROUP BY 1"""))
def update_excursions(spark, sf):
    marks = V.closed_trades(spark, sf).select(F.col("account").alias("trade_id"), "pnl")
    trades = marks.select("trade_id").distinct().withColumns({"mfe": F.lit(100.0), "mae": F.lit(50.0)})
    return shaped(K.excursions_update(trades, marks), 4)


@query("s12_write_snapshots", sql("ticks", f"SELECT symbol, ts, {r('price')} AS price, ts::DATE AS day, channel AS detail FROM ticks"))
def write_snapshots(spark, sf):
    path = S.scratch(spark, "snapshots")
    rows = T.snapshot_rows(V.ticks(spark, sf).drop("props"), {"channel": F.col("channel")})
    T.write_snapshots(rows.repartition("day"), path)
    d = spark.read.parquet(path)
    return shaped(d.select("symbol", "ts", "price", "day", F.get_json_object("details", "$.channel").alias("detail")))


@query("s13_retain", sql("ticks", "SELECT symbol, seq FROM ticks WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY"))
def retain(spark, sf):
    return T.retain(V.ticks(spark, sf), F.expr("timestamp'2024-01-31'"), 10).select("symbol", "seq")


@query("s14_parse_metric_payload", sql("ticks", f"""SELECT upper(symbol) AS symbol, channel AS metric, to_timestamp(epoch_us(ts) // 1000000)::TIMESTAMP AS ts, 'value' AS field, {r('price')} AS value FROM ticks WHERE channel <> 'error' AND seq % 10 <> 0
UNION ALL SELECT upper(symbol), channel, to_timestamp(epoch_us(ts) // 1000000)::TIMESTAMP, unnest(['inflow', 'outflow', 'net_flow']), unnest([{r('price')}, {r('price * 2')}, {r('price')}]) FROM ticks WHERE channel = 'error'"""))
def parse_metric_payload(spark, sf):
    # a payload holds one day and one block of sequence numbers, so its points are bounded whatever its key has
    t = V.ticks(spark, sf).withColumns({"t": F.unix_seconds("ts"), "day": F.to_date("ts"), "block": F.floor(F.col("seq") / PAYLOAD_ROWS)})
    points = t.filter("channel <> 'error'").groupBy("symbol", "channel", "day", "block").agg(F.to_json(F.collect_list(F.struct("t", F.when(F.col("seq") % 10 != 0, F.col("price")).alias("v")))).alias("payload"))
    flows = t.filter("channel = 'error'").groupBy("symbol", "channel", "day", "block").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("t").alias("timestamp"), F.col("price").alias("inflow"), (F.col("price") * 2).alias("outflow"))).alias("result"))).alias("payload"))
    landed = points.unionByName(flows).select("symbol", F.col("channel").alias("metric"), F.lit("api").alias("source"), "payload")
    return shaped(S.parse_metric_payload(landed), columns="symbol metric ts field value")


@query("s15_scan_logs", sql("log_lines", "SELECT doc_id, line_no::BIGINT AS line_no, md5(line) AS line_md5 FROM log_lines WHERE contains(upper(line), 'LICENSE')"))
def scan_logs(spark, sf):
    d = S.filter_log_lines(V.log_lines(spark, sf), "license")
    return d.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.md5("line").alias("line_md5"))


@query("s15b_scan_log_files", "SELECT count(*) AS lines FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE contains(upper(line), 'THE')")
def scan_log_files(spark, sf):
    path = S.scratch(spark, "logs")
    V.table(spark, sf, "documents").select(F.regexp_replace("text", "\r", " ").alias("value")).write.text(path)
    return S.scan_logs(spark, path, "the").agg(F.count(F.lit(1)).alias("lines"))


@query("s16_write_results", sql("equity", f"SELECT strategy AS split_id, count(*) AS days, {r('sum(value)', 2)} AS total FROM equity GROUP BY 1"))
def write_results(spark, sf):
    path = S.scratch(spark, "results")
    S.write_results(V.equity(spark, sf).groupBy(F.col("strategy").alias("split_id")).agg(F.count(F.lit(1)).alias("days"), F.sum("value").alias("total")), path)
    return shaped(spark.read.schema("days bigint, total double, split_id string").json(path), 2)


@query("d01_check_constraints", """SELECT 'positive_quantity' AS rule, count(*) FILTER (NOT l_quantity > 2) AS violations FROM lineitem UNION ALL SELECT 'bounded_discount', count(*) FILTER (NOT l_discount <= 0.09) FROM lineitem
UNION ALL SELECT 'unique_l_orderkey_l_linenumber', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'parent_o_orderkey', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')""")
def check_constraints(spark, sf):
    li = V.table(spark, sf, "lineitem").withColumn("o_orderkey", F.col("l_orderkey"))
    parents = {"o_orderkey": V.table(spark, sf, "orders").filter("o_orderstatus <> 'F'")}
    return T.check_constraints(li, {"positive_quantity": "l_quantity > 2", "bounded_discount": "l_discount <= 0.09"}, ["l_orderkey", "l_linenumber"], parents)


@query("d02_finite_positive", sql("closed_trades", f"SELECT trade_id, {r('pnl', 4)} AS pnl FROM closed_trades WHERE pnl > 0"))
def finite_positive(spark, sf):
    d = V.closed_trades(spark, sf).withColumn("pnl", F.when(F.col("pnl") == 0, F.lit(float("nan"))).otherwise(F.col("pnl")))
    return shaped(T.finite_positive(d, "pnl", "pair"), 4, "trade_id pnl")


ANOM = """an AS (SELECT symbol, ts, seq, channel AS anomaly_type, CASE WHEN price >= 225 THEN 'critical' WHEN price >= 150 THEN 'high' WHEN price >= 112.5 THEN 'medium' ELSE 'low' END AS severity, least(price / 500, 0.99) AS confidence FROM ticks WHERE price >= 75)"""


def _anomalies(spark, sf):
    return V.ticks(spark, sf).filter("price >= 75").select("symbol", "ts", "seq", F.col("channel").alias("anomaly_type"), X.severity("price", 75.0).alias("severity"), F.least(F.col("price") / 500, F.lit(0.99)).alias("confidence"))


@query("o01_dedupe_rank_anomalies", sql("ticks", f"WITH {ANOM}, k AS (SELECT *, row_number() OVER (PARTITION BY anomaly_type, date_trunc('hour', ts) ORDER BY confidence DESC, seq) AS k FROM an) SELECT symbol, seq, anomaly_type, severity, {r('confidence')} AS confidence FROM k WHERE k = 1"))
def dedupe_rank_anomalies(spark, sf):
    return shaped(O.dedupe_rank_anomalies(_anomalies(spark, sf)), columns="symbol seq anomaly_type severity confidence")


@query("o02_rank_opportunities", sql("ticks", f"SELECT seq, {r('price / 100 * least(price / 500, 1.0) * CASE WHEN channel = ' + chr(39) + 'view' + chr(39) + ' THEN 1.2 ELSE 1.0 END * CASE WHEN abs((price - 50) / 30) > 3 THEN 0.8 ELSE 1.0 END')} AS score FROM ticks"))
def rank_opportunities(spark, sf):
    d = V.ticks(spark, sf).select("seq", (F.col("price") / 100).alias("expected_return"), F.least(F.col("price") / 500, F.lit(1.0)).alias("confidence"), F.when(F.col("channel") == "view", "intra_cluster").otherwise("cross_cluster").alias("kind"), ((F.col("price") - 50) / 30).alias("z"))
    return shaped(O.rank_opportunities(d), columns="seq score")


@query("o03_top_edges", sql("ticks", f"""WITH p AS (SELECT date_trunc('day', ts)::TIMESTAMP AS window_id, symbol AS a, channel || seq AS b, (price - 50) / 500 AS weight FROM ticks),
s AS (SELECT * FROM p WHERE abs(weight) >= 0.3), n AS (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY abs(weight) DESC, a, b) AS k FROM p WHERE window_id NOT IN (SELECT window_id FROM s)),
e AS (SELECT window_id, a, b, weight FROM s UNION ALL SELECT window_id, a, b, weight FROM n WHERE k <= 10), both_ways AS (SELECT * FROM e UNION ALL SELECT window_id, b, a, weight FROM e),
t AS (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY abs(weight) DESC, a, b) AS k FROM both_ways) SELECT window_id, a, b, {r('weight')} AS weight FROM t WHERE k <= 20"""))
def top_edges(spark, sf):
    p = V.ticks(spark, sf).select(F.date_trunc("day", "ts").alias("window_id"), F.col("symbol").alias("a"), F.concat("channel", F.col("seq").cast("string")).alias("b"), ((F.col("price") - 50) / 500).alias("weight"))
    return shaped(O.top_edges(p, ["window_id"], 0.3, 20))


@query("o04_top_features", sql("ticks", f"SELECT symbol AS feature, {r('avg(price)')} AS importance FROM ticks GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"))
def top_features(spark, sf):
    d = shaped(V.ticks(spark, sf).groupBy(F.col("symbol").alias("feature")).agg(F.avg("price").alias("importance")))
    return O.top_features(d, 10)


@query("o05_recent", sql("ticks", "WITH k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, seq DESC) AS recency FROM ticks) SELECT symbol, seq, recency FROM k WHERE recency <= 5"))
def recent(spark, sf):
    return shaped(O.latest_per_key(V.ticks(spark, sf), TICKS, 5, "recency"), columns="symbol seq recency")


@query("o06_recent_pnl", sql("ticks", f"SELECT symbol, seq, {r('price')} AS price FROM ticks WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 48 HOUR ORDER BY ts DESC"))
def recent_pnl(spark, sf):
    return shaped(T.recent_pnl(V.ticks(spark, sf), F.expr("timestamp'2024-01-31'"), 48), columns="symbol seq price")


@query("o07_open_trades", sql("closed_trades", f"SELECT trade_id, pair, {r('notional', 2)} AS notional FROM closed_trades WHERE status = 'OPEN'"))
def open_trades(spark, sf):
    return shaped(T.open_trades(V.closed_trades(spark, sf)), 2, "trade_id pair notional")


@query("u01_union_sources", sql("ticks", f"SELECT symbol, seq, {r('price')} AS inflow, NULL::DOUBLE AS outflow FROM ticks WHERE channel = 'view' UNION ALL SELECT symbol, seq, NULL, {r('price')} FROM ticks WHERE channel = 'click'"))
def union_sources(spark, sf):
    t = V.ticks(spark, sf)
    a = t.filter("channel = 'view'").select("symbol", "seq", F.col("price").alias("inflow"))
    b = t.filter("channel = 'click'").select("symbol", "seq", F.col("price").alias("outflow"))
    return shaped(O.union_sources(a, b))


def _hours(spark, sf, channel):
    return V.ticks(spark, sf).filter(F.col("channel") == channel).select(F.date_trunc("hour", "ts").alias("ts"))


H = "SELECT date_trunc('hour', ts)::TIMESTAMP AS ts FROM ticks WHERE channel = "


@query("u02_timestamp_union", sql("ticks", f"{H}'view' UNION {H}'click'"))
def timestamp_union(spark, sf):
    return shaped(O.timestamp_union(_hours(spark, sf, "view"), _hours(spark, sf, "click")))


@query("u02b_timestamp_intersection", sql("ticks", f"{H}'view' INTERSECT {H}'click'"))
def timestamp_intersection(spark, sf):
    return shaped(O.timestamp_intersection(_hours(spark, sf, "view"), _hours(spark, sf, "click")))


@query("u03_symbol_coverage", sql("ticks", f"""WITH a AS (SELECT DISTINCT symbol FROM ticks WHERE price > 200), b AS (SELECT DISTINCT symbol FROM ticks WHERE channel = 'view'),
c AS (SELECT (SELECT count(*) FROM (FROM a INTERSECT FROM b)) AS covered, (SELECT count(*) FROM (FROM b EXCEPT FROM a)) AS uncovered, (SELECT count(*) FROM (FROM a EXCEPT FROM b)) AS unknown)
SELECT covered, uncovered, unknown, {r('covered / (covered + uncovered)')} AS coverage FROM c"""))
def symbol_coverage(spark, sf):
    t = V.ticks(spark, sf)
    return shaped(O.symbol_coverage(t.filter("price > 200"), t.filter("channel = 'view'")))


@query("u04_merge_intervals", sql("closed_trades", """WITH o AS (SELECT pair, entry_time AS start, entry_time + INTERVAL 1 DAY AS en, max(entry_time + INTERVAL 1 DAY) OVER (PARTITION BY pair ORDER BY entry_time, trade_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM closed_trades),
i AS (SELECT *, sum(CASE WHEN past IS NULL OR start > past THEN 1 ELSE 0 END) OVER (PARTITION BY pair ORDER BY start, past NULLS FIRST ROWS UNBOUNDED PRECEDING) AS island FROM o)
SELECT pair, min(start) AS start, max(en) AS "end" FROM i GROUP BY pair, island"""))
def merge_intervals(spark, sf):
    # one-day intervals, so that some stay apart
    d = V.closed_trades(spark, sf).select("pair", F.col("entry_time").alias("start"), (F.col("entry_time") + F.expr("interval 1 day")).alias("end"), "trade_id")
    return shaped(O.merge_intervals(d, Series(("pair",), ("start", "trade_id"))), columns="pair start end")
