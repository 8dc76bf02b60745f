"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.base import query, r, rs, shaped, sql
from tidemark.catalog.rolling import wb
from tidemark.catalog.rules import PARAMETERS
from tidemark.operators import joins as J
from tidemark.operators import policy as P
from tidemark.operators import rolling as R
from tidemark.plans.series import Series
from tidemark.sources import views as V

EQ = Series(("strategy",), ("ts",), True)


@query("j01_pair_prices", sql("channel_ticks", f"""WITH legs(pair_id, symbol, leg) AS (VALUES ('p1','view','a'),('p1','click','b'),('p2','purchase','a'),('p2','signup','b'),('p3','error','a'),('p3','view','b')),
l AS (SELECT * FROM channel_ticks JOIN legs USING (symbol)),
s AS (SELECT pair_id, ts, seq, last_value(CASE WHEN leg = 'a' THEN price END IGNORE NULLS) OVER q AS pa, last_value(CASE WHEN leg = 'a' THEN ts END IGNORE NULLS) OVER q AS ta,
 last_value(CASE WHEN leg = 'b' THEN price END IGNORE NULLS) OVER q AS pb, last_value(CASE WHEN leg = 'b' THEN ts END IGNORE NULLS) OVER q AS tb
 FROM l WINDOW q AS (PARTITION BY pair_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT pair_id, seq, {r('pa')} AS price_a, {r('pb')} AS price_b, {r('pa / pb')} AS price_ratio FROM s
WHERE ts - ta <= INTERVAL 600 SECOND AND ts - tb <= INTERVAL 600 SECOND AND pb <> 0"""))
def pair_prices(spark, sf):
    pairs = spark.createDataFrame([("p1", "view", "click"), ("p2", "purchase", "signup"), ("p3", "error", "view")], "pair_id string, a string, b string")
    return shaped(J.pair_prices(V.channel_ticks(spark, sf), pairs, 600.0), columns="pair_id seq price_a price_b price_ratio")


@query("j02_latest_three_way", sql("ticks", f"""WITH k AS (SELECT *, CASE WHEN channel IN ('view','click') THEN 'book' WHEN channel IN ('purchase','error') THEN 'hedge' ELSE 'thresh' END AS st FROM ticks),
s AS (SELECT symbol, ts, seq, {", ".join(f"last_value(CASE WHEN st = '{n}' THEN price END IGNORE NULLS) OVER q AS {n}, last_value(CASE WHEN st = '{n}' THEN ts END IGNORE NULLS) OVER q AS t_{n}" for n in ("book", "hedge", "thresh"))}
 FROM k WINDOW q AS (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT symbol, seq, {rs('book hedge thresh')} FROM s WHERE ts - t_book <= INTERVAL 2 DAY AND ts - t_hedge <= INTERVAL 2 DAY AND ts - t_thresh <= INTERVAL 2 DAY"""))
def latest_three_way(spark, sf):
    t = V.ticks(spark, sf)
    parts = {"book": t.filter(F.col("channel").isin("view", "click")), "hedge": t.filter(F.col("channel").isin("purchase", "error")),
             "thresh": t.filter(F.col("channel") == "signup")}
    return shaped(J.latest_of_streams(parts, "price", ttl_s=2 * 86400), columns="symbol seq book hedge thresh")


@query("j03_nearest_join", sql("ticks", f"""WITH f AS (SELECT symbol, ts, seq FROM ticks WHERE channel <> 'view'), p AS (SELECT symbol, ts, price FROM ticks WHERE channel = 'view'),
b AS (SELECT f.*, p.ts AS bts, p.price AS bp FROM f ASOF LEFT JOIN p ON f.symbol = p.symbol AND f.ts >= p.ts),
n AS (SELECT b.*, p.ts AS nts, p.price AS np FROM b ASOF LEFT JOIN p ON b.symbol = p.symbol AND b.ts <= p.ts)
SELECT symbol, seq, CASE WHEN bts IS NULL OR nts - ts <= ts - bts THEN np ELSE bp END AS near_price,
 CASE WHEN bts IS NULL OR nts - ts <= ts - bts THEN nts ELSE bts END AS nearest_ts FROM n"""))
def nearest_join(spark, sf):
    t = V.ticks(spark, sf)
    d = J.nearest_join(t.filter("channel <> 'view'").select("symbol", "ts", "seq"), t.filter("channel = 'view'"), ["symbol"], {"price": "near_price"})
    return shaped(d, columns="symbol seq near_price nearest_ts")


@query("j04_asof_join", sql("ticks", """WITH f AS (SELECT symbol, ts, seq FROM ticks WHERE channel <> 'view'), p AS (SELECT symbol, ts, price FROM ticks WHERE channel = 'view')
SELECT f.symbol, seq, CASE WHEN f.ts - p.ts <= INTERVAL 1 DAY THEN p.price END AS view_price, CASE WHEN f.ts - p.ts <= INTERVAL 1 DAY THEN p.ts END AS right_ts
FROM f ASOF LEFT JOIN p ON f.symbol = p.symbol AND f.ts >= p.ts"""))
def asof_join(spark, sf):
    t = V.ticks(spark, sf)
    d = J.asof_join(t.filter("channel <> 'view'").select("symbol", "ts", "seq"), t.filter("channel = 'view'"), ["symbol"], {"price": "view_price"}, tolerance_s=86400)
    return shaped(d, columns="symbol seq view_price right_ts")


def _metric(spark, sf, name):
    return V.metric_days(spark, sf).filter(F.col("metric") == name)


M = "SELECT symbol, ts, value FROM metric_days WHERE metric"


@query("j05_flows_inner", sql("metric_days", f"""WITH d AS (SELECT symbol, ts, i.value AS inflow, o.value AS outflow, o.value - i.value AS net_flow,
 CASE WHEN o.value > 0 THEN i.value / o.value ELSE 0.0 END AS inflow_outflow_ratio FROM ({M} = 'view') i JOIN ({M} = 'click') o USING (symbol, ts))
SELECT symbol, ts, {rs('inflow outflow net_flow')}, {r('inflow_outflow_ratio', 4)} AS inflow_outflow_ratio FROM d"""))
def flows_inner(spark, sf):
    return shaped(J.flows_inner(_metric(spark, sf, "view"), _metric(spark, sf, "click")), per={"inflow_outflow_ratio": 4})


@query("j06_whales_left", sql("metric_days", f"SELECT symbol, ts, {r('t.value')} AS whale_count, {r('coalesce(v.value, 0.0)')} AS whale_volume FROM ({M} = 'purchase') t LEFT JOIN ({M} = 'error') v USING (symbol, ts)"))
def whales_left(spark, sf):
    return shaped(J.whales_left(_metric(spark, sf, "purchase"), _metric(spark, sf, "error")))


@query("j07_health_left", sql("metric_days", f"""WITH d AS (SELECT symbol, ts, a.value * 10000 AS addresses, coalesce(t.value * 3000, 0) AS tx_count, h.value AS hash_rate, coalesce(f.value, 0.0) AS fee
 FROM ({M} = 'view') a LEFT JOIN ({M} = 'click') t USING (symbol, ts) LEFT JOIN ({M} = 'purchase') h USING (symbol, ts) LEFT JOIN ({M} = 'error') f USING (symbol, ts)),
s AS (SELECT *, least(1.0, 0.5 * least(1.0, addresses / 1e6) + 0.3 * CASE WHEN tx_count > 0 THEN least(1.0, tx_count / 3e5) ELSE 0 END + CASE WHEN coalesce(hash_rate, 0) <> 0 THEN 0.2 ELSE 0 END) AS health_score FROM d)
SELECT symbol, ts, {rs('addresses tx_count', 3)}, {rs('hash_rate fee health_score')} FROM s"""))
def health_left(spark, sf):
    scale = lambda d, k: d.withColumn("value", F.col("value") * k)
    d = J.health_left(scale(_metric(spark, sf, "view"), 10000), scale(_metric(spark, sf, "click"), 3000), _metric(spark, sf, "purchase"), _metric(spark, sf, "error"))
    return shaped(d, per={"addresses": 3, "tx_count": 3})


@query("j08_metrics_full_outer", sql("metric_days", f"""SELECT symbol, ts, {r('a.value')} AS view, {r('b.value')} AS click, {r('c.value')} AS error FROM ({M} = 'view') a
FULL OUTER JOIN ({M} = 'click') b USING (symbol, ts) FULL OUTER JOIN ({M} = 'error') c USING (symbol, ts)"""))
def metrics_full_outer(spark, sf):
    sides = [_metric(spark, sf, m).select("symbol", "ts", F.col("value").alias(m)) for m in ("view", "click", "error")]
    return shaped(J.metrics_full_outer(*sides))


ALIGNED = "aligned AS (SELECT * FROM nation_bars WHERE ts IN (SELECT ts FROM nation_bars GROUP BY ts HAVING count(*) = (SELECT count(DISTINCT symbol) FROM nation_bars)))"


def aligned(spark, sf):
    return J.align_symbols(V.nation_bars(spark, sf))


@query("j09_align_symbols", sql("nation_bars", f"WITH {ALIGNED} SELECT symbol, ts, {r('close', 2)} AS close FROM aligned"))
def align_symbols(spark, sf):
    return shaped(aligned(spark, sf), 2, "symbol ts close")


NATIONS = [f"N{i}" for i in range(25)]


@query("j10_outer_series", sql("nation_bars", "SELECT ts, " + ", ".join(f"{r(chr(109) + 'ax(close) FILTER (symbol = ' + chr(39) + n + chr(39) + ')', 2)} AS {n}" for n in NATIONS) + " FROM nation_bars GROUP BY ts"))
def outer_series(spark, sf):
    return shaped(J.outer_series(V.nation_bars(spark, sf), NATIONS, "symbol", "close"), 2)


@query("j11_symbol_pairs", sql("nation_bars", "SELECT a.symbol AS a, b.symbol AS b, count(*) AS months FROM nation_bars a JOIN nation_bars b ON a.ts = b.ts AND a.symbol < b.symbol GROUP BY 1, 2"))
def symbol_pairs(spark, sf):
    return J.symbol_pairs(V.nation_bars(spark, sf), "ts").groupBy("a", "b").agg(F.count(F.lit(1)).alias("months"))


def _links(spark, sf):
    line = V.table(spark, sf, "lineitem")
    return line.select(V.line_id().alias("trade_id"), (F.col("l_orderkey") + F.col("l_partkey")).alias("order_id"),
                       F.when(F.col("l_returnflag") == "R", "exit").otherwise("entry").alias("role"))


LINKS = "links AS (SELECT (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey % 1000000 AS trade_id, l_orderkey + l_partkey AS order_id, CASE WHEN l_returnflag = 'R' THEN 'exit' ELSE 'entry' END AS role FROM lineitem)"


def _link_sides(spark, sf):
    trades = V.closed_trades(spark, sf).filter(F.col("status") == "CLOSED").select("trade_id")
    orders = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"))
    return trades, orders


@query("j12_trade_order_link", sql("", f"""WITH {LINKS} SELECT trade_id, order_id, role FROM links WHERE order_id IN (SELECT o_orderkey FROM orders)
 AND trade_id IN (SELECT (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey % 1000000 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linestatus <> 'O')"""))
def trade_order_link(spark, sf):
    return J.trade_order_link(_links(spark, sf), *_link_sides(spark, sf))


@query("j12b_unlinked", sql("", f"""WITH {LINKS} SELECT trade_id, order_id, role, 'order' AS missing FROM links WHERE order_id NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT trade_id, order_id, role, 'trade' FROM links WHERE trade_id NOT IN (SELECT (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey % 1000000 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linestatus <> 'O')"""))
def unlinked(spark, sf):
    return J.unlinked(_links(spark, sf), *_link_sides(spark, sf))


# test periods: the first fortnight of each quarter of each year
PERIODS = "periods AS (SELECT range AS start, range + INTERVAL 14 DAY AS \"end\" FROM range(TIMESTAMP '1995-01-01', TIMESTAMP '2002-01-01', INTERVAL 3 MONTH))"


def periods(spark):
    return spark.sql("SELECT explode(sequence(timestamp'1995-01-01', timestamp'2001-10-01', interval 3 months)) AS start").withColumn("end", F.col("start") + F.expr("interval 14 days"))


@query("j13_period_membership", sql("", f"WITH {PERIODS} SELECT o_orderkey, o_orderdate AS ts FROM orders WHERE EXISTS (SELECT 1 FROM periods WHERE o_orderdate BETWEEN start AND \"end\")"))
def period_membership(spark, sf):
    o = V.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("ts"))
    return shaped(J.period_membership(o, periods(spark)))


@query("j14_tail_align", sql("ticks", """WITH a AS (SELECT symbol, price, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, seq DESC) AS k FROM ticks WHERE channel IN ('view', 'click')),
b AS (SELECT symbol, price, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, seq DESC) AS k FROM ticks WHERE channel NOT IN ('view', 'click'))
SELECT symbol, k AS from_end, a.price AS a, b.price AS b FROM a JOIN b USING (symbol, k)"""))
def tail_align(spark, sf):
    t = V.ticks(spark, sf)
    first = F.col("channel").isin("view", "click")
    return J.tail_align(t.filter(first), t.filter(~first), Series(), "price")


@query("j15_regime_parameters", sql("regimes", f"WITH {PARAMETERS} SELECT symbol, seq, regime, entry_z, exit_z, max_position, kelly, holding FROM regimes JOIN params USING (regime)"))
def regime_parameters(spark, sf):
    return P.regime_parameters(V.regimes(spark, sf)).select("symbol", "seq", "regime", "entry_z", "exit_z", "max_position", "kelly", "holding")


@query("j16_benchmark_corr", sql("bars", f"""WITH j AS (SELECT b.symbol, b.ts, b.close, v.close AS bench FROM bars b JOIN bars v ON b.ts = v.ts AND v.symbol = 'view'),
d AS (SELECT symbol, ts, close - lag(close) OVER q AS x, bench - lag(bench) OVER q AS y FROM j WINDOW q AS (PARTITION BY symbol ORDER BY ts)),
c AS (SELECT symbol, ts, CASE WHEN count(x) OVER {wb(49)} > 10 THEN coalesce(corr(x, y) OVER {wb(49)}, 0) END AS benchmark_corr FROM d)
SELECT symbol, ts, {r('benchmark_corr')} AS benchmark_corr FROM c"""))
def benchmark_corr(spark, sf):
    b = V.bars_1h(spark, sf)
    return shaped(J.benchmark_corr(b, b.filter("symbol = 'view'")), columns="symbol ts benchmark_corr")
