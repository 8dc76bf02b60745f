"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.base import query, r, rs, shaped, sql
from tidemark.functions import rules as X
from tidemark.operators import accounting as K
from tidemark.operators import aggregates as A
from tidemark.operators import rolling as R
from tidemark.operators.joins import symbol_pairs
from tidemark.plans.series import TICKS, Series, by_key_size
from tidemark.sources import views as V

EQ = Series(("strategy",), ("ts",), True)
TRADES = Series(("pair",), ("exit_time", "trade_id"))

METRICS_SQL = """p AS (SELECT strategy, ts, value, max(value) OVER (PARTITION BY strategy ORDER BY ts) AS peak, lag(value) OVER (PARTITION BY strategy ORDER BY ts) AS pv FROM equity),
rr AS (SELECT *, CASE WHEN pv > 0 THEN value / pv - 1 END AS ret, (peak - value) / nullif(peak, 0) AS dd FROM p),
q AS (SELECT strategy, quantile_cont(ret, 0.05) AS p05, quantile_cont(ret, 0.10) AS p10, quantile_cont(ret, 0.90) AS p90, avg(ret) AS m FROM rr GROUP BY 1),
a AS (SELECT strategy, arg_min(value, ts) AS initial, arg_max(value, ts) AS final, max(peak) AS peak, (epoch_us(max(ts)) - epoch_us(min(ts))) / 86400e6 AS days,
 count(ret) AS n, stddev_pop(ret) AS sd, stddev_pop(ret) FILTER (ret < 0) AS down, max(dd) AS max_drawdown, any_value(p05) AS var_95,
 avg(ret) FILTER (ret <= p05) AS cvar_95, avg((ret - m) ** 3) AS m3, avg((ret - m) ** 4) AS m4, any_value(p10) AS p10, any_value(p90) AS p90
 FROM rr JOIN q USING (strategy) GROUP BY 1),
b AS (SELECT *, (final - initial) / initial AS total_return, sd * sqrt(n * 365.25 / days) AS volatility, down * sqrt(n * 365.25 / days) AS dvol FROM a),
c AS (SELECT *, pow(1 + total_return, 365.25 / days) - 1 AS annualized_return FROM b),
perf AS (SELECT strategy, initial, final, peak, total_return, annualized_return, volatility, max_drawdown, (annualized_return - 0.02) / volatility AS sharpe,
 (annualized_return - 0.02) / dvol AS sortino, annualized_return / max_drawdown AS calmar, var_95, cvar_95, m3 / sd ** 3 AS skewness, m4 / sd ** 4 - 3 AS kurtosis, abs(p90 / p10) AS tail_ratio FROM c)"""
METRIC_NAMES = "total_return annualized_return volatility max_drawdown sharpe sortino calmar var_95 cvar_95 skewness kurtosis tail_ratio"


@query("a01_performance_metrics", sql("equity", f"WITH {METRICS_SQL} SELECT strategy, {rs('initial final peak', 2)}, {rs(METRIC_NAMES, 5)} FROM perf"))
def performance_metrics(spark, sf):
    return shaped(A.performance_metrics(V.equity(spark, sf), EQ), 5, per={"initial": 2, "final": 2, "peak": 2})


STATS = "total_trades winning_trades losing_trades".split()


@query("a02_trade_statistics", sql("closed_trades", f"""SELECT pair, count(*) AS total_trades, count(*) FILTER (pnl > 0) AS winning_trades, count(*) FILTER (pnl < 0) AS losing_trades,
{r('count(*) FILTER (pnl > 0) / count(*)')} AS win_rate, {r('avg(pnl) FILTER (pnl > 0)', 3)} AS average_win, {r('avg(pnl) FILTER (pnl < 0)', 3)} AS average_loss,
{r('max(pnl) FILTER (pnl > 0)', 3)} AS largest_win, {r('min(pnl) FILTER (pnl < 0)', 3)} AS largest_loss, {r('sum(pnl) FILTER (pnl > 0) / abs(sum(pnl) FILTER (pnl < 0))')} AS profit_factor,
{r('avg((epoch_us(exit_time) - epoch_us(entry_time)) / 3600e6)', 3)} AS average_hours FROM closed_trades GROUP BY 1"""))
def trade_statistics(spark, sf):
    return shaped(A.trade_statistics(V.closed_trades(spark, sf), ["pair"]), 3, per={"win_rate": 6, "profit_factor": 6})


@query("a03_trade_summary", sql("closed_trades", f"""WITH d AS (SELECT pnl FROM closed_trades WHERE status = 'CLOSED' AND exit_time >= TIMESTAMP '2001-10-01' - INTERVAL 60 DAY)
SELECT count(*) AS total_trades, count(*) FILTER (pnl > 0) AS winning_trades, count(*) FILTER (NOT pnl > 0) AS losing_trades, {r('coalesce(count(*) FILTER (pnl > 0) / nullif(count(*), 0), 0)')} AS win_rate,
{r('coalesce(sum(pnl), 0)', 2)} AS total_pnl, {r('coalesce(avg(pnl), 0)', 4)} AS average_pnl, {r('coalesce(max(pnl), 0)', 4)} AS max_win, {r('coalesce(min(pnl), 0)', 4)} AS max_loss FROM d"""))
def trade_summary(spark, sf):
    now = F.expr("timestamp'2001-10-01'")
    return shaped(A.trade_summary(V.closed_trades(spark, sf), now, 60), 4, per={"win_rate": 6, "total_pnl": 2})


@query("a04_hourly_metrics", sql("closed_trades", f"""WITH c AS (SELECT date_trunc('day', exit_time)::TIMESTAMP AS slice, exit_time, trade_id, pnl, sum(pnl) OVER (PARTITION BY date_trunc('day', exit_time) ORDER BY exit_time, trade_id ROWS UNBOUNDED PRECEDING) AS cum FROM closed_trades),
t AS (SELECT *, max(cum) OVER (PARTITION BY slice ORDER BY exit_time, trade_id ROWS UNBOUNDED PRECEDING) AS top FROM c)
SELECT slice, {r('sum(pnl)', 3)} AS pnl, count(*) AS trades, {r('coalesce(avg(pnl) / nullif(CASE WHEN count(*) > 1 THEN stddev_pop(pnl) END, 0), 0)')} AS sharpe, {r('abs(min(cum - top))', 3)} AS max_drawdown,
{r('count(*) FILTER (pnl > 0) / count(*)')} AS win_rate FROM t GROUP BY 1"""))
def hourly_metrics(spark, sf):
    d = A.hourly_trading_metrics(V.closed_trades(spark, sf), ("exit_time", "trade_id"), "day")
    return shaped(d, per={"pnl": 3, "max_drawdown": 3})


@query("a05_resample", sql("ticks", f"""WITH d AS (SELECT symbol, date_trunc('day', ts)::TIMESTAMP AS bucket, sum(price) AS total, arg_max(channel, (ts, seq)) AS label FROM ticks GROUP BY 1, 2),
s AS (SELECT symbol, unnest(generate_series(min(bucket), max(bucket), INTERVAL 1 DAY)) AS bucket FROM d GROUP BY 1)
SELECT symbol, bucket, {r('coalesce(total, 0)')} AS total, label FROM s LEFT JOIN d USING (symbol, bucket)"""))
def resample(spark, sf):
    return shaped(A.resample(V.ticks(spark, sf), ["symbol"], "price", "channel"))


@query("a06_recent_performance", sql("closed_trades", f"""WITH d AS (SELECT *, sum(pnl) OVER (ORDER BY exit_time, trade_id ROWS UNBOUNDED PRECEDING) AS cum FROM closed_trades WHERE exit_time BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-12-31')
SELECT {r('avg(pnl)', 4)} AS avg_return, {r('count(CASE WHEN pnl > 0 THEN 1 END) * 1.0 / count(*)')} AS win_rate, {r('abs(min(cum))', 2)} AS max_drawdown, {r('avg(pnl) / stddev_samp(pnl)')} AS sharpe FROM d"""))
def recent_performance(spark, sf):
    a, b = F.expr("timestamp'1998-01-01'"), F.expr("timestamp'1998-12-31'")
    return shaped(A.recent_performance(V.closed_trades(spark, sf), a, b, TRADES), per={"avg_return": 4, "max_drawdown": 2})


@query("a07_regime_statistics", sql("regimes", f"""SELECT regime, count(*) AS count, {r('100.0 * count(*) / sum(count(*)) OVER ()', 4)} AS percent, {r('avg(confidence)')} AS mean, {r('min(confidence)')} AS min,
{r('max(confidence)')} AS max, {r('stddev_pop(confidence)')} AS std FROM regimes GROUP BY 1"""))
def regime_statistics(spark, sf):
    return shaped(A.regime_statistics(V.regimes(spark, sf)), per={"percent": 4})


@query("a07b_current_regime", sql("regimes", "SELECT symbol, arg_max(regime, (ts, seq)) AS current FROM regimes GROUP BY 1"))
def current_regime(spark, sf):
    return A.current_regime(V.regimes(spark, sf))


@query("a08_transition_matrix", sql("regimes", f"""WITH c AS (SELECT previous AS "from", regime AS "to", count(*) AS count FROM regimes WHERE previous IS NOT NULL GROUP BY 1, 2)
SELECT "from", "to", count, {r('count / sum(count) OVER (PARTITION BY "from")')} AS probability FROM c"""))
def transition_matrix(spark, sf):
    return shaped(A.transition_matrix(V.regimes(spark, sf), "regime"))


@query("a09_regime_durations", sql("regimes", f"""WITH s AS (SELECT symbol, ts, seq, regime FROM regimes WHERE previous IS NULL OR previous <> regime),
d AS (SELECT regime, (epoch_us(lead(ts) OVER (PARTITION BY symbol ORDER BY ts, seq)) - epoch_us(ts)) / 3600e6 AS h FROM s)
SELECT regime, count(h) AS spells, {r('avg(h)')} AS mean, {r('stddev_pop(h)')} AS std, {r('min(h)')} AS min, {r('max(h)')} AS max, {r('quantile_cont(h, 0.5)')} AS median FROM d WHERE h IS NOT NULL GROUP BY 1"""))
def regime_durations(spark, sf):
    return shaped(A.regime_durations(V.regimes(spark, sf), "regime"))


def _alerts(spark, sf):
    return V.regimes(spark, sf).select("ts", F.explode(X.regime_alerts("regime", "previous", "confidence")).alias("a")).select("ts", "a.*")


_HV = ", ".join(f"'{x}'" for x in X.HIGH_VOLATILITY)
ALERTS = f"""alerts AS (SELECT ts, 'regime_change' AS alert_type, CASE WHEN confidence > 0.7 THEN 'medium' ELSE 'low' END AS severity FROM regimes WHERE regime <> previous
UNION ALL SELECT ts, 'high_volatility', CASE WHEN regime = 'crisis' THEN 'high' ELSE 'medium' END FROM regimes WHERE regime IN ({_HV})
UNION ALL SELECT ts, 'crisis_detected', 'critical' FROM regimes WHERE regime = 'crisis'
UNION ALL SELECT ts, 'low_confidence', 'medium' FROM regimes WHERE confidence < 0.5
UNION ALL SELECT ts, 'emergency_regime', 'critical' FROM regimes WHERE regime = 'crisis')"""


@query("a10_alert_counts", sql("regimes", f"""WITH {ALERTS}, d AS (SELECT (epoch_us(max(ts)) - epoch_us(min(ts))) / 86400e6 AS days FROM alerts)
SELECT alert_type, severity, count(*) AS count, count(*) FILTER (severity = 'critical') AS critical, {r('count(*) / any_value(days)')} AS per_day FROM alerts, d GROUP BY GROUPING SETS ((alert_type), (severity), ())"""))
def alert_counts(spark, sf):
    return shaped(A.alert_counts(_alerts(spark, sf)))


@query("a11_best_worst", sql("equity", f"WITH {METRICS_SQL} SELECT arg_max(strategy, sharpe) AS best, {r('max(sharpe)', 5)} AS best_score, arg_min(strategy, sharpe) AS worst, {r('min(sharpe)', 5)} AS worst_score FROM perf"))
def best_worst(spark, sf):
    return shaped(A.best_worst(A.performance_metrics(V.equity(spark, sf), EQ), "strategy", "sharpe"), 5)


EXCHANGES = ["O", "F"]


@query("a12_exchange_flow_totals", sql("fills", f"""WITH f AS (SELECT symbol, date_trunc('month', ts)::TIMESTAMP AS ts, book_side AS exchange, sum(CASE side WHEN 'sell' THEN quantity ELSE 0 END) AS inflow, sum(CASE side WHEN 'buy' THEN quantity ELSE 0 END) AS outflow FROM fills GROUP BY 1, 2, 3),
d AS (SELECT symbol, ts, sum(inflow) AS inflow, sum(outflow) AS outflow, sum(outflow - inflow) FILTER (exchange = 'O') AS net_O, sum(outflow - inflow) FILTER (exchange = 'F') AS net_F FROM f GROUP BY 1, 2)
SELECT symbol, ts, inflow, outflow, net_O, net_F, outflow - inflow AS net_flow, {r('CASE WHEN outflow > 0 THEN inflow / outflow ELSE 0 END')} AS ratio FROM d"""))
def exchange_flow_totals(spark, sf):
    f = V.fills(spark, sf).groupBy("symbol", F.date_trunc("month", "ts").alias("ts"), F.col("book_side").alias("exchange")).agg(
        F.sum(F.when(F.col("side") == "sell", F.col("quantity")).otherwise(0.0)).alias("inflow"),
        F.sum(F.when(F.col("side") == "buy", F.col("quantity")).otherwise(0.0)).alias("outflow"))
    return shaped(A.exchange_flow_totals(f, EXCHANGES))


@query("a13_series_statistics", sql("ticks", f"""SELECT symbol, count(price) AS n, {r('avg(price)')} AS mean, {r('stddev_pop(price)')} AS std, {r('min(price)')} AS min, {r('max(price)')} AS max, {r('skewness(price)')} AS skewness,
{r('kurtosis(price)')} AS kurtosis, {r('median(price)')} AS median FROM ticks GROUP BY 1"""))
def series_statistics(spark, sf):
    return shaped(A.series_statistics(V.ticks(spark, sf), ["symbol"], "price"))


CORR = "corrs AS (SELECT a.symbol AS a, b.symbol AS b, count(*) AS n, coalesce(corr(a.close, b.close), 0.0) AS corr FROM nation_bars a JOIN nation_bars b ON a.ts = b.ts AND a.symbol < b.symbol GROUP BY 1, 2 HAVING count(*) >= 5)"


@query("a14_correlation_matrix", sql("nation_bars", f"WITH {CORR} SELECT a, b, n, {r('corr')} AS corr FROM corrs"))
def correlation_matrix(spark, sf):
    return shaped(A.correlation_matrix(V.nation_bars(spark, sf)))


def _cv_results(spark, sf):
    return A.performance_metrics(V.equity(spark, sf), EQ).withColumnRenamed("strategy", "split_id")


CVM = ["total_return", "volatility", "max_drawdown", "sharpe", "sortino"]


@query("a15_cv_aggregate", sql("equity", f"""WITH {METRICS_SQL}, l AS (UNPIVOT (SELECT strategy, {', '.join(CVM)} FROM perf) ON {', '.join(CVM)} INTO NAME metric VALUE value)
SELECT metric, {r('avg(value)', 5)} AS mean, {r('stddev_samp(value)', 5)} AS std, {r('min(value)', 5)} AS min, {r('max(value)', 5)} AS max, {r('list_sort(list(value))[count(value) // 2 + 1]', 5)} AS median, count(value) AS count FROM l GROUP BY 1"""))
def cv_aggregate(spark, sf):
    return shaped(A.cv_aggregate(_cv_results(spark, sf), CVM), 5)


@query("a15b_cv_consistency", sql("equity", f"""WITH {METRICS_SQL} SELECT count(*) AS splits, {r('count(total_return) / count(*)')} AS success_rate, {r('1 - stddev_samp(total_return) / abs(avg(total_return))', 5)} AS return_consistency,
{r('count(*) FILTER (total_return > 0) / count(total_return)')} AS positive_rate, {r('1 - stddev_samp(sharpe) / abs(avg(sharpe))', 5)} AS sharpe_consistency FROM perf"""))
def cv_consistency(spark, sf):
    return shaped(A.cv_consistency(_cv_results(spark, sf)), 5, per={"success_rate": 6, "positive_rate": 6})


KELLY = """t AS (SELECT pair, pnl / notional AS ret, row_number() OVER (PARTITION BY pair ORDER BY exit_time DESC, trade_id DESC) AS k, count(*) OVER (PARTITION BY pair) AS total FROM closed_trades),
g AS (SELECT pair, any_value(total) AS total, count(*) AS used, avg(ret) FILTER (ret > 0) AS avg_win, abs(avg(ret) FILTER (ret < 0)) AS avg_loss, count(*) FILTER (ret > 0) / count(*) AS win_rate FROM t WHERE k <= 100 GROUP BY 1),
h AS (SELECT *, CASE WHEN total < 20 THEN 'insufficient_trades' WHEN avg_win IS NULL OR avg_loss IS NULL THEN 'no_wins_or_losses' ELSE 'ok' END AS reason, avg_win / nullif(avg_loss, 0) AS b FROM g),
kelly AS (SELECT *, CASE WHEN reason = 'ok' THEN greatest(0.0, (b * win_rate - (1 - win_rate)) / b) ELSE 0.0 END AS kelly FROM h)"""


def fraction_of_pairs(spark, sf):
    d = V.closed_trades(spark, sf).withColumn("ret", F.col("pnl") / F.col("notional"))
    return A.kelly_fraction(d, TRADES)


@query("a16_kelly_fraction", sql("closed_trades", f"WITH {KELLY} SELECT pair, total, used, reason, {rs('avg_win avg_loss win_rate kelly')} FROM kelly"))
def kelly_fraction(spark, sf):
    return shaped(fraction_of_pairs(spark, sf), columns="pair total used reason avg_win avg_loss win_rate kelly")


@query("a17_kelly_position_size", sql("closed_trades", f"""WITH {KELLY} SELECT pair, {r('CASE WHEN kelly > 0 THEN least(total * 1000.0 * kelly * 0.25, total * 1000.0 * 0.1) ELSE 0 END', 4)} AS size,
CASE WHEN kelly <= 0 THEN 'none' WHEN total * 1000.0 * kelly * 0.25 <= total * 1000.0 * 0.1 THEN 'kelly' ELSE 'max_position' END AS limited_by FROM kelly"""))
def kelly_position_size(spark, sf):
    d = A.kelly_position_size(fraction_of_pairs(spark, sf).withColumn("value", F.col("total") * 1000.0), "value")
    return shaped(d, 4, "pair size limited_by")


def _held(spark, sf):
    d = K.last_positions(V.fills(spark, sf)).withColumn("market_value", F.col("position") * F.col("last_price"))
    return d.join(V.table(spark, sf, "supplier").select(F.concat(F.lit("P"), F.col("s_suppkey").cast("string")).alias("symbol"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("account")), "symbol")


@query("a18_exposures", sql("fills", f"""WITH p AS (SELECT symbol, sum(CASE side WHEN 'buy' THEN quantity ELSE -quantity END) * arg_max(price, (ts, seq)) AS v FROM fills GROUP BY 1),
h AS (SELECT p.*, 'N' || s_nationkey AS account FROM p JOIN supplier ON symbol = 'P' || s_suppkey)
SELECT account, {r('sum(v)', 2)} AS net, {r('sum(abs(v))', 2)} AS gross, count(*) FILTER (abs(v) > 1e-8) AS active, {r('max(abs(v))', 2)} AS largest, arg_max(symbol, (abs(v), symbol)) AS largest_symbol,
{r('max(abs(v)) / sum(abs(v))')} AS concentration FROM h GROUP BY 1"""))
def exposures(spark, sf):
    return shaped(K.exposures(_held(spark, sf), "account"), 2, per={"concentration": 6})


POSITIONS_SQL = """o AS (SELECT symbol, ts, seq, price, fee, CASE side WHEN 'buy' THEN quantity ELSE -quantity END AS q, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS k FROM fills),
pos AS (SELECT symbol, k, ts, seq, price, fee, q AS position, price AS cost, 0.0::DOUBLE AS realized FROM o WHERE k = 1
 UNION ALL SELECT o.symbol, o.k, o.ts, o.seq, o.price, o.fee, p.position + o.q,
 CASE WHEN abs(p.position) < 1e-8 THEN o.price WHEN sign(p.position) = sign(o.q) THEN (p.cost * abs(p.position) + o.price * abs(o.q)) / abs(p.position + o.q)
  WHEN abs(o.q) >= abs(p.position) THEN CASE WHEN abs(p.position + o.q) < 1e-8 THEN 0.0 ELSE o.price END ELSE p.cost END,
 CASE WHEN abs(p.position) < 1e-8 OR sign(p.position) = sign(o.q) THEN 0.0 ELSE (o.price - p.cost) * least(abs(o.q), abs(p.position)) * sign(p.position) END
 FROM pos p JOIN o ON o.symbol = p.symbol AND o.k = p.k + 1),
positions AS (SELECT *, sum(realized) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS realized_total,
 CASE WHEN abs(position) < 1e-8 THEN 0.0 ELSE (price - cost) * position END AS unrealized FROM pos)"""


@query("a19_portfolio_performance", sql("equity", f"""WITH d AS (SELECT strategy, date_trunc('month', ts)::DATE AS day, arg_max(value, ts) AS end_value FROM equity GROUP BY 1, 2),
s AS (SELECT *, lag(end_value) OVER (PARTITION BY strategy ORDER BY day) AS start_value FROM d), x AS (SELECT strategy, CASE WHEN start_value > 0 THEN end_value / start_value - 1 END AS x FROM s),
g AS (SELECT strategy, avg(x) AS avg_daily, stddev_pop(x) AS daily_volatility FROM x GROUP BY 1)
SELECT strategy, {rs('avg_daily daily_volatility')}, {r('avg_daily / daily_volatility')} AS sharpe, {r('avg_daily * 252', 4)} AS annual_return, {r('daily_volatility * sqrt(252)', 4)} AS annual_volatility,
{r('avg_daily / daily_volatility * sqrt(252)', 5)} AS annual_sharpe FROM g"""))
def portfolio_performance(spark, sf):
    from pyspark.sql import Window

    d = V.equity(spark, sf).groupBy("strategy", F.date_trunc("month", "ts").alias("day")).agg(F.max_by("value", "ts").alias("end_value"))
    d = d.withColumn("start_value", F.lag("end_value", 1).over(Window.partitionBy("strategy").orderBy("day")))
    return shaped(A.portfolio_performance(d, ["strategy"]), per={"annual_return": 4, "annual_volatility": 4, "annual_sharpe": 5})


@query("a20_daily_pnl", sql("fills", f"""WITH RECURSIVE {POSITIONS_SQL},
f AS (SELECT *, ts::DATE AS day, 1000000 + realized_total + unrealized - sum(fee) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS value FROM positions),
h AS (SELECT *, max(value) OVER (PARTITION BY symbol, day ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS high FROM f),
g AS (SELECT symbol, day, sum(realized) AS realized, arg_max(unrealized, (ts, seq)) AS unrealized, sum(fee) AS fees, max(value) AS high_water, min(value) AS low_water, max((high - value) / high) AS max_drawdown, arg_max(value, (ts, seq)) AS end_value FROM h GROUP BY 1, 2)
SELECT symbol, day, {rs('realized unrealized fees high_water low_water end_value', 2)}, {r('max_drawdown')} AS max_drawdown, {r('coalesce(lag(end_value) OVER (PARTITION BY symbol ORDER BY day), 1000000)', 2)} AS start_value FROM g"""))
def daily_pnl(spark, sf):
    d = V.fills(spark, sf).select("symbol", "ts", "seq", "side", "quantity", "price", "fee")
    d = by_key_size(d, TICKS, lambda x, s: K.daily_pnl(K.average_cost_positions(x, s), s))
    return shaped(d, 2, per={"max_drawdown": 6})


KINDS = ["view", "click", "purchase"]


@query("a21_signal_statistics", sql("ticks", f"""SELECT symbol, count(*) AS total, {", ".join(f"count(*) FILTER (channel = '{k}') AS n_{k}" for k in KINDS)}, {r('avg(least(price / 100, 1.0)) FILTER (price > 0)')} AS mean_confidence, max(ts) AS last_ts,
{r('avg(price - 50)')} AS spread_mean, {r('stddev_samp(price - 50)')} AS spread_std, {r('min(price - 50)')} AS spread_min, {r('max(price - 50)')} AS spread_max FROM ticks GROUP BY 1"""))
def signal_statistics(spark, sf):
    d = V.ticks(spark, sf).select("symbol", "ts", F.col("channel").alias("signal"), F.least(F.col("price") / 100, F.lit(1.0)).alias("confidence"), (F.col("price") - 50).alias("spread"))
    return shaped(A.signal_statistics(d, ["symbol"], KINDS))


@query("a22_anomaly_statistics", sql("ticks", f"""WITH a AS (SELECT channel AS anomaly_type, date_trunc('hour', ts) AS c, CASE WHEN price >= 225 THEN 'critical' WHEN price >= 150 THEN 'high' WHEN price >= 112.5 THEN 'medium' ELSE 'low' END AS severity, props LIKE '%1%' AS fp FROM ticks WHERE price >= 75)
SELECT anomaly_type, count(DISTINCT c) AS cycles, count(*) AS anomalies, count(*) FILTER (severity = 'low') AS low, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'high') AS high,
count(*) FILTER (severity = 'critical') AS critical, {r('count(*) FILTER (fp) / count(*)')} AS false_positive_rate, {r('count(*) / count(DISTINCT c)')} AS per_cycle FROM a GROUP BY 1"""))
def anomaly_statistics(spark, sf):
    d = V.ticks(spark, sf).filter("price >= 75").withColumns({"severity": X.severity("price", 75.0), "anomaly_type": F.col("channel"), "false_positive": F.col("props").contains("1")})
    return shaped(A.anomaly_statistics(d, F.date_trunc("hour", "ts")))


@query("a23_context_summary", sql("ticks", f"""SELECT symbol, count(*) AS points, CASE WHEN count(*) > 1 AND arg_max(price, (ts, seq)) < arg_min(price, (ts, seq)) THEN 'declining' ELSE 'stable' END AS trend,
{r('avg(price)')} AS mean, {r('max(price)')} AS peak, {r('sum(price)', 4)} AS total, {r('arg_max(price, (ts, seq))')} AS latest FROM ticks GROUP BY 1"""))
def context_summary(spark, sf):
    return shaped(A.context_summary(V.ticks(spark, sf), Series(), "price"), per={"total": 4})


@query("a24_trade_counters", sql("closed_trades", f"""SELECT pair, side, CASE WHEN pnl > 0 THEN 'win' WHEN pnl < 0 THEN 'loss' ELSE 'breakeven' END AS result, count(*) AS trades, {r('sum(abs(notional))', 2)} AS volume, {r('sum(fee)', 2)} AS fees FROM closed_trades GROUP BY 1, 2, 3"""))
def trade_counters(spark, sf):
    return shaped(A.trade_counters(V.closed_trades(spark, sf)), 2)


@query("a25_latency_quantiles", sql("ticks", f"""SELECT channel, time_bucket(INTERVAL 5 MINUTE, ts)::TIMESTAMP AS window_start, {r('quantile_cont(price, 0.5)')} AS p50, {r('quantile_cont(price, 0.95)')} AS p95 FROM ticks GROUP BY 1, 2"""))
def latency_quantiles(spark, sf):
    return shaped(A.latency_quantiles(V.ticks(spark, sf), "channel", "price"))


@query("a26_counter_increase", sql("ticks", f"""WITH d AS (SELECT *, lag(price) OVER (PARTITION BY symbol ORDER BY ts, seq) AS p FROM ticks)
SELECT symbol, time_bucket(INTERVAL 1 DAY, ts)::TIMESTAMP AS window_start, {r('sum(CASE WHEN p IS NULL THEN 0 WHEN price < p THEN price ELSE price - p END)')} AS increase,
{r('sum(CASE WHEN p IS NULL THEN 0 WHEN price < p THEN price ELSE price - p END) / 86400', 8)} AS rate FROM d GROUP BY 1, 2"""))
def counter_increase(spark, sf):
    return shaped(A.counter_increase(V.ticks(spark, sf), Series(), "price", "1 day"), per={"rate": 8})


@query("a27_position_summary", sql("fills", f"SELECT symbol, side, sum(quantity) AS quantity, {r('sum(quantity * price)', 2)} AS notional FROM fills GROUP BY 1, 2"))
def position_summary(spark, sf):
    return shaped(A.position_summary(V.fills(spark, sf)), 2)


CLUSTERS = "clusters AS (SELECT DISTINCT ts AS window_id, (close > 225000)::INTEGER AS label, symbol FROM nation_bars)"


def _clusters(spark, sf):
    return V.nation_bars(spark, sf).select(F.col("ts").alias("window_id"), (F.col("close") > 225000).cast("int").alias("label"), "symbol")


@query("a28_pair_cooccurrence", sql("nation_bars", f"""WITH {CLUSTERS} SELECT a.symbol AS a, b.symbol AS b, count(*) AS together FROM clusters a JOIN clusters b ON a.window_id = b.window_id AND a.label = b.label AND a.symbol < b.symbol
GROUP BY 1, 2 ORDER BY together DESC, a, b LIMIT 20"""))
def pair_cooccurrence(spark, sf):
    return A.pair_cooccurrence(_clusters(spark, sf), 20)


@query("a29_cluster_evaluation", sql("nation_bars", f"""WITH q AS (SELECT ts, avg(close) / 1e6 AS silhouette, min(close) / 1e6 AS stability, count(DISTINCT close > 225000)::DOUBLE AS clusters FROM nation_bars GROUP BY 1),
o AS (SELECT close / 1e6 AS expected_return FROM nation_bars WHERE close > 300000)
SELECT {r('avg(silhouette)')} AS silhouette, {r('avg(stability)')} AS stability, {r('var_pop(stability)')} AS stability_variance, {r('avg(clusters)')} AS clusters, count(*) AS windows, (SELECT count(*) FROM o) AS opportunities,
{r('(SELECT avg(expected_return) FROM o)')} AS expected_return, {r('(SELECT count(DISTINCT symbol) FROM nation_bars WHERE close > 400000) / (SELECT count(DISTINCT symbol) FROM nation_bars)')} AS coverage,
{r('(SELECT count(*) FROM o) / count(*)')} AS per_window FROM q"""))
def cluster_evaluation(spark, sf):
    b = V.nation_bars(spark, sf)
    q = b.groupBy("ts").agg((F.avg("close") / 1e6).alias("silhouette"), (F.min("close") / 1e6).alias("stability"), F.countDistinct(F.col("close") > 225000).cast("double").alias("clusters"))
    o = b.filter("close > 300000").select((F.col("close") / 1e6).alias("expected_return"))
    return shaped(A.cluster_evaluation(b.filter("close > 400000"), q, o, b))


PRED = """pr AS (SELECT channel AS l, CASE WHEN price > 60 THEN 'view' WHEN price > 30 THEN 'click' ELSE 'error' END AS p FROM ticks)"""


@query("a30_classification_quality", sql("ticks", f"""WITH {PRED}, n AS (SELECT count(*) AS total FROM pr), tr AS (SELECT l AS c, count(*) AS support, count(*) FILTER (l = p) AS tp FROM pr GROUP BY 1), se AS (SELECT p AS c, count(*) AS predicted FROM pr GROUP BY 1),
m AS (SELECT support, tp, coalesce(tp / nullif(predicted, 0), 0) AS prec, tp / support AS rec FROM tr LEFT JOIN se USING (c)), g AS (SELECT *, coalesce(2 * prec * rec / nullif(prec + rec, 0), 0) AS f1 FROM m)
SELECT {r('sum(tp) / sum(support)')} AS accuracy, {r('sum(prec * support) / sum(support)')} AS precision, {r('sum(rec * support) / sum(support)')} AS recall, {r('sum(f1 * support) / sum(support)')} AS f1 FROM g"""))
def classification_quality(spark, sf):
    p = F.when(F.col("price") > 60, "view").when(F.col("price") > 30, "click").otherwise("error")
    return shaped(A.classification_quality(V.ticks(spark, sf).withColumn("p", p), "channel", "p"))


@query("a30b_regression_quality", sql("bars", f"""SELECT {r('avg((close - open) ** 2)', 4)} AS mse, {r('avg(abs(close - open))')} AS mae, {r('1 - sum((close - open) ** 2) / (var_pop(close) * count(*))')} AS r2 FROM bars"""))
def regression_quality(spark, sf):
    return shaped(A.regression_quality(V.bars_1h(spark, sf), "close", "open"), per={"mse": 4})


@query("a32_service_health", sql("ticks", f"""WITH d AS (SELECT symbol, arg_max(channel, (ts, seq)) AS status, max(ts) AS last_seen FROM ticks GROUP BY 1)
SELECT symbol, status, last_seen, {r("(epoch_us(TIMESTAMP '2024-01-31') - epoch_us(last_seen)) / 1e6", 3)} AS age_s, epoch_us(TIMESTAMP '2024-01-31') - epoch_us(last_seen) <= 86400e6 AS healthy FROM d"""))
def service_health(spark, sf):
    d = A.service_health(V.ticks(spark, sf).withColumn("status", F.col("channel")), F.expr("timestamp'2024-01-31'"), 86400.0, "symbol")
    return shaped(d, 3)


@query("e23_latest_halts", sql("equity", f"""WITH d AS (SELECT strategy, date_trunc('month', ts)::TIMESTAMP AS day, arg_max(value, ts) AS end_value, max(value) AS high_water FROM equity GROUP BY 1, 2),
s AS (SELECT *, lag(end_value) OVER (PARTITION BY strategy ORDER BY day) AS start_value, max(high_water) OVER (PARTITION BY strategy ORDER BY day) AS high FROM d),
l AS (SELECT strategy, day, CASE WHEN start_value > 0 THEN (start_value - end_value) / start_value ELSE 0.0 END AS daily_loss, (high - end_value) / high AS drawdown FROM s)
SELECT strategy, day, {rs('daily_loss drawdown')}, CASE WHEN daily_loss > 0.05 THEN 'daily_loss_limit' ELSE 'max_drawdown' END AS reason FROM l WHERE daily_loss > 0.05 OR drawdown > 0.15"""))
def latest_halts(spark, sf):
    from pyspark.sql import Window

    from tidemark.operators.policy import latest_halts as run

    d = V.equity(spark, sf).groupBy("strategy", F.date_trunc("month", "ts").alias("day")).agg(F.max_by("value", "ts").alias("end_value"), F.max("value").alias("high_water"))
    d = d.withColumn("start_value", F.lag("end_value", 1).over(Window.partitionBy("strategy").orderBy("day")))
    return shaped(run(d, ["strategy"]), columns="strategy day daily_loss drawdown reason")
