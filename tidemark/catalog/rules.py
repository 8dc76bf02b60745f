"""Scalar rule queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.base import query, r, rs, shaped, sql
from tidemark.functions import rules as X
from tidemark.operators import aggregates as A
from tidemark.operators import policy as P
from tidemark.operators import rolling as R
from tidemark.plans.series import BARS, Series
from tidemark.sources import views as V


def case(column: str, table: dict, default: str = "NULL") -> str:
    def lit(v):
        return f"'{v}'" if isinstance(v, str) else repr(v)

    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {lit(v)}" for k, v in table.items()) + f" ELSE {default} END"


@query("e01_severity", sql("ticks", """SELECT symbol, seq, CASE WHEN price >= 150 THEN 'critical' WHEN price >= 100 THEN 'high'
 WHEN price >= 75 THEN 'medium' ELSE 'low' END AS severity FROM ticks"""))
def severity(spark, sf):
    return V.ticks(spark, sf).select("symbol", "seq", X.severity("price", 50.0).alias("severity"))


@query("e02_changepoint_level", sql("regimes", """SELECT symbol, seq, CASE WHEN confidence >= 0.9 THEN 'very_high' WHEN confidence >= 0.7 THEN 'high'
 WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS level FROM regimes"""))
def changepoint_level(spark, sf):
    return V.regimes(spark, sf).select("symbol", "seq", X.changepoint_level("confidence").alias("level"))


@query("e03_confidence_level", sql("regimes", """SELECT symbol, seq, CASE WHEN confidence >= 0.9 THEN 'very_high' WHEN confidence >= 0.7 THEN 'high'
 WHEN confidence >= 0.5 THEN 'medium' WHEN confidence >= 0.3 THEN 'low' ELSE 'very_low' END AS level FROM regimes"""))
def confidence_level(spark, sf):
    return V.regimes(spark, sf).select("symbol", "seq", X.confidence_level("confidence").alias("level"))


STRENGTH_SQL = """CASE WHEN price / 40.0 >= 2 THEN 'very_strong' WHEN price / 40.0 >= 1.5 THEN 'strong' WHEN price / 40.0 >= 1.2 THEN 'medium' ELSE 'weak' END"""


@query("e04_signal_strength", sql("ticks", f"SELECT symbol, seq, {STRENGTH_SQL} AS strength FROM ticks"))
def signal_strength(spark, sf):
    return V.ticks(spark, sf).select("symbol", "seq", X.signal_strength("price", F.lit(40.0)).alias("strength"))


def _signals(spark, sf):
    d = V.ticks(spark, sf)
    regime = F.when(F.col("channel").isin("view", "click"), "normal").when(F.col("channel") == "error", "high").when(F.col("channel") == "signup", "low")
    d = d.withColumns({"strength": X.signal_strength("price", F.lit(40.0)), "vol_regime": regime, "width": F.col("price") / 50})
    return d.withColumn("confidence", X.signal_confidence("strength", X.width_confidence("width"), "vol_regime"))


SIGNALS = f"""s0 AS (SELECT *, {STRENGTH_SQL} AS strength, CASE WHEN channel IN ('view','click') THEN 'normal' WHEN channel = 'error' THEN 'high' WHEN channel = 'signup' THEN 'low' END AS vol_regime,
 1 / (1 + price / 50) AS hedge FROM ticks),
s1 AS (SELECT *, {case('strength', X.STRENGTH_CONFIDENCE)} AS base, {case('vol_regime', X.REGIME_WEIGHT)} AS weight FROM s0),
s2 AS (SELECT *, (base + CASE WHEN weight IS NULL THEN hedge ELSE (hedge + weight) / 2 END) / 2 AS c FROM s1),
signals AS (SELECT *, CASE vol_regime WHEN 'high' THEN c * 0.8 WHEN 'low' THEN least(1.0, c * 1.1) ELSE c END AS confidence FROM s2)"""


@query("e05_signal_confidence", sql("ticks", f"WITH {SIGNALS} SELECT symbol, seq, {r('confidence')} AS confidence FROM signals"))
def signal_confidence(spark, sf):
    return shaped(_signals(spark, sf), columns="symbol seq confidence")


@query("e06_confidence_filter", sql("ticks", f"WITH {SIGNALS} SELECT symbol, seq, CASE WHEN confidence < 0.6 THEN 'hold' ELSE channel END AS signal FROM signals"))
def confidence_filter(spark, sf):
    return _signals(spark, sf).select("symbol", "seq", X.confidence_filter("channel", "confidence").alias("signal"))


@query("e07_order_size", sql("ticks", f"""WITH {SIGNALS},
o AS (SELECT symbol, seq, least(greatest(50000 * 0.02 * confidence * {case('strength', X.STRENGTH_SIZE, '0.75')}
 * CASE WHEN price / 300 > 0.15 THEN 0.7 WHEN price / 300 < 0.05 AND price <> 0 THEN 1.2 ELSE 1.0 END
 * CASE WHEN price / 20 > 3 THEN 0.8 WHEN price / 20 > 0 AND price / 20 < 1.5 THEN 1.1 ELSE 1.0 END, 10.0), 1000.0) AS size FROM signals)
SELECT symbol, seq, {r('size', 4)} AS size FROM o"""))
def order_size(spark, sf):
    d = _signals(spark, sf).withColumn("size", X.order_size(F.lit(50000.0), "confidence", "strength", F.col("price") / 300, F.col("price") / 20))
    return shaped(d, 4, "symbol seq size")


@query("e08_pair_legs", sql("bars", f"""SELECT symbol, ts, {r('1000 / nullif(high, 0)')} AS quantity1, {r('1000 * 1.5 / nullif(low, 0)')} AS quantity2,
 CASE WHEN close > open THEN 'buy' ELSE 'sell' END AS side1, CASE WHEN close > open THEN 'sell' ELSE 'buy' END AS side2 FROM bars"""))
def pair_legs(spark, sf):
    d = V.bars_1h(spark, sf).withColumn("direction", F.when(F.col("close") > F.col("open"), "long").otherwise("short"))
    legs = X.pair_legs(F.lit(1000.0), "high", "low", F.lit(1.5), "direction")
    return shaped(d.withColumn("l", legs).select("symbol", "ts", "l.*"))


FIVE = """CASE WHEN {x} > {o} THEN 'very_bullish' WHEN {x} > {i} THEN 'bullish' WHEN {x} < -{o} THEN 'very_bearish' WHEN {x} < -{i} THEN 'bearish' ELSE 'neutral' END"""


@query("e09_return_label", sql("bars", f"""WITH f AS (SELECT symbol, ts, close, ts + INTERVAL 1 DAY AS later FROM bars),
b AS (SELECT f.*, p.ts AS bts, p.close AS bclose FROM f ASOF LEFT JOIN bars p ON f.symbol = p.symbol AND f.later >= p.ts),
n AS (SELECT b.*, p.ts AS nts, p.close AS nclose FROM b ASOF LEFT JOIN bars p ON b.symbol = p.symbol AND b.later <= p.ts),
c AS (SELECT symbol, ts, close, CASE WHEN bts IS NULL OR nts - later <= later - bts THEN nclose ELSE bclose END AS future FROM n),
d AS (SELECT *, (future - close) / nullif(close, 0) AS ret FROM c)
SELECT symbol, ts, {r('future')} AS future, {FIVE.format(x='ret', i=0.005, o=0.02)} AS label FROM d"""))
def return_label(spark, sf):
    from tidemark.operators.joins import return_labels

    bars = V.bars_1h(spark, sf).select("symbol", "ts", "close")
    return shaped(return_labels(bars, bars, days=1), columns="symbol ts future label")


@query("e10_label_score", sql("ticks", f"""SELECT symbol, seq, {FIVE.format(x='(price - 50) / 100', i=0.1, o=0.5)} AS label,
 {case(FIVE.format(x='(price - 50) / 100', i=0.1, o=0.5), X.LABEL_SCORES, '0.0')}::DOUBLE AS score FROM ticks"""))
def label_score(spark, sf):
    d = V.ticks(spark, sf).withColumn("label", X.five_way((F.col("price") - 50) / 100, 0.1, 0.5))
    return d.select("symbol", "seq", "label", X.label_score("label").alias("score"))


@query("e11_sentiments", sql("ticks", f"""SELECT symbol, seq, {FIVE.format(x='(price / 50 - 1)', i=0.2, o=0.5)} AS whale,
 CASE WHEN price / 100 > 0.8 THEN 'bullish' WHEN price / 100 > 0.6 THEN 'neutral' ELSE 'bearish' END AS network,
 price * 40 - 2000 > 1000 AS outflow, price * 40 - 2000 < -1000 AS inflow, price / 100 > 0.7 AS congested FROM ticks"""))
def sentiments(spark, sf):
    net = F.col("price") * 40 - 2000
    return V.ticks(spark, sf).select(
        "symbol", "seq", X.five_way(F.col("price") / 50 - 1, 0.2, 0.5).alias("whale"),
        X.network_sentiment(F.col("price") / 100).alias("network"), (net > 1000).alias("outflow"),
        (net < -1000).alias("inflow"), (F.col("price") / 100 > 0.7).alias("congested"))


@query("e12_signal_alerts", sql("ticks", f"""SELECT symbol, seq, {r('abs(price / 100 - 0.5)')} AS actual, CASE WHEN abs(price / 100 - 0.5) > 0.9 THEN 'HIGH' ELSE 'MEDIUM' END AS severity
 FROM ticks WHERE abs(price / 100 - 0.5) > 0.8"""))
def signal_alerts(spark, sf):
    score = F.abs(F.col("price") / 100 - 0.5)
    d = V.ticks(spark, sf).withColumn("actual", score).filter(F.col("actual") > 0.8)
    return shaped(d.withColumn("severity", F.when(F.col("actual") > 0.9, "HIGH").otherwise("MEDIUM")), columns="symbol seq actual severity")


@query("e13_actions_metrics", sql("ticks", f"""WITH a AS (SELECT *, price / 100 - 0.5 AS score FROM ticks),
b AS (SELECT *, {FIVE.format(x='score', i=0.1, o=0.5)} AS label FROM a)
SELECT symbol, seq, CASE WHEN label LIKE '%bullish' THEN CASE WHEN abs(score) > 0.8 THEN 'STRONG_BUY' ELSE 'BUY' END
 WHEN label LIKE '%bearish' THEN CASE WHEN abs(score) > 0.8 THEN 'STRONG_SELL' ELSE 'SELL' END ELSE 'HOLD' END AS action,
 concat_ws(',', CASE WHEN score > 0.5 THEN 'exchange_outflow' END, CASE WHEN score > 0.5 THEN 'whale_transactions' END,
  CASE WHEN -score > 0.5 THEN 'exchange_inflow' END, CASE WHEN abs(score) > 0.1 THEN 'exchange_net_flow' END,
  CASE WHEN price > 0 THEN 'whale_transactions' END) AS metrics FROM b"""))
def actions_metrics(spark, sf):
    score = F.col("price") / 100 - 0.5
    return V.ticks(spark, sf).select(
        "symbol", "seq", X.recommended_action(score, X.five_way(score, 0.1, 0.5)).alias("action"),
        F.concat_ws(",", X.contributing_metrics(score, -score, score, "price")).alias("metrics"))


@query("e14_regime_from_state", sql("bars", """WITH a AS (SELECT symbol, ts, close / nullif(open, 0) - 1 AS x, (high - low) / nullif(low, 0) AS v FROM bars)
SELECT symbol, ts, CASE WHEN v > 0.5 AND x > 0.02 THEN 'high_vol_bull' WHEN v > 0.5 AND x < -0.02 THEN 'high_vol_bear' WHEN v > 0.5 THEN 'high_vol_range'
 WHEN x > 0.02 THEN 'low_vol_bull' WHEN x < -0.02 THEN 'low_vol_bear' WHEN abs(x) < 0.005 THEN 'stable_range' ELSE 'low_vol_range' END AS regime FROM a"""))
def regime_from_state(spark, sf):
    d = V.bars_1h(spark, sf).withColumns({"x": F.expr("try_divide(close, open) - 1"), "v": F.expr("try_divide(high - low, low)")})
    return shaped(d.withColumn("regime", X.regime_from_state("x", "v")), columns="symbol ts regime")


_HV = ", ".join(f"'{x}'" for x in X.HIGH_VOLATILITY)
_TR = ", ".join(f"'{x}'" for x in X.TRENDING)
_HR = ", ".join(f"'{x}'" for x in X.HIGH_RISK)


@query("e15_regime_flags", sql("regimes", f"SELECT symbol, seq, regime, regime IN ({_HV}) AS high_volatility, regime IN ({_TR}) AS trending, {case('regime', X.REGIME_RISK)} AS risk FROM regimes"))
def regime_flags(spark, sf):
    return V.regimes(spark, sf).select("symbol", "seq", "regime", X.is_high_volatility("regime").alias("high_volatility"),
                                       X.is_trending("regime").alias("trending"), X.risk_level("regime").alias("risk"))


@query("e16_regime_alerts", sql("regimes", f"""SELECT symbol, seq, 'regime_change' AS alert_type, CASE WHEN confidence > 0.7 THEN 'medium' ELSE 'low' END AS severity FROM regimes WHERE regime <> previous AND previous <> 'unknown'
UNION ALL SELECT symbol, seq, 'high_volatility', CASE WHEN regime = 'crisis' THEN 'high' ELSE 'medium' END FROM regimes WHERE regime IN ({_HV})
UNION ALL SELECT symbol, seq, 'crisis_detected', 'critical' FROM regimes WHERE regime = 'crisis'
UNION ALL SELECT symbol, seq, 'low_confidence', 'medium' FROM regimes WHERE confidence < 0.5
UNION ALL SELECT symbol, seq, 'emergency_regime', 'critical' FROM regimes WHERE regime = 'crisis'"""))
def regime_alerts(spark, sf):
    return V.regimes(spark, sf).select("symbol", "seq", F.explode(X.regime_alerts("regime", "previous", "confidence")).alias("a")).select("symbol", "seq", "a.*")


SCALING = f"""(least(greatest(CASE WHEN regime = 'crisis' THEN 0.1 WHEN regime IN ({_HR}) THEN 0.5 WHEN regime = 'stable_range' THEN 1.2 ELSE 1.0 END
 * CASE WHEN confidence < 0.5 THEN 0.7 WHEN confidence > 0.8 THEN 1.1 ELSE 1.0 END, 0.05), 2.0))"""


@query("e17_position_scaling", sql("regimes", f"SELECT symbol, seq, {r(SCALING)} AS scaling FROM regimes"))
def position_scaling(spark, sf):
    return shaped(V.regimes(spark, sf).withColumn("scaling", X.position_scaling("regime", "confidence")), columns="symbol seq scaling")


@query("e18_allow_position", sql("regimes", f"""WITH a AS (SELECT *, price / 1000 * {SCALING} AS adj, price > 200 AS halted FROM regimes),
b AS (SELECT *, CASE WHEN halted THEN 'emergency_halt' WHEN adj < 0.01 THEN 'too_small' WHEN regime = 'crisis' THEN 'crisis'
 WHEN regime IN ({_HR}) AND confidence < 0.6 THEN 'low_confidence' ELSE 'scaled' END AS reason FROM a)
SELECT symbol, seq, reason = 'scaled' AS allowed, {r("CASE WHEN reason = 'scaled' THEN adj ELSE 0.0 END")} AS adjusted_size, reason FROM b"""))
def allow_position(spark, sf):
    d = V.regimes(spark, sf)
    out = X.allow_position(F.col("price") / 1000, X.position_scaling("regime", "confidence"), "regime", "confidence", F.col("price") > 200)
    return shaped(d.withColumn("d", out).select("symbol", "seq", "d.*"))


_TABLE = ", ".join(f"('{k}', {', '.join(repr(x) for x in (*v, *P.COMMON_PARAMETERS.values()))})" for k, v in P.REGIME_PARAMETERS.items())
PARAMETERS = f"""params(regime, {', '.join(P.PARAMETER_NAMES)}, {', '.join(P.COMMON_PARAMETERS)}) AS (
 SELECT col0, {', '.join(f'col{i}::DOUBLE' for i in range(1, 13))} FROM (VALUES {_TABLE}))"""


def _bound(name: str, expr: str) -> str:
    low, high = P.PARAMETER_BOUNDS[name]
    return f"least(greatest({expr}, {low!r}), {high!r})"


@query("e19_adapt_parameters", sql("regimes", f"""WITH {PARAMETERS},
c AS (SELECT symbol, seq, regime, previous, confidence, confidence < 0.5 AS low, confidence / 0.5 AS q, 1.0 - confidence AS doubt,
  coalesce(previous <> regime AND confidence < 0.7, false) AS moving, regime IN ({_HV}) AS wild, regime IN ({_TR}) AS trend FROM regimes),
j AS (SELECT * FROM c JOIN params USING (regime)),
k AS (SELECT symbol, seq, entry_z AS b_entry, max_position AS b_pos,
 {_bound('entry_z', "entry_z * CASE WHEN low THEN 1 + 0.5 * (1 - q) ELSE 1 END * CASE regime WHEN 'crisis' THEN 2.0 WHEN 'stable_range' THEN 0.8 ELSE 1 END")} AS new_entry_z,
 {_bound('exit_z', "exit_z * CASE WHEN trend THEN 0.8 ELSE 1 END")} AS new_exit_z,
 {_bound('stop_z', "stop_z * CASE WHEN wild THEN 1.2 ELSE 1 END")} AS new_stop_z,
 {_bound('max_position', "max_position * CASE WHEN low THEN 0.5 + 0.5 * q ELSE 1 END * CASE WHEN wild THEN 0.8 ELSE 1 END * CASE WHEN trend THEN 1.1 ELSE 1 END * CASE regime WHEN 'crisis' THEN 0.3 WHEN 'stable_range' THEN 1.3 ELSE 1 END * CASE WHEN moving THEN 1 - 0.3 * doubt ELSE 1 END")} AS new_max_position,
 {_bound('sizing', "sizing * CASE WHEN low THEN 0.7 + 0.3 * q ELSE 1 END * CASE WHEN moving THEN 1 - 0.2 * doubt ELSE 1 END")} AS new_sizing,
 {_bound('kelly', "kelly * CASE WHEN low THEN 0.6 + 0.4 * q ELSE 1 END * CASE WHEN trend THEN 1.1 ELSE 1 END * CASE regime WHEN 'crisis' THEN 0.2 WHEN 'stable_range' THEN 1.2 ELSE 1 END")} AS new_kelly,
 {_bound('urgency', "CASE WHEN moving THEN least(1.0, (CASE WHEN regime = 'crisis' THEN 0.95 ELSE CASE WHEN wild THEN least(1.0, (CASE WHEN low THEN least(1.0, urgency * (1 + 0.3 * (1 - q))) ELSE urgency END) * 1.3) ELSE (CASE WHEN low THEN least(1.0, urgency * (1 + 0.3 * (1 - q))) ELSE urgency END) END END) * (1 + 0.2 * doubt)) ELSE (CASE WHEN regime = 'crisis' THEN 0.95 ELSE CASE WHEN wild THEN least(1.0, (CASE WHEN low THEN least(1.0, urgency * (1 + 0.3 * (1 - q))) ELSE urgency END) * 1.3) ELSE (CASE WHEN low THEN least(1.0, urgency * (1 + 0.3 * (1 - q))) ELSE urgency END) END END) END")} AS new_urgency,
 {_bound('holding', "CASE WHEN regime = 'stable_range' THEN floor(holding * 1.5) WHEN wild AND trend THEN floor(floor(holding * 0.7) * 1.2) WHEN wild THEN floor(holding * 0.7) WHEN trend THEN floor(holding * 1.2) ELSE holding END")} AS new_holding
 FROM j)
SELECT symbol, seq, {rs('new_entry_z new_exit_z new_stop_z new_max_position new_sizing new_kelly new_urgency new_holding')},
 {r('(new_entry_z - b_entry) / b_entry * 100', 4)} AS delta_entry_z, {r('(new_max_position - b_pos) / b_pos * 100', 4)} AS delta_max_position FROM k"""))
def adapt_parameters(spark, sf):
    d = P.adapt_parameters(V.regimes(spark, sf).withColumn("transition_probability", F.col("confidence")))
    names = "symbol seq new_entry_z new_exit_z new_stop_z new_max_position new_sizing new_kelly new_urgency new_holding delta_entry_z delta_max_position"
    return shaped(d, columns=names, per={"delta_entry_z": 4, "delta_max_position": 4})


_RULES = ", ".join(f"('{a}', '{m}', '{c}', {b!r}::DOUBLE, '{s}')" for a, m, c, b, s in P.ALERT_RULES)


@query("e20_alert_rules", sql("closed_trades", f"""WITH rules(alert, metric, comparison, bound, severity) AS (SELECT * FROM (VALUES {_RULES})),
m AS (SELECT pair, 100.0 * count(*) FILTER (pnl > 0) / count(*) AS win_rate, avg(pnl) / nullif(stddev_pop(pnl), 0) AS sharpe_ratio,
 sum(notional) / (7 * 365 * 24.0) AS trade_volume_rate_1h, min(pnl) AS realized_pnl_increase_1d FROM closed_trades GROUP BY 1),
l AS (UNPIVOT m ON win_rate, sharpe_ratio, trade_volume_rate_1h, realized_pnl_increase_1d INTO NAME metric VALUE value)
SELECT pair, alert, severity, {r('value', 4)} AS value FROM l JOIN rules USING (metric)
WHERE CASE comparison WHEN '>' THEN value > bound WHEN '<' THEN value < bound ELSE value = bound END"""))
def alert_rules(spark, sf):
    m = V.closed_trades(spark, sf).groupBy("pair").agg(
        (100.0 * F.count_if(F.col("pnl") > 0) / F.count(F.lit(1))).alias("win_rate"),
        F.try_divide(F.avg("pnl"), F.stddev_pop("pnl")).alias("sharpe_ratio"),
        (F.sum("notional") / (7 * 365 * 24.0)).alias("trade_volume_rate_1h"),
        F.min("pnl").alias("realized_pnl_increase_1d"))
    long = m.unpivot(["pair"], ["win_rate", "sharpe_ratio", "trade_volume_rate_1h", "realized_pnl_increase_1d"], "metric", "value")
    return shaped(P.alert_rules(long), 4, "pair alert severity value")


# every metric of the rules as a series per channel: gauges from prices, rates and increases of counters, latencies
GAUGES = {
    "trading_halted": "CASE WHEN price > 90 THEN 1.0 ELSE 0.0 END", "current_drawdown_percent": "price / 5", "concentration_risk_percent": "price / 2",
    "changepoint_probability": "least(price / 100, 1.0)", "service_up": "CASE WHEN price < 5 THEN 0.0 ELSE 1.0 END", "memory_usage_percent": "least(price * 2, 100.0)",
    "cpu_usage_percent": "least(price * 1.7, 100.0)", "data_staleness_seconds": "price", "connection_status": "CASE WHEN price > 70 THEN 0.0 ELSE 1.0 END",
    "kafka_consumer_lag_sum": "price * 20", "kafka_topic_partition_leader": "CASE WHEN price < 2 THEN -1.0 ELSE 1.0 END", "win_rate": "price", "sharpe_ratio": "price / 50",
}
# metric: width of the window, what is taken of the counter's growth and its factor
COUNTERS = {"errors_rate_5m": (300, "rate", 1.0), "messages_processed_rate_5m": (300, "rate", 100.0), "trade_volume_rate_1h": (3600, "rate", 100_000.0), "realized_pnl_increase_1d": (86_400, "increase", -50.0)}
_HOLDS = ", ".join(f"('{a}', '{m}', '{c}', {b!r}::DOUBLE, '{s}', {P.ALERT_HOLDS[a]!r}::DOUBLE)" for a, m, c, b, s in P.ALERT_RULES)


def _counter_sql(metric, width, kind, factor):
    value = f"sum(grown) * {factor!r}::DOUBLE" if kind == "increase" else f"sum(grown) / {width} * {factor!r}::DOUBLE"
    return f"SELECT symbol, '{metric}', time_bucket(INTERVAL {width} SECOND, ts)::TIMESTAMP + INTERVAL {width} SECOND, 0, {value} FROM grown GROUP BY 1, 3"


METRICS_SQL = f"""grown AS (SELECT *, CASE WHEN p IS NULL THEN 0 WHEN price < p THEN price ELSE price - p END AS grown FROM (SELECT *, lag(price) OVER (PARTITION BY symbol ORDER BY ts, seq) AS p FROM channel_ticks)),
samples(symbol, metric, ts, seq, value) AS ({" UNION ALL ".join(f"SELECT symbol, '{m}', ts, seq, ({e})::DOUBLE FROM channel_ticks" for m, e in GAUGES.items())}
 UNION ALL {" UNION ALL ".join(_counter_sql(m, *c) for m, c in COUNTERS.items())}
 UNION ALL SELECT symbol, 'request_duration_p95_5m', time_bucket(INTERVAL 5 MINUTE, ts)::TIMESTAMP + INTERVAL 5 MINUTE, 0, quantile_cont(price, 0.95) / 50 FROM channel_ticks GROUP BY 1, 3)"""


def metric_samples(spark, sf):
    t = V.channel_ticks(spark, sf)
    s = Series(("symbol",), ("ts", "seq"))
    gauges = t.select("symbol", "ts", "seq", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.expr(e).cast("double").alias("value")) for m, e in GAUGES.items()])).alias("g")).select("symbol", "ts", "seq", "g.*")
    out = gauges
    for width in sorted({w for w, _, _ in COUNTERS.values()}):
        own = {m: (kind, factor) for m, (w, kind, factor) in COUNTERS.items() if w == width}
        d = A.counter_increase(t, s, "price", f"{width} seconds")
        values = F.array(*[F.struct(F.lit(m).alias("metric"), (F.col(kind) * factor).alias("value")) for m, (kind, factor) in own.items()])
        out = out.unionByName(d.select("symbol", (F.col("window_start") + F.expr(f"INTERVAL {width} SECONDS")).alias("ts"), F.lit(0).cast("long").alias("seq"), F.explode(values).alias("g")).select("symbol", "ts", "seq", "g.*"))
    slow = A.latency_quantiles(t, "symbol", "price")
    slow = slow.select("symbol", (F.col("window_start") + F.expr("INTERVAL 5 MINUTES")).alias("ts"), F.lit(0).cast("long").alias("seq"), F.lit("request_duration_p95_5m").alias("metric"), (F.col("p95") / 50).alias("value"))
    return out.unionByName(slow)


@query("e20b_alert_runs", sql("channel_ticks", f"""WITH rules(alert, metric, comparison, bound, severity, hold) AS (SELECT * FROM (VALUES {_HOLDS})), {METRICS_SQL},
b AS (SELECT symbol, alert, severity, hold, ts, seq, CASE comparison WHEN '>' THEN value > bound WHEN '<' THEN value < bound ELSE value = bound END AS breach FROM samples JOIN rules USING (metric)),
c AS (SELECT *, breach AND NOT lag(breach, 1, false) OVER w AS starts FROM b WINDOW w AS (PARTITION BY symbol, alert ORDER BY ts, seq)),
d AS (SELECT *, sum(starts::INTEGER) OVER w AS run FROM c WINDOW w AS (PARTITION BY symbol, alert ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
e AS (SELECT *, min(ts) OVER (PARTITION BY symbol, alert, run) AS started_at FROM d WHERE run > 0)
SELECT symbol, alert, severity, started_at, min(ts) FILTER (breach AND epoch_us(ts) - epoch_us(started_at) >= hold * 1e6) AS fired_at, min(ts) FILTER (NOT breach) AS resolved_at
FROM e GROUP BY symbol, alert, severity, run, started_at HAVING fired_at IS NOT NULL"""))
def alert_runs(spark, sf):
    """All rules with their hold times, over series of every metric."""
    return shaped(P.alert_runs(metric_samples(spark, sf), ["symbol"]))


@query("e21_emergency_drawdown", sql("equity", f"""WITH d AS (SELECT strategy, ts, (max(value) OVER (PARTITION BY strategy ORDER BY ts) - value) / nullif(max(value) OVER (PARTITION BY strategy ORDER BY ts), 0) AS drawdown FROM equity)
SELECT strategy, ts, {r('drawdown')} AS drawdown FROM d WHERE drawdown > 0.25"""))
def emergency_drawdown(spark, sf):
    from tidemark.plans.series import Series

    d = R.drawdown(V.equity(spark, sf), "value", Series(("strategy",), ("ts",), True))
    return shaped(d.filter(F.col("drawdown") > 0.25), columns="strategy ts drawdown")


@query("e22_order_risk_checks", sql("fills", f"""WITH p AS (SELECT symbol, sum(CASE side WHEN 'buy' THEN quantity ELSE -quantity END) / 100 AS position, sum(quantity * price) / 200 AS portfolio_value,
 count(*) AS kelly_trades, avg(fee) / 20000 AS kelly_fraction FROM fills GROUP BY 1),
o AS (SELECT f.symbol, seq, CASE side WHEN 'buy' THEN quantity ELSE -quantity END AS q, price AS px, position AS pos, portfolio_value AS v, kelly_trades, kelly_fraction FROM fills f JOIN p USING (symbol)),
c AS (SELECT *, CASE WHEN kelly_fraction > 0 AND kelly_trades >= 20 THEN least(v * 0.1, v * kelly_fraction * 0.25) ELSE v * 0.1 END AS cap FROM o),
s AS (SELECT *, CASE WHEN abs((pos + q) * px) > cap THEN CASE WHEN abs(pos * px) >= cap THEN 0.0 WHEN q > 0 THEN least(q, (cap - abs(pos * px)) / px) ELSE greatest(q, -(cap - abs(pos * px)) / px) END ELSE q END AS sized FROM c),
w AS (SELECT *, CASE WHEN abs(q) < 1e-8 OR px <= 0 THEN 'invalid_order' WHEN v <= 0 THEN 'insufficient_capital' WHEN abs(sized) < 1e-8 THEN 'position_size_exceeded'
 WHEN abs((pos + sized) * px) / v > 0.2 THEN 'concentration_risk' WHEN v < abs(sized * px) * 0.1 + 1000 THEN 'insufficient_capital' END AS violation FROM s)
SELECT symbol, seq, violation, {r('CASE WHEN violation IS NULL THEN sized ELSE 0.0 END', 4)} AS approved_quantity,
 CASE WHEN violation IS NOT NULL THEN 'rejected' WHEN sized <> q THEN 'modified' ELSE 'approved' END AS result FROM w"""))
def order_risk_checks(spark, sf):
    f = V.fills(spark, sf)
    signed = F.when(F.col("side") == "buy", F.col("quantity")).otherwise(-F.col("quantity"))
    p = f.groupBy("symbol").agg(
        (F.sum(signed) / 100).alias("position"), (F.sum(F.col("quantity") * F.col("price")) / 200).alias("portfolio_value"),
        F.count(F.lit(1)).alias("kelly_trades"), (F.avg("fee") / 20000).alias("kelly_fraction"))
    return shaped(P.order_risk_checks(f.withColumn("quantity", signed).join(p, "symbol")), 4, "symbol seq violation approved_quantity result")


@query("e24_feedback_filter", sql("ticks", f"""WITH r AS (SELECT symbol, count(*) FILTER (price < 80) / count(*)::DOUBLE AS rate FROM ticks GROUP BY 1),
j AS (SELECT symbol, seq, rate, CASE WHEN rate > 0.8 THEN least(price / 100, 1.0) * (1 - rate * 0.5) ELSE least(price / 100, 1.0) END AS confidence FROM ticks JOIN r USING (symbol))
SELECT symbol, seq, {r('confidence')} AS confidence FROM j WHERE NOT (rate > 0.8) OR confidence >= 0.3"""))
def feedback_filter(spark, sf):
    t = V.ticks(spark, sf)
    rates = t.groupBy("symbol").agg((F.count_if(F.col("price") < 80) / F.count(F.lit(1))).alias("rate"))
    a = t.withColumn("confidence", F.least(F.col("price") / 100, F.lit(1.0)))
    return shaped(P.feedback_filter(a, rates, ["symbol"]), columns="symbol seq confidence")
