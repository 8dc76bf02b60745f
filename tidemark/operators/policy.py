"""Regime parameter tables, parameter adaptation, alert rules and order checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.functions.maths import clip, ratio
from tidemark.functions.rules import is_high_volatility, is_trending
from tidemark.plans.series import Series, over_rows, running

# Strategy parameters by regime (entry, exit, position, sizing, kelly, urgency, holding minutes).
PARAMETER_NAMES = ("entry_z", "exit_z", "max_position", "sizing", "kelly", "urgency", "holding")
REGIME_PARAMETERS = {
    "low_vol_bull": (1.5, 0.3, 1.2, 1.1, 0.3, 0.3, 360.0),
    "low_vol_bear": (1.8, 0.4, 0.8, 0.9, 0.2, 0.4, 300.0),
    "low_vol_range": (1.2, 0.2, 1.5, 1.2, 0.35, 0.2, 180.0),
    "high_vol_bull": (2.5, 0.8, 0.6, 0.7, 0.15, 0.7, 120.0),
    "high_vol_bear": (3.0, 1.0, 0.4, 0.5, 0.1, 0.8, 90.0),
    "high_vol_range": (2.2, 0.6, 0.8, 0.8, 0.2, 0.6, 150.0),
    "stable_range": (1.0, 0.1, 1.8, 1.3, 0.4, 0.1, 480.0),
    "trending_up": (1.8, 0.5, 1.0, 1.0, 0.25, 0.4, 240.0),
    "trending_down": (2.2, 0.7, 0.7, 0.8, 0.18, 0.5, 200.0),
    "crisis": (5.0, 2.0, 0.2, 0.3, 0.05, 0.9, 60.0),
    "recovery": (2.8, 1.2, 0.5, 0.6, 0.12, 0.6, 180.0),
    "unknown": (2.0, 0.5, 0.5, 0.7, 0.15, 0.5, 240.0),
}
# Parameters common to all regimes, and the bounds of every parameter.
COMMON_PARAMETERS = {"stop_z": 4.0, "drawdown_limit": 0.05, "correlation": 0.7, "slippage": 0.001, "rebalance": 60.0}
PARAMETER_BOUNDS = {
    "entry_z": (0.5, 5.0), "exit_z": (0.1, 2.0), "stop_z": (2.0, 10.0), "max_position": (0.1, 2.0), "sizing": (0.1, 2.0),
    "kelly": (0.01, 0.5), "drawdown_limit": (0.01, 0.2), "correlation": (0.3, 0.95), "urgency": (0.1, 1.0),
    "slippage": (0.0001, 0.01), "holding": (30.0, 1440.0), "rebalance": (15.0, 360.0),
}
ALL_PARAMETERS = tuple(PARAMETER_BOUNDS)


def parameter_table(spark: SparkSession) -> DataFrame:
    rows = [(k, *v, *COMMON_PARAMETERS.values()) for k, v in REGIME_PARAMETERS.items()]
    names = ["regime", *PARAMETER_NAMES, *COMMON_PARAMETERS]
    return spark.createDataFrame(rows, ", ".join(f"{n} {'string' if n == 'regime' else 'double'}" for n in names))


def regime_parameters(df: DataFrame, regime: str = "regime") -> DataFrame:
    """Look up the parameters of each row's regime; unlisted regimes read the ``unknown`` row.
    The table has twelve rows, so it is broadcast."""
    table = parameter_table(df.sparkSession)
    known = F.when(F.col(regime).isin(*REGIME_PARAMETERS), F.col(regime)).otherwise("unknown")
    return df.withColumn("_k", known).join(F.broadcast(table.withColumnRenamed("regime", "_k")), "_k", "left").drop("_k")


def adapt_parameters(df: DataFrame, minimum_confidence: float = 0.5) -> DataFrame:
    """Adjust the regime's parameters for low confidence, regime family and uncertain transitions, then
    bound them. Needs regime, previous, confidence and transition_probability columns."""
    d = regime_parameters(df)
    conf, reg = F.col("confidence"), F.col("regime")
    low = conf < minimum_confidence
    q = conf / minimum_confidence
    p: dict[str, Column] = {n: F.col(n) for n in ALL_PARAMETERS}

    def on(cond: Column, name: str, factor: Column | float) -> None:
        p[name] = F.when(cond, p[name] * factor).otherwise(p[name])

    def cut(cond: Column, name: str, factor: Column | float, top: float | None = None) -> None:
        value = F.floor(p[name] * factor).cast("double") if top is None else F.least(F.lit(top), p[name] * factor)
        p[name] = F.when(cond, value).otherwise(p[name])

    on(low, "max_position", 0.5 + 0.5 * q)
    on(low, "sizing", 0.7 + 0.3 * q)
    on(low, "kelly", 0.6 + 0.4 * q)
    on(low, "entry_z", 1.0 + 0.5 * (1 - q))
    cut(low, "urgency", 1.0 + 0.3 * (1 - q), 1.0)
    wild, trend = is_high_volatility(reg), is_trending(reg)
    on(wild, "stop_z", 1.2)
    on(wild, "max_position", 0.8)
    on(wild, "slippage", 1.5)
    cut(wild, "urgency", 1.3, 1.0)
    cut(wild, "holding", 0.7)
    cut(wild, "rebalance", 0.8)
    on(trend, "max_position", 1.1)
    on(trend, "kelly", 1.1)
    on(trend, "exit_z", 0.8)
    cut(trend, "holding", 1.2)
    crisis, calm = reg == "crisis", reg == "stable_range"
    for name, factor in (("max_position", 0.3), ("kelly", 0.2), ("entry_z", 2.0), ("drawdown_limit", 0.5)):
        on(crisis, name, factor)
    p["urgency"] = F.when(crisis, 0.95).otherwise(p["urgency"])
    for name, factor in (("max_position", 1.3), ("kelly", 1.2), ("entry_z", 0.8)):
        on(calm, name, factor)
    cut(calm, "holding", 1.5)
    prob = F.col("transition_probability")
    moving = F.coalesce((F.col("previous") != reg) & (prob < 0.7), F.lit(False))
    doubt = 1.0 - prob
    on(moving, "max_position", 1.0 - 0.3 * doubt)
    on(moving, "sizing", 1.0 - 0.2 * doubt)
    cut(moving, "urgency", 1.0 + 0.2 * doubt, 1.0)
    cut(moving, "rebalance", 1.0 - 0.3 * doubt)
    bounded = {f"new_{n}": clip(p[n], *PARAMETER_BOUNDS[n]) for n in ALL_PARAMETERS}
    d = d.withColumns(bounded)
    deltas = {f"delta_{n}": ratio(F.col(f"new_{n}") - F.col(n), n) * 100 for n in ("entry_z", "max_position", "kelly")}
    return d.withColumns(deltas).drop(*ALL_PARAMETERS)


# Alert rules as (alert, metric, comparison, bound, severity).
ALERT_RULES = [
    ("TradingHalted", "trading_halted", "==", 1.0, "critical"),
    ("HighDrawdown", "current_drawdown_percent", ">", 10.0, "critical"),
    ("DailyLossLimit", "realized_pnl_increase_1d", "<", -5000.0, "critical"),
    ("HighConcentrationRisk", "concentration_risk_percent", ">", 25.0, "warning"),
    ("HighChangepointProbability", "changepoint_probability", ">", 0.8, "warning"),
    ("ServiceDown", "service_up", "==", 0.0, "critical"),
    ("HighErrorRate", "errors_rate_5m", ">", 0.1, "warning"),
    ("HighLatency", "request_duration_p95_5m", ">", 1.0, "warning"),
    ("HighMemoryUsage", "memory_usage_percent", ">", 85.0, "warning"),
    ("HighCPUUsage", "cpu_usage_percent", ">", 80.0, "warning"),
    ("StaleMarketData", "data_staleness_seconds", ">", 60.0, "warning"),
    ("DataConnectionLost", "connection_status", "==", 0.0, "critical"),
    ("LowMessageThroughput", "messages_processed_rate_5m", "<", 10.0, "warning"),
    ("HighKafkaLag", "kafka_consumer_lag_sum", ">", 1000.0, "warning"),
    ("KafkaPartitionOffline", "kafka_topic_partition_leader", "==", -1.0, "critical"),
    ("LowWinRate", "win_rate", "<", 40.0, "warning"),
    ("LowSharpeRatio", "sharpe_ratio", "<", 0.5, "warning"),
    ("LowTradingVolume", "trade_volume_rate_1h", "<", 1000.0, "info"),
]


# Seconds for which a breach must last before its alert fires.
ALERT_HOLDS = {
    "TradingHalted": 0.0, "HighDrawdown": 60.0, "DailyLossLimit": 0.0, "HighConcentrationRisk": 300.0, "HighChangepointProbability": 120.0,
    "ServiceDown": 30.0, "HighErrorRate": 120.0, "HighLatency": 120.0, "HighMemoryUsage": 300.0, "HighCPUUsage": 300.0, "StaleMarketData": 60.0,
    "DataConnectionLost": 30.0, "LowMessageThroughput": 120.0, "HighKafkaLag": 60.0, "KafkaPartitionOffline": 0.0, "LowWinRate": 600.0,
    "LowSharpeRatio": 900.0, "LowTradingVolume": 1800.0,
}


def _ruled(metrics: DataFrame) -> DataFrame:
    """Metrics with the rules on them (a table of fixed size) and whether they breach the bound."""
    rules = metrics.sparkSession.createDataFrame(
        [(*rule, ALERT_HOLDS[rule[0]]) for rule in ALERT_RULES], "alert string, metric string, comparison string, bound double, severity string, hold_s double"
    )
    hit = (
        F.when(F.col("comparison") == ">", F.col("value") > F.col("bound"))
        .when(F.col("comparison") == "<", F.col("value") < F.col("bound"))
        .otherwise(F.col("value") == F.col("bound"))
    )
    return metrics.join(F.broadcast(rules), "metric").withColumn("breach", F.coalesce(hit, F.lit(False)))


def alert_rules(metrics: DataFrame) -> DataFrame:
    """Long metrics (..., metric, value) against the rule table; one row per breached rule."""
    return _ruled(metrics).filter("breach").drop("hold_s", "breach")


def alert_runs(samples: DataFrame, keys: list[str], ts: str = "ts", tie: str = "seq") -> DataFrame:
    """Alerts that fired: a run of breaching samples starts pending, fires at the first sample at least the rule's
    hold time after its start, and is resolved by the next sample that does not breach (null while none came).

    ``samples`` has ``keys``, ``metric``, ``value``, ``ts`` and ``tie`` (unique in a series of one metric). A null
    value breaches nothing. Rows: ``keys``, alert, severity, started_at, fired_at, resolved_at.
    """
    s = Series((*keys, "alert"), (ts, tie))
    d = _ruled(samples).select(*keys, "alert", ts, tie, "breach")
    d = over_rows(d, s, lambda x, w: x.withColumn("_before", F.lag("breach", 1, False).over(w)), before=1)
    d = d.filter(F.col("breach") | F.col("_before"))  # a run is its breaching samples and the first one after them
    of_rule = lambda values: F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("alert")]
    d = d.withColumns({"severity": of_rule({a: level for a, _, _, _, level in ALERT_RULES}), "hold_s": of_rule(ALERT_HOLDS)})
    # a run is named by the time and the tie of its first sample, and lasts in this sense until the next one starts
    first = F.when(F.col("breach") & ~F.col("_before"), F.struct(ts, tie))
    d = running(d, s, {"_run": ("last", first)}).filter("_run IS NOT NULL")
    lasted = (F.unix_micros(F.col(ts)) - F.unix_micros(F.col(f"_run.{ts}"))) / F.lit(1e6)
    runs = d.groupBy(*keys, "alert", "severity", "_run").agg(
        F.min(F.when(F.col("breach") & (lasted >= F.col("hold_s")), F.col(ts))).alias("fired_at"), F.min(F.when(~F.col("breach"), F.col(ts))).alias("resolved_at"))
    return runs.filter("fired_at IS NOT NULL").select(*keys, "alert", "severity", F.col(f"_run.{ts}").alias("started_at"), "fired_at", "resolved_at")


def order_risk_checks(
    orders: DataFrame, position_pct: float = 0.1, concentration_pct: float = 0.2, margin: float = 0.1,
    buffer: float = 1000.0, kelly_share: float = 0.25, kelly_min_trades: int = 20,
) -> DataFrame:
    """Stateless checks of one order against its position, portfolio value and Kelly fraction.

    Needs quantity (signed), price, position, portfolio_value, kelly_fraction, kelly_trades.
    """
    q, px, pos, value = (F.col(c) for c in ("quantity", "price", "position", "portfolio_value"))
    flat_cap = value * position_pct
    kelly_size = F.least(value * F.col("kelly_fraction") * kelly_share, flat_cap)
    cap = F.when((F.col("kelly_fraction") > 0) & (F.col("kelly_trades") >= kelly_min_trades), F.least(flat_cap, kelly_size)).otherwise(flat_cap)
    held = F.abs(pos * px)
    room = ratio(cap - held, px)
    cut = F.when(held >= cap, 0.0).when(q > 0, F.least(q, room)).otherwise(F.greatest(q, -room))
    sized = F.when(F.abs((pos + q) * px) > cap, cut).otherwise(q)
    d = orders.withColumn("_sized", sized)
    s = F.col("_sized")
    violation = (
        F.when((F.abs(q) < 1e-8) | (px <= 0), "invalid_order")
        .when(value <= 0, "insufficient_capital")
        .when(F.abs(s) < 1e-8, "position_size_exceeded")
        .when(F.abs((pos + s) * px) / F.when(value > 0, value) > concentration_pct, "concentration_risk")
        .when(value < F.abs(s * px) * margin + buffer, "insufficient_capital")
    )
    d = d.withColumn("violation", violation)
    bad = F.col("violation").isNotNull()
    return d.withColumns({
        "approved_quantity": F.when(bad, 0.0).otherwise(s),
        "result": F.when(bad, "rejected").when(s != q, "modified").otherwise("approved"),
    }).drop("_sized")


def latest_halts(daily: DataFrame, keys: list[str], daily_loss: float = 0.05, drawdown: float = 0.15) -> DataFrame:
    """Days on which a key breaks the daily-loss or the drawdown limit, with the reason (loss first).
    Daily rows are bounded by the calendar; the all-time high is a running maximum over them."""
    w = Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = daily.withColumns({
        "daily_loss": F.when(F.col("start_value") > 0, (F.col("start_value") - F.col("end_value")) / F.col("start_value")).otherwise(0.0),
        "_high": F.max("high_water").over(w),
    })
    d = d.withColumn("drawdown", F.coalesce(ratio(F.col("_high") - F.col("end_value"), "_high"), F.lit(0.0))).drop("_high")
    reason = F.when(F.col("daily_loss") > daily_loss, "daily_loss_limit").when(F.col("drawdown") > drawdown, "max_drawdown")
    return d.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def feedback_filter(anomalies: DataFrame, rates: DataFrame, keys: list[str]) -> DataFrame:
    """Damp the confidence of kinds with a high false-positive rate and drop what falls below 0.3."""
    from tidemark.plans.sizing import broadcast_if_small

    d = anomalies.join(broadcast_if_small(rates.select(*keys, F.col("rate").alias("_rate"))), keys, "left")
    noisy = F.coalesce(F.col("_rate") > 0.8, F.lit(False))
    d = d.withColumn("confidence", F.when(noisy, F.col("confidence") * (1 - F.col("_rate") * 0.5)).otherwise(F.col("confidence")))
    return d.filter(~noisy | (F.col("confidence") >= 0.3)).drop("_rate")
