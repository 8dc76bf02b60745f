"""Window and technical-feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.base import query, r, rs, shaped, sql
from tidemark.functions.maths import sql_two_sided_normal_p
from tidemark.operators import rolling as R
from tidemark.plans.series import BARS, TICKS
from tidemark.sources import views as V

KEY = "symbol, seq"
SKEY = "symbol seq "


def w(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def wb(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def tick_query(name, fn, columns, inner, outer=None):
    """A query over raw ticks; ``inner`` is the SQL select list over the tick view."""
    names = columns.split()
    body = f"SELECT {KEY}, {rs(columns)} FROM (SELECT *, {inner} FROM {{src}})".replace("{src}", outer or "ticks")

    @query(name, sql("ticks", body))
    def run(spark, sf):
        return shaped(fn(V.ticks(spark, sf)), columns=SKEY + " ".join(names))


def bar_query(name, fn, columns, inner, src="bars", key="symbol, ts"):
    body = f"SELECT {key}, {rs(columns)} FROM (SELECT *, {inner} FROM {src})"

    @query(name, sql("bars", body))
    def run(spark, sf):
        return shaped(fn(V.bars_1h(spark, sf)), columns=key.replace(",", "") + " " + columns)


tick_query("w01_moving_average", lambda d: R.moving_average(d, "price"),
           "ma_3 ma_momentum_3 ma_7 ma_momentum_7 ma_14 ma_momentum_14",
           ", ".join(f"avg(price) OVER {w(n)} AS ma_{n}, price / nullif(avg(price) OVER {w(n)}, 0) - 1 AS ma_momentum_{n}" for n in (3, 7, 14)))

tick_query("w02_volatility", lambda d: R.volatility(d, "price"), "volatility_7 cv_7 volatility_14 cv_14",
           ", ".join(f"stddev_samp(price) OVER {w(n)} AS volatility_{n}, stddev_samp(price) OVER {w(n)} / nullif(avg(price) OVER {w(n)}, 0) AS cv_{n}" for n in (7, 14)))

_mom = ", ".join(f"price / nullif(lag(price, {n}) OVER (PARTITION BY symbol ORDER BY ts, seq), 0) - 1 AS momentum_{n}" for n in (7, 14, 30))
_acc = ", ".join(f"momentum_{n} - lag(momentum_{n}) OVER (PARTITION BY symbol ORDER BY ts, seq) AS acceleration_{n}" for n in (7, 14, 30))
tick_query("w03_momentum", lambda d: R.momentum(d, "price"),
           "momentum_7 acceleration_7 momentum_14 acceleration_14 momentum_30 acceleration_30", _acc, f"(SELECT *, {_mom} FROM ticks)")

tick_query("w04_rolling_zscore", lambda d: R.rolling_zscore(d, "price"), "zscore_30 zscore_60",
           ", ".join(f"(price - avg(price) OVER {w(n)}) / nullif(stddev_samp(price) OVER {w(n)}, 0) AS zscore_{n}" for n in (30, 60)))

_lists = ", ".join(f"list(price) OVER {w(n)} AS l{n}" for n in (30, 60, 90))
tick_query("w05_percentile_rank", lambda d: R.rolling_percentile_rank(d, "price"), "percentile_30 percentile_60 percentile_90",
           ", ".join(f"(len(list_filter(l{n}, lambda v: v < price)) + len(list_filter(l{n}, lambda v: v <= price)) + 1) / (2.0 * len(l{n})) AS percentile_{n}" for n in (30, 60, 90)),
           f"(SELECT *, {_lists} FROM ticks)")

_ml = ", ".join(f"list(price) OVER {w(n)} AS l{n}" for n in (14, 30))

@query("w06_mad_score", sql("ticks", f"""WITH a AS (SELECT *, {_ml} FROM ticks),
b AS (SELECT *, list_aggregate(l14, 'median') AS m14, list_aggregate(l30, 'median') AS m30 FROM a),
c AS (SELECT *, list_aggregate(list_transform(l14, lambda v: abs(v - m14)), 'median') AS d14,
  list_aggregate(list_transform(l30, lambda v: abs(v - m30)), 'median') AS d30 FROM b),
d AS (SELECT symbol, seq, abs(price - m14) / nullif(d14, 0) AS mad_score_14, abs(price - m30) / nullif(d30, 0) AS mad_score_30 FROM c)
SELECT {KEY}, {rs("mad_score_14 mad_score_30")} FROM d"""))
def mad_score(spark, sf):
    return shaped(R.mad_score(V.ticks(spark, sf), "price"), columns="symbol seq mad_score_14 mad_score_30")


tick_query("w07_trend_slope", lambda d: R.trend_slope(d, "price"), "trend_7 trend_14 trend_30",
           ", ".join(f"CASE WHEN count(price) OVER {w(n)} >= 2 THEN regr_slope(price, i) OVER {w(n)} END AS trend_{n}" for n in (7, 14, 30)),
           "(SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq)::DOUBLE AS i FROM ticks)")

_d = "(SELECT *, price - lag(price) OVER (PARTITION BY symbol ORDER BY ts, seq) AS d FROM ticks)"


def _rsi(n, flat, scale):
    return (f"(CASE WHEN count(d) OVER {w(n)} < {n} THEN 50.0 WHEN avg(greatest(-d, 0)) OVER {w(n)} = 0 THEN {flat} "
            f"ELSE 100 - 100 / (1 + avg(greatest(d, 0)) OVER {w(n)} / nullif(avg(greatest(-d, 0)) OVER {w(n)}, 0)) END){scale} AS rsi")


tick_query("w08a_rsi_simple", lambda d: R.rsi_simple(d, "price"), "rsi", _rsi(14, "100.0", ""), _d)
tick_query("w08b_rsi_unit", lambda d: R.rsi_simple(d, "price", 13, unit=True), "rsi", _rsi(13, "50.0", " / 100"), _d)

_bb = f"""CASE WHEN count(price) OVER {w(20)} >= 20 THEN avg(price) OVER {w(20)} + 2 * stddev_pop(price) OVER {w(20)} END AS bb_upper,
CASE WHEN count(price) OVER {w(20)} >= 20 THEN avg(price) OVER {w(20)} - 2 * stddev_pop(price) OVER {w(20)} END AS bb_lower"""
tick_query("w10_bollinger", lambda d: R.bollinger(d, "price"), "bb_upper bb_lower bb_position",
           "(price - bb_lower) / nullif(bb_upper - bb_lower, 0) AS bb_position", f"(SELECT *, {_bb} FROM ticks)")
tick_query("w10b_bollinger_clipped", lambda d: R.bollinger(d, "price", clipped=True), "bb_position",
           "coalesce(least(greatest((price - bb_lower) / nullif(bb_upper - bb_lower, 0), 0.0), 1.0), 0.5) AS bb_position", f"(SELECT *, {_bb} FROM ticks)")

bar_query("w11_atr", R.atr_simple, "atr",
          f"CASE WHEN count(tr) OVER {wb(14)} >= 14 THEN avg(tr) OVER {wb(14)} ELSE 0.0 END AS atr",
          """(SELECT *, CASE WHEN p IS NOT NULL THEN greatest(high - low, abs(high - p), abs(low - p)) END AS tr FROM
            (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM bars))""")

_gap = "CASE WHEN channel IN ('view', 'click') THEN price END"


@query("w12_fill_gaps", sql("ticks", f"""SELECT symbol, seq, {r('filled')} AS filled FROM (
    SELECT *, coalesce(last_value(g IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        first_value(g IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled
    FROM (SELECT *, {_gap} AS g FROM ticks))"""))
def fill_gaps(spark, sf):
    d = V.ticks(spark, sf).withColumn("g", F.when(F.col("channel").isin("view", "click"), F.col("price")))
    return shaped(R.fill_gaps(d, "g", "filled"), columns="symbol seq filled")


_PEAK = """p AS (SELECT strategy, ts, value, max(value) OVER (PARTITION BY strategy ORDER BY ts) AS peak FROM equity),
m AS (SELECT *, lag(peak) OVER (PARTITION BY strategy ORDER BY ts) AS prior FROM p),
d AS (SELECT *, max(CASE WHEN prior IS NULL OR peak > prior THEN ts END) OVER (PARTITION BY strategy ORDER BY ts) AS peak_time,
    (peak - value) / nullif(peak, 0) AS drawdown FROM m)"""
_EQ = dict(s=BARS.__class__(("strategy",), ("ts",), True))


@query("w13_drawdown", sql("equity", f"WITH {_PEAK} SELECT strategy, ts, {r('peak', 2)} AS peak, peak_time, {r('drawdown')} AS drawdown FROM d"))
def drawdown(spark, sf):
    return shaped(R.drawdown(V.equity(spark, sf), "value", **_EQ), columns="strategy ts peak peak_time drawdown", per={"peak": 2})


@query("w13b_drawdown_summary", sql("equity", f"""WITH {_PEAK},
sp AS (SELECT strategy, peak_time, max(drawdown) AS deepest, min(CASE WHEN ts > peak_time THEN ts END) AS st, arg_max(drawdown, ts) AS fin
    FROM d GROUP BY 1, 2),
e AS (SELECT *, lead(peak_time) OVER (PARTITION BY strategy ORDER BY peak_time) AS en FROM sp)
SELECT strategy, {r('max(deepest)')} AS max_drawdown, {r('arg_max(fin, peak_time)')} AS current_drawdown,
{r('coalesce(max((epoch_us(en) - epoch_us(st)) / 86400e6), 0.0)')} AS longest_spell_days FROM e GROUP BY 1"""))
def drawdown_summary(spark, sf):
    return shaped(R.drawdown_summary(V.equity(spark, sf), "value", **_EQ))


@query("w14_returns", sql("ticks", f"""WITH a AS (SELECT *, lag(price) OVER (PARTITION BY symbol ORDER BY ts, seq) AS p FROM ticks),
b AS (SELECT *, CASE WHEN p IS NULL THEN NULL WHEN price > 0 AND p > 0 THEN price / p - 1 ELSE 0.0 END AS ret,
 CASE WHEN p IS NULL THEN NULL WHEN price > 0 AND p > 0 THEN ln(price / p) ELSE 0.0 END AS log_ret FROM a)
SELECT {KEY}, {rs('ret log_ret')} FROM b"""))
def returns(spark, sf):
    return shaped(R.returns(V.ticks(spark, sf)), columns="symbol seq ret log_ret")


bar_query("w15_horizon_returns", R.horizon_returns, "returns_1 returns_4 returns_24 returns_168",
          ", ".join(f"close / nullif(lag(close, {n}) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1 AS returns_{n}" for n in (1, 4, 24, 168)))

_RET = "(SELECT *, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1 AS ret FROM bars)"
bar_query("w16_horizon_volatility", R.horizon_volatility, "volatility_1 volatility_4 volatility_24 volatility_168",
          ", ".join(f"CASE WHEN count(ret) OVER {wb(n)} >= {n} THEN stddev_pop(ret) OVER {wb(n)} * sqrt(8760) END AS volatility_{n}" for n in (1, 4, 24, 168)), _RET)

bar_query("w17_volume_ratio", R.volume_ratio, "volume_ratio_1 volume_ratio_4 volume_ratio_24",
          ", ".join(f"CASE WHEN count(volume) OVER b{n} >= {n} THEN volume / nullif(avg(volume) OVER b{n}, 0) END AS volume_ratio_{n}" for n in (1, 4, 24)),
          "bars WINDOW " + ", ".join(f"b{n} AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in (1, 4, 24)))


def _bar_returns(spark, sf):
    return R.returns(V.bars_1h(spark, sf), "close", BARS)


_BRET = """ret AS (SELECT * FROM (SELECT *, CASE WHEN p IS NULL THEN NULL WHEN close > 0 AND p > 0 THEN close / p - 1 ELSE 0.0 END AS ret
FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM bars)) WHERE ret IS NOT NULL)"""


@query("w18_volatility_clustering", sql("bars", f"""WITH {_BRET},
v AS (SELECT *, CASE WHEN count(ret) OVER {wb(20)} >= 20 THEN stddev_samp(ret) OVER {wb(20)} END AS v FROM ret),
l AS (SELECT *, lag(v) OVER (PARTITION BY symbol ORDER BY ts) AS lv FROM v)
SELECT symbol, {r('CASE WHEN count(*) >= 40 THEN coalesce(corr(v, lv), 0.0) ELSE 0.0 END')} AS clustering FROM l GROUP BY 1"""))
def volatility_clustering(spark, sf):
    return shaped(R.volatility_clustering(_bar_returns(spark, sf)))


@query("w19_volatility_regime", sql("bars", f"""WITH {_BRET},
v AS (SELECT symbol, ts, CASE WHEN count(ret) OVER e < 10 THEN 0.5 ELSE
  coalesce(least(greatest((stddev_pop(ret) OVER {wb(10)} / nullif(stddev_pop(ret) OVER e, 0) - 0.5) * 2, 0.0), 1.0), 0.5) END AS vol_regime
  FROM ret WINDOW e AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, ts, {r('vol_regime')} AS vol_regime FROM v"""))
def volatility_regime(spark, sf):
    return shaped(R.volatility_regime_indicator(_bar_returns(spark, sf)), columns="symbol ts vol_regime")


bar_query("w20_trend_quality", R.trend_quality, "trend_strength trend_consistency",
          f"""CASE WHEN count(close) OVER {wb(20)} >= 20 AND avg(close) OVER {wb(20)} > 0 THEN regr_slope(close, i) OVER {wb(20)} / avg(close) OVER {wb(20)}
          * coalesce(regr_r2(close, i) OVER {wb(20)}, 0) ELSE 0.0 END AS trend_strength,
          CASE WHEN count(close) OVER {wb(20)} >= 20 THEN greatest(count(*) FILTER (d > 0) OVER {wb(19)}, count(*) FILTER (d < 0) OVER {wb(19)}) / 19.0 ELSE 0.0 END AS trend_consistency""",
          "(SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts)::DOUBLE AS i, close - lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS d FROM bars)")


# local extrema of the last 50 values: runs, tops between lower neighbours, then the higher ones first at least 5 apart
LEVELS = """w AS (SELECT symbol, ts, close, list(close) OVER (PARTITION BY symbol ORDER BY ts ROWS 49 PRECEDING) AS x FROM bars),
u AS (SELECT symbol, ts, g, i, x, g * x[i] AS v FROM w, range(1, 51) a(i), (VALUES (1), (-1)) b(g) WHERE len(x) = 50),
runs AS (SELECT * FROM (SELECT *, lag(v) OVER (PARTITION BY symbol, ts, g ORDER BY i) AS p FROM u) WHERE p IS NULL OR p <> v),
tops AS (SELECT *, (i - 1 + stop - 1) // 2 + 1 AS pos FROM (SELECT *, lead(v) OVER o AS nv, lead(i) OVER o - 1 AS stop, lag(v) OVER o AS pv FROM runs WINDOW o AS (PARTITION BY symbol, ts, g ORDER BY i)) WHERE pv < v AND nv < v),
kept AS (SELECT symbol, ts, g, list_transform(list_reduce(list([pos] ORDER BY v DESC, pos DESC), lambda acc, e: CASE WHEN len(list_filter(acc, lambda a: abs(a - e[1]) < 5)) = 0 THEN list_concat(acc, e) ELSE acc END), lambda q: xs[q]) AS l
 FROM (SELECT *, x AS xs FROM tops) GROUP BY symbol, ts, g, xs),
lv AS (SELECT symbol, ts, any_value(l) FILTER (g = -1) AS lows, any_value(l) FILTER (g = 1) AS highs FROM kept GROUP BY 1, 2)"""


@query("w21_support_resistance", sql("bars", f"""WITH {LEVELS} SELECT w.symbol, w.ts,
{r("CASE WHEN close > 0 AND lows IS NOT NULL THEN (close - coalesce(list_max(list_filter(lows, lambda q: q <= close)), list_min(lows))) / close ELSE 0 END")} AS support,
{r("CASE WHEN close > 0 AND highs IS NOT NULL THEN (coalesce(list_min(list_filter(highs, lambda q: q >= close)), list_max(highs)) - close) / close ELSE 0 END")} AS resistance
FROM w LEFT JOIN lv USING (symbol, ts)"""))
def support_resistance(spark, sf):
    return shaped(R.support_resistance(V.bars_1h(spark, sf)), columns="symbol ts support resistance")


_past = "(PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN 49 PRECEDING AND 1 PRECEDING)"


@query("w22_zscore_anomaly", sql("ticks", f"""WITH a AS (SELECT *, CASE WHEN count(price) OVER {_past} >= 49 THEN
  (price - avg(price) OVER {_past}) / nullif(stddev_pop(price) OVER {_past}, 0) END AS z_score FROM ticks),
b AS (SELECT *, abs(z_score) - 2 AS exceeded, least(0.99, abs(z_score) / 5) AS confidence, {sql_two_sided_normal_p('z_score')} AS p_value FROM a WHERE abs(z_score) >= 2)
SELECT {KEY}, {rs('z_score p_value confidence exceeded')},
CASE WHEN abs(z_score) >= 6 THEN 'critical' WHEN abs(z_score) >= 4 THEN 'high' WHEN abs(z_score) >= 3 THEN 'medium' ELSE 'low' END AS severity FROM b"""))
def zscore_anomaly(spark, sf):
    return shaped(R.zscore_anomaly(V.ticks(spark, sf), "price", 50, 2.0), columns="symbol seq z_score p_value confidence exceeded severity")


@query("w23_iqr_anomaly", sql("ticks", f"""WITH a AS (SELECT *, count(price) OVER {w(50)} AS c, quantile_cont(price, 0.25) OVER {w(50)} AS q1,
  quantile_cont(price, 0.75) OVER {w(50)} AS q3 FROM ticks),
b AS (SELECT *, q3 - q1 AS i FROM a WHERE c >= 50),
c2 AS (SELECT *, CASE WHEN price < q1 - 1.5 * i THEN (q1 - 1.5 * i - price) / nullif(i, 0) WHEN price > q3 + 1.5 * i THEN (price - q3 - 1.5 * i) / nullif(i, 0) END AS distance FROM b)
SELECT {KEY}, {rs('q1 q3 distance')}, {r('least(0.99, distance / 3)')} AS confidence,
CASE WHEN distance >= 4.5 THEN 'critical' WHEN distance >= 3 THEN 'high' WHEN distance >= 2.25 THEN 'medium' ELSE 'low' END AS severity
FROM c2 WHERE distance IS NOT NULL"""))
def iqr_anomaly(spark, sf):
    return shaped(R.iqr_anomaly(V.ticks(spark, sf), "price"), columns="symbol seq q1 q3 distance confidence severity")


@query("w24_threshold_anomaly", sql("closed_trades", f"""SELECT trade_id, {r('pnl', 4)} AS pnl, {r('abs(pnl + 1000)', 4)} AS exceeded,
CASE WHEN abs(pnl) >= 3000 THEN 'critical' WHEN abs(pnl) >= 2000 THEN 'high' WHEN abs(pnl) >= 1500 THEN 'medium' ELSE 'low' END AS severity
FROM closed_trades WHERE pnl <= -1000"""))
def threshold_anomaly(spark, sf):
    return shaped(R.threshold_anomaly(V.closed_trades(spark, sf), "pnl", -1000.0), 4, "trade_id pnl exceeded severity")


@query("w26_diff_changepoints", sql("ticks", f"""WITH a AS (SELECT *, abs(price - lag(price) OVER (PARTITION BY symbol ORDER BY ts, seq)) AS step FROM ticks),
b AS (SELECT symbol, avg(step) + 2 * stddev_pop(step) AS bound FROM a GROUP BY 1)
SELECT {KEY}, {rs('step bound')} FROM a JOIN b USING (symbol) WHERE step > bound"""))
def diff_changepoints(spark, sf):
    return shaped(R.diff_changepoints(V.ticks(spark, sf), "price"), columns="symbol seq step bound")


tick_query("w27_rolling_statistics", lambda d: R.rolling_statistics(d, "price"), "rolling_mean rolling_std rolling_min rolling_max",
           ", ".join(f"CASE WHEN count(price) OVER {w(24)} >= 24 THEN {f}(price) OVER {w(24)} END AS rolling_{n}"
                     for f, n in (("avg", "mean"), ("stddev_samp", "std"), ("min", "min"), ("max", "max"))))

bar_query("w28_spread", lambda d: d.withColumns({
    "s_ratio": R.spread("high", "low", 1.2), "s_diff": R.spread("high", "low", 1.2, "difference"), "s_log": R.spread("high", "low", 1.2, "log_ratio")}),
    "s_ratio s_diff s_log",
    "high / nullif(low, 0) - 1.2 AS s_ratio, high - 1.2 * low AS s_diff, CASE WHEN low > 0 AND high > 0 THEN ln(high / low) - ln(1.2) END AS s_log")

tick_query("w29_spread_zscore", lambda d: R.spread_zscore(d, "price"), "z_score",
           f"CASE WHEN count(price) OVER {w(100)} >= 2 THEN coalesce((price - avg(price) OVER {w(100)}) / nullif(stddev_samp(price) OVER {w(100)}, 0), 0) END AS z_score")


def with_volatility(d, s=TICKS):
    """Ticks with a crude forecast: sample deviation of the last ten prices."""
    from tidemark.plans.series import over_rows, rows_before

    return over_rows(d, s, lambda x, win: x.withColumn("vol", F.stddev_samp("price").over(rows_before(win, 10))), 9)


ADAPTIVE = f"""v AS (SELECT *, stddev_samp(price) OVER {w(10)} AS vol FROM ticks),
a AS (SELECT *, count(price) OVER {w(50)} AS n, avg(price) OVER {w(50)} AS m, stddev_samp(price) OVER {w(50)} AS sd,
 count(vol) OVER {w(50)} AS vn, avg(vol) OVER {w(50)} AS vm, stddev_pop(vol) OVER {w(50)} AS vs,
 quantile_cont(vol, 0.25) OVER {w(50)} AS p25, quantile_cont(vol, 0.75) OVER {w(50)} AS p75 FROM v),
b AS (SELECT *, CASE WHEN n < 2 THEN price WHEN sd = 0 THEN 0.0 ELSE (price - m) / sd END AS z_score,
 1 + 0.5 * (coalesce(CASE WHEN vm > 0 THEN vol / vm ELSE 1.0 END, 1.0) - 1) AS mult FROM a),
c AS (SELECT *, least(greatest(2.0 * mult, 1.0), 4.0) AS entry FROM b),
d AS (SELECT *, least(greatest(0.5 * mult, 0.1), entry * 0.8) AS exit, least(entry * 1.5, 6.0) AS stop,
 CASE WHEN vn < 10 THEN 'normal' WHEN vol <= p25 THEN 'low' WHEN vol >= p75 THEN 'high' ELSE 'normal' END AS regime,
 (least(1.0, n / 50.0) + CASE WHEN vn > 1 THEN 1 / (1 + vs) ELSE 0.5 END) / 2 AS confidence FROM c)"""


@query("w30_adaptive_thresholds", sql("ticks", f"WITH {ADAPTIVE} SELECT {KEY}, regime, {rs('z_score entry exit stop confidence')} FROM d"))
def adaptive(spark, sf):
    d = R.adaptive_thresholds(with_volatility(V.ticks(spark, sf)), "price", "vol")
    return shaped(d, columns="symbol seq regime z_score entry exit stop confidence")


bar_query("w31_bar_features", R.bar_features, "ret log_ret volatility_5 momentum_5 volatility_24 momentum_24",
          ", ".join(f"CASE WHEN count(ret) OVER {wb(n)} >= {n} THEN stddev_samp(ret) OVER {wb(n)} END AS volatility_{n}, close / nullif(lag(close, {n}) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1 AS momentum_{n}" for n in (5, 24)),
          "(SELECT *, close / nullif(p, 0) - 1 AS ret, CASE WHEN close > 0 AND p > 0 THEN ln(close / p) END AS log_ret FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM bars))")

bar_query("w32_range_position", R.price_range_position, "range_position",
          f"CASE WHEN count(close) OVER {wb(20)} >= 20 THEN coalesce((close - min(close) OVER {wb(20)}) / nullif(max(close) OVER {wb(20)} - min(close) OVER {wb(20)}, 0), 0.5) ELSE 0.5 END AS range_position")


@query("w33_stride_windows", sql("bars", """WITH p AS (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i,
  count(*) OVER (PARTITION BY symbol) AS n FROM bars),
g AS (SELECT symbol, unnest(range(0, n - 48 + 1, 24)) AS st FROM (SELECT symbol, count(*) AS n FROM bars GROUP BY 1) WHERE n >= 48)
SELECT p.symbol, (st // 24)::BIGINT AS window_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, max(i - st)::BIGINT AS last_row
FROM p JOIN g ON p.symbol = g.symbol AND i >= st AND i < st + 48 GROUP BY 1, 2"""))
def stride_windows(spark, sf):
    d = R.stride_windows(V.bars_1h(spark, sf), 48, 24)
    return shaped(d.groupBy("symbol", "window_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max("window_row").alias("last_row")))


@query("w34_regime_changes", sql("ticks", """WITH a AS (SELECT *, lag(channel) OVER (PARTITION BY symbol ORDER BY ts, seq) AS previous FROM ticks),
b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, seq DESC) AS recency FROM a WHERE channel <> previous)
SELECT symbol, seq, previous, channel AS regime, recency FROM b WHERE recency <= 10"""))
def regime_changes(spark, sf):
    d = R.regime_changes(V.ticks(spark, sf), "channel")
    return shaped(d.withColumn("regime", F.col("channel")), columns="symbol seq previous regime recency")


ONCHAIN_SQL = """oc AS (SELECT symbol, ts,
 sum(CASE WHEN channel = 'view' THEN price END) AS inflow, sum(CASE WHEN channel = 'click' THEN price END) AS outflow,
 count(*)::DOUBLE AS transactions, count(DISTINCT channel)::DOUBLE AS addresses, (count(*) FILTER (price > 60))::DOUBLE AS whales,
 max(price) AS supply_old, min(price) AS supply_young, avg(price) AS mvrv, median(price) AS nvt FROM
 (SELECT symbol, date_trunc('day', ts)::TIMESTAMP AS ts, channel, price FROM ticks) GROUP BY 1, 2),
onchain AS (SELECT *, outflow - inflow AS net_flow FROM oc)"""


def onchain(spark, sf):
    """Wide daily metrics per symbol, shaped like on-chain rows."""
    t = V.ticks(spark, sf)
    return t.groupBy("symbol", F.date_trunc("day", "ts").alias("ts")).agg(
        F.sum(F.when(F.col("channel") == "view", F.col("price"))).alias("inflow"),
        F.sum(F.when(F.col("channel") == "click", F.col("price"))).alias("outflow"),
        F.count(F.lit(1)).cast("double").alias("transactions"),
        F.countDistinct("channel").cast("double").alias("addresses"),
        F.count_if(F.col("price") > 60).cast("double").alias("whales"),
        F.max("price").alias("supply_old"), F.min("price").alias("supply_young"),
        F.avg("price").alias("mvrv"), F.percentile("price", F.lit(0.5)).alias("nvt"),
    ).withColumn("net_flow", F.col("outflow") - F.col("inflow"))


_CROSS = """flow_ratio flow_pressure tx_per_address whale_dominance hodl_ratio valuation"""


@query("w35_cross_features", sql("ticks", f"""WITH {ONCHAIN_SQL},
x AS (SELECT symbol, ts, outflow / nullif(inflow, 0) AS flow_ratio, (outflow - inflow) / nullif(outflow + inflow, 0) AS flow_pressure,
transactions / nullif(addresses, 0) AS tx_per_address, whales / nullif(transactions, 0) AS whale_dominance,
supply_old / nullif(supply_young, 0) AS hodl_ratio, mvrv * nvt AS valuation FROM onchain)
SELECT symbol, ts, {rs("flow_ratio flow_pressure tx_per_address whale_dominance")}, {rs("hodl_ratio valuation", 3)} FROM x"""))
def cross_features(spark, sf):
    return shaped(R.cross_features(onchain(spark, sf)), columns="symbol ts " + _CROSS, per={"valuation": 3, "hodl_ratio": 3})


@query("w36_composite_scores", sql("ticks", f"""WITH {ONCHAIN_SQL},
m AS (SELECT *, avg(whales) OVER (PARTITION BY symbol) AS wm, stddev_samp(whales) OVER (PARTITION BY symbol) AS ws,
 coalesce(net_flow / nullif(lag(net_flow, 7) OVER q, 0) - 1, 0) AS fm, coalesce(addresses / nullif(lag(addresses, 7) OVER q, 0) - 1, 0) AS am,
 coalesce(whales / nullif(lag(whales, 7) OVER q, 0) - 1, 0) AS wmo FROM onchain WINDOW q AS (PARTITION BY symbol ORDER BY ts)),
x AS (SELECT symbol, ts, (coalesce(net_flow, 0) + coalesce((whales - wm) / nullif(ws, 0), 0) + am) / 3 AS bullish,
 (-coalesce(net_flow, 0) - am) / 2 AS bearish, (fm + am + wmo) / 3 AS momentum FROM m)
SELECT symbol, ts, {rs('bullish bearish momentum')} FROM x"""))
def composite_scores(spark, sf):
    return shaped(R.composite_scores(onchain(spark, sf)), columns="symbol ts bullish bearish momentum")


bar_query("w38_positional_momentum", R.positional_momentum, "pos_momentum_5 pos_momentum_24 pos_momentum_10",
          ", ".join(f"coalesce(close / nullif(lag(close, {n - 1}) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1, 0) AS pos_momentum_{n}" for n in (5, 24, 10)))


@query("w39_market_beta", sql("bars", f"""WITH {_BRET},
m AS (SELECT ts, avg(ret) AS market FROM ret GROUP BY 1),
j AS (SELECT symbol, ts, ret, market FROM ret JOIN m USING (ts)),
b AS (SELECT symbol, ts, CASE WHEN count(ret) OVER {wb(30)} >= 30 THEN coalesce(covar_samp(ret, market) OVER {wb(30)} / nullif(var_pop(market) OVER {wb(30)}, 0), 1.0) ELSE 1.0 END AS beta FROM j)
SELECT symbol, ts, {r('beta')} AS beta FROM b"""))
def market_beta(spark, sf):
    return shaped(R.market_beta(_bar_returns(spark, sf)), columns="symbol ts beta")
