"""Recursive and stateful queries (ST0-ST13, W8, W9, W11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.aggregates import KELLY, POSITIONS_SQL, fraction_of_pairs
from tidemark.catalog.base import query, r, rs, shaped, sql
from tidemark.catalog.rolling import ADAPTIVE, with_volatility
from tidemark.operators import accounting as K
from tidemark.operators import garch as G
from tidemark.operators import recursive as Q
from tidemark.operators import rolling as R
from tidemark.plans.series import BARS, TICKS, Series, by_key_size
from tidemark.plans.sizing import broadcast_if_small
from tidemark.sources import views as V

NUM = "o AS (SELECT symbol, seq, price, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS k FROM ticks)"


def chain(name: str, a: float, x: str, src: str) -> str:
    """Recursive SQL of an adjusted exponential average over rows numbered k."""
    return (f"{name}_r AS (SELECT symbol, k, {x}::DOUBLE AS num, 1.0::DOUBLE AS den FROM {src} WHERE k = 1 UNION ALL "
            f"SELECT s.symbol, s.k, {1 - a!r}::DOUBLE * p.num + s.{x}, {1 - a!r}::DOUBLE * p.den + 1 FROM {name}_r p JOIN {src} s ON s.symbol = p.symbol AND s.k = p.k + 1), "
            f"{name} AS (SELECT symbol, k, num / den AS v FROM {name}_r)")


@query("st00_ewm", sql("ticks", f"WITH RECURSIVE {NUM}, {chain('e', 2 / 11, 'price', 'o')} SELECT o.symbol, o.seq, {r('v')} AS ema FROM o JOIN e USING (symbol, k)"))
def ewm(spark, sf):
    return shaped(Q.ewm(V.ticks(spark, sf).select("symbol", "ts", "seq", "price"), "price", "ema", span=10), columns="symbol seq ema")


WILDER = """d AS (SELECT *, price - lag(price) OVER (PARTITION BY symbol ORDER BY k) AS d FROM o),
seed AS (SELECT symbol, avg(greatest(d, 0)) AS au, avg(greatest(-d, 0)) AS ad FROM d WHERE k BETWEEN 2 AND 15 GROUP BY 1),
wr AS (SELECT o.symbol, o.k, au, ad FROM seed JOIN o ON o.symbol = seed.symbol AND o.k = 15
 UNION ALL SELECT d.symbol, d.k, (w.au * 13 + greatest(d.d, 0)) / 14, (w.ad * 13 + greatest(-d.d, 0)) / 14 FROM wr w JOIN d ON d.symbol = w.symbol AND d.k = w.k + 1)"""


@query("w08_rsi_wilder", sql("ticks", f"WITH RECURSIVE {NUM}, {WILDER} SELECT o.symbol, o.seq, {r('CASE WHEN au IS NULL THEN 50 WHEN ad = 0 THEN 100 ELSE 100 - 100 / (1 + au / ad) END')} AS rsi FROM o LEFT JOIN wr USING (symbol, k)"))
def rsi_wilder(spark, sf):
    return shaped(Q.rsi_wilder(V.ticks(spark, sf).select("symbol", "ts", "seq", "price"), "price"), columns="symbol seq rsi")


@query("w09_macd", sql("ticks", f"""WITH RECURSIVE {NUM}, {chain('f', 2 / 13, 'price', 'o')}, {chain('g', 2 / 27, 'price', 'o')},
l AS (SELECT symbol, k, f.v - g.v AS line FROM f JOIN g USING (symbol, k)), {chain('h', 2 / 10, 'line', 'l')}
SELECT o.symbol, o.seq, {r('line')} AS macd, {r('h.v')} AS macd_signal, {r('line - h.v')} AS macd_histogram FROM o JOIN l USING (symbol, k) JOIN h USING (symbol, k)"""))
def macd(spark, sf):
    return shaped(Q.macd(V.ticks(spark, sf).select("symbol", "ts", "seq", "price"), "price"), columns="symbol seq macd macd_signal macd_histogram")


@query("w11b_atr_wilder", sql("bars", f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM bars),
t AS (SELECT symbol, ts, k, greatest(high - low, abs(high - p), abs(low - p)) AS tr FROM o),
wr AS (SELECT symbol, 15::BIGINT AS k, avg(tr) AS a FROM t WHERE k BETWEEN 2 AND 15 GROUP BY 1 UNION ALL SELECT t.symbol, t.k, (w.a * 13 + t.tr) / 14 FROM wr w JOIN t ON t.symbol = w.symbol AND t.k = w.k + 1)
SELECT t.symbol, t.ts, {r('coalesce(a, 0)')} AS atr FROM t LEFT JOIN wr USING (symbol, k)"""))
def atr_wilder(spark, sf):
    return shaped(Q.atr_wilder(V.bars_1h(spark, sf)), columns="symbol ts atr")


KALMAN = """z AS (SELECT symbol, seq, k, price / 50 AS z FROM o),
kr AS (SELECT symbol, 0::BIGINT AS k, 1.0::DOUBLE AS m, 0.0::DOUBLE AS v, 1.0::DOUBLE AS p11, 0.0::DOUBLE AS p12, 1.0::DOUBLE AS p22, 0.0::DOUBLE AS e, 0.0::DOUBLE AS s FROM (SELECT DISTINCT symbol FROM o)
 UNION ALL SELECT symbol, k, m1 + k1 * e, v + k2 * e, (1 - k1) * (1 - k1) * a + k1 * k1 * 1e-3, (1 - k1) * (b - k2 * a) + k1 * k2 * 1e-3, c - 2 * k2 * b + k2 * k2 * a + k2 * k2 * 1e-3, e, s FROM (
 SELECT *, a / s AS k1, b / s AS k2, z - m1 AS e FROM (SELECT *, a + 1e-3 AS s FROM (
 SELECT z.symbol, z.k, z.z, p.m + p.v AS m1, p.v, p.p11 + 2 * p.p12 + p.p22 + 1e-5 AS a, p.p12 + p.p22 AS b, p.p22 + 1e-6 AS c FROM kr p JOIN z ON z.symbol = p.symbol AND z.k = p.k + 1))))"""


@query("st01_kalman_hedge_ratio", sql("ticks", f"""WITH RECURSIVE {NUM}, {KALMAN} SELECT o.symbol, o.seq, {r('m')} AS hedge_ratio, {r('v')} AS velocity, {r('p11', 8)} AS variance, {r('1.96 * sqrt(p11)')} AS half_width, {r('e')} AS innovation, {r('s', 8)} AS innovation_variance,
{r('-0.5 * (ln(2 * pi()) + ln(s) + e * e / s)', 4)} AS log_likelihood FROM o JOIN kr USING (symbol, k)"""))
def kalman(spark, sf):
    d = Q.kalman_hedge_ratio(V.ticks(spark, sf).withColumn("z", F.col("price") / 50), "z", TICKS, ["symbol", "seq"])
    return shaped(d, per={"variance": 8, "innovation_variance": 8, "log_likelihood": 4})


def _scaled(spark, sf):
    return V.channel_ticks(spark, sf).withColumn("x", F.col("price") / 25 - 2)


@query("st02_bocd")
def bocd(spark, sf):
    return shaped(Q.bocd(_scaled(spark, sf), "x", TICKS, ["symbol", "seq"]))


@query("st03_adaptive_bocd")
def adaptive_bocd(spark, sf):
    return shaped(Q.bocd(_scaled(spark, sf), "x", TICKS, ["symbol", "seq"], adaptive=True))


BREAKER = """n AS (SELECT symbol, seq, epoch_us(ts) / 1e6 AS t, p, s, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS k,
 least(0.9, greatest(0.1, 0.5::DOUBLE * s)) AS warn, least(0.95, greatest(0.2, 0.7::DOUBLE * s)) AS halt, least(1.0, greatest(0.3, 0.9::DOUBLE * s)) AS crit FROM (
 SELECT symbol, ts, seq, least(price / 120, 1.0) AS p, CASE seq % 3 WHEN 0 THEN 1.2 WHEN 2 THEN 0.8 ELSE 1 END::DOUBLE AS s FROM ticks) WHERE p > 0.1),
f AS (SELECT symbol, 0::BIGINT AS k, 'NORMAL' AS mode, NULL::DOUBLE AS since, 0 AS warnings, 0 AS highs, NULL::DOUBLE AS recovering, []::DOUBLE[] AS seen, NULL::VARCHAR AS event, NULL::VARCHAR AS severity FROM (SELECT DISTINCT symbol FROM n)
 UNION ALL SELECT symbol, k, CASE WHEN e = 'halt' THEN 'HALT' WHEN e = 'recovery' OR kind = 'calm' THEN 'NORMAL' WHEN kind IN ('high', 'warn') THEN 'WARNING' WHEN kind = 'release' THEN 'RECOVERY' ELSE mode END,
 CASE WHEN e = 'halt' THEN t WHEN e = 'recovery' THEN NULL ELSE since END, CASE WHEN e IS NULL THEN w1 ELSE 0 END, CASE WHEN e IS NULL THEN h1 ELSE 0 END,
 CASE WHEN kind = 'release' THEN t WHEN e = 'recovery' THEN NULL ELSE recovering END, CASE WHEN kind = 'release' OR e = 'recovery' THEN [] ELSE s1 END, e,
 CASE WHEN e = 'halt' THEN CASE kind WHEN 'critical' THEN 'CRITICAL' WHEN 'high' THEN 'HIGH' WHEN 'warn' THEN 'MEDIUM' ELSE 'RECOVERY_FAILED' END END FROM (
 SELECT *, CASE WHEN kind = 'critical' OR (kind = 'high' AND h1 >= 2) OR (kind = 'warn' AND w1 >= 3) THEN 'halt'
  WHEN kind = 'recovering' AND len(s1) >= 3 THEN CASE WHEN list_max(s1[-5:]) <= 0.2 AND list_sum(s1[-10:]) / least(10, len(s1)) <= 1.5 * 0.2::DOUBLE THEN 'recovery' WHEN list_max(s1[-5:]) > halt THEN 'halt' END END AS e FROM (
 SELECT *, CASE kind WHEN 'high' THEN highs + 1 WHEN 'calm' THEN 0 ELSE highs END AS h1, CASE kind WHEN 'warn' THEN warnings + (mode = 'WARNING')::INTEGER WHEN 'calm' THEN 0 ELSE warnings END AS w1,
  CASE WHEN kind <> 'recovering' THEN seen WHEN t - recovering > 300 AND floor((len(seen) + 1) * 300.0::DOUBLE / (t - recovering)) > 0
   THEN list_append(seen, p)[-floor((len(seen) + 1) * 300.0::DOUBLE / (t - recovering))::BIGINT:] ELSE list_append(seen, p) END AS s1 FROM (
 SELECT n.*, f.mode, f.since, f.warnings, f.highs, f.recovering, f.seen, CASE WHEN mode IN ('NORMAL', 'WARNING') THEN CASE WHEN p >= crit THEN 'critical' WHEN p >= halt THEN 'high' WHEN p >= warn THEN 'warn' ELSE 'calm' END
  WHEN mode = 'HALT' THEN CASE WHEN (t - since >= 300 AND p <= 0.2) OR t - since >= 7200 THEN 'release' ELSE 'held' END ELSE 'recovering' END AS kind
 FROM f JOIN n ON n.symbol = f.symbol AND n.k = f.k + 1))))"""


@query("st04_circuit_breaker", sql("ticks", f"WITH RECURSIVE {BREAKER} SELECT symbol, seq, mode AS state, event, severity FROM n JOIN f USING (symbol, k)"))
def circuit_breaker(spark, sf):
    d = V.ticks(spark, sf).withColumns({"probability": F.least(F.col("price") / 120, F.lit(1.0)), "recent_std": F.col("seq") % 3 * 1.0 + 0.2})
    return Q.circuit_breaker(d, TICKS, ["symbol", "seq"])


TRIGGERS = {"view": "entry_signal", "click": "position_entered", "purchase": "exit_signal", "signup": "position_exited", "error": "reset"}


LIFE = """n AS (SELECT symbol, seq, channel, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS k FROM ticks),
f AS (SELECT symbol, 0::BIGINT AS k, 'SEARCHING' AS mode, NULL::DOUBLE AS since, NULL::DOUBLE AS entered, NULL::VARCHAR AS transition FROM (SELECT DISTINCT symbol FROM n)
 UNION ALL SELECT symbol, k, m2, CASE WHEN m2 <> m1 THEN t ELSE s1 END, CASE WHEN channel = 'click' AND m1 = 'ENTERING' THEN t ELSE entered END,
 nullif(concat_ws(',', CASE WHEN m1 <> mode THEN CASE mode WHEN 'ENTERING' THEN 'entry' WHEN 'EXITING' THEN 'exit' ELSE 'position' END || '_timeout' END,
  CASE WHEN m2 <> m1 OR (channel = 'error') THEN CASE channel WHEN 'view' THEN 'entry_signal' WHEN 'click' THEN 'position_entered' WHEN 'purchase' THEN 'exit_signal' WHEN 'signup' THEN 'position_exited' WHEN 'error' THEN CASE WHEN m1 = 'ERROR' THEN 'reset' END END END), '') FROM (
 SELECT *, CASE WHEN channel = 'view' AND m1 = 'SEARCHING' THEN 'ENTERING' WHEN channel = 'click' AND m1 = 'ENTERING' THEN 'IN_POSITION' WHEN channel = 'purchase' AND m1 = 'IN_POSITION' THEN 'EXITING'
  WHEN channel = 'signup' AND m1 = 'EXITING' THEN 'SEARCHING' WHEN channel = 'error' AND m1 = 'ERROR' THEN 'SEARCHING' ELSE m1 END AS m2 FROM (
 SELECT *, CASE WHEN m1 <> mode THEN t ELSE since END AS s1 FROM (
 SELECT n.symbol, n.k, n.channel, n.t, p.mode, p.since, p.entered, CASE WHEN p.mode IN ('ENTERING', 'EXITING') AND n.t - p.since > 86400 THEN 'ERROR' WHEN p.mode = 'IN_POSITION' AND n.t - p.entered > 259200 THEN 'EXITING' ELSE p.mode END AS m1
 FROM f p JOIN n ON n.symbol = p.symbol AND n.k = p.k + 1))))"""


@query("st05_trade_lifecycle", sql("ticks", f"WITH RECURSIVE {LIFE} SELECT symbol, seq, mode AS state, transition FROM n JOIN f USING (symbol, k)"))
def trade_lifecycle(spark, sf):
    t = F.create_map(*[x for k, v in TRIGGERS.items() for x in (F.lit(k), F.lit(v))])
    d = V.ticks(spark, sf).withColumn("trigger", t[F.col("channel")])
    return Q.trade_lifecycle(d, TICKS, ["symbol", "seq"], entry_s=86_400.0, exit_s=86_400.0, hold_s=3 * 86_400.0)


@query("st06_average_cost_positions", sql("fills", f"WITH RECURSIVE {POSITIONS_SQL} SELECT symbol, seq, {r('position', 3)} AS position, {rs('realized realized_total unrealized', 2)}, {r('cost', 3)} AS average_cost FROM positions"))
def average_cost_positions(spark, sf):
    d = V.fills(spark, sf).select("symbol", "ts", "seq", "side", "quantity", "price")
    return shaped(K.average_cost_positions(d), 2, "symbol seq position realized realized_total unrealized average_cost", per={"position": 3, "average_cost": 3})


@query("st07_portfolio_value", sql("fills", f"""WITH a AS (SELECT *, CASE side WHEN 'buy' THEN quantity ELSE -quantity END AS q FROM fills),
b AS (SELECT *, sum(q) OVER w AS position, 1000000 + sum(-q * price - fee) OVER w AS cash FROM a WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, cash + position * price AS value FROM b), d AS (SELECT *, lag(value) OVER (PARTITION BY symbol ORDER BY ts, seq) AS p, max(value) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS peak FROM c)
SELECT symbol, seq, {rs('cash value peak', 2)}, {r('CASE WHEN p > 0 THEN value / p - 1 END')} AS ret FROM d"""))
def portfolio_value(spark, sf):
    d = V.fills(spark, sf).select("symbol", "ts", "seq", "side", "quantity", "price", "fee")
    d = K.portfolio_value(d).withColumnRenamed("return", "ret")
    return shaped(d, 2, "symbol seq cash value peak ret", per={"ret": 6})


SIDE = """n AS (SELECT symbol, ts, seq, z_score AS z, entry, exit, stop, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS k FROM d),
f AS (SELECT symbol, 0::BIGINT AS k, NULL::VARCHAR AS side, 'hold' AS signal, 0.0::DOUBLE AS strength FROM (SELECT DISTINCT symbol FROM n)
 UNION ALL SELECT n.symbol, n.k,
 CASE WHEN p.side IS NULL THEN CASE WHEN z <= -entry THEN 'long' WHEN z >= entry THEN 'short' END
  WHEN p.side = 'long' THEN CASE WHEN z >= -exit OR z <= -stop THEN NULL ELSE 'long' END ELSE CASE WHEN z <= exit OR z >= stop THEN NULL ELSE 'short' END END,
 CASE WHEN p.side IS NULL THEN CASE WHEN z <= -entry THEN 'entry_long' WHEN z >= entry THEN 'entry_short' ELSE 'hold' END
  WHEN p.side = 'long' THEN CASE WHEN z >= -exit OR z <= -stop THEN 'exit' ELSE 'hold' END ELSE CASE WHEN z <= exit OR z >= stop THEN 'exit' ELSE 'hold' END END,
 CASE WHEN p.side IS NULL THEN CASE WHEN z <= -entry OR z >= entry THEN least(1.0, abs(z / entry)) ELSE 0.0 END
  WHEN p.side = 'long' THEN CASE WHEN z <= -stop THEN 1.0 WHEN z >= -exit THEN least(1.0, abs(z / exit)) ELSE 0.0 END ELSE CASE WHEN z >= stop THEN 1.0 WHEN z <= exit THEN least(1.0, abs(z / exit)) ELSE 0.0 END END
 FROM f p JOIN n ON n.symbol = p.symbol AND n.k = p.k + 1)"""


@query("st08_threshold_signals", sql("ticks", f"WITH RECURSIVE {ADAPTIVE}, {SIDE} SELECT n.symbol, n.seq, signal, {r('strength')} AS strength, side FROM n JOIN f USING (symbol, k)"))
def threshold_signals(spark, sf):
    signals = lambda x, s: Q.threshold_signals(R.adaptive_thresholds(with_volatility(x, s), "price", "vol", s=s), s, ["symbol", "seq"])
    return shaped(by_key_size(V.ticks(spark, sf).select("symbol", "ts", "seq", "price"), TICKS, signals))


SPREAD = """z AS (SELECT *, CASE WHEN count(price) OVER w >= 2 THEN coalesce((price - avg(price) OVER w) / nullif(stddev_samp(price) OVER w, 0), 0) END AS z, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS k FROM ticks
 WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)),
f AS (SELECT symbol, 0::BIGINT AS k, NULL::VARCHAR AS side, 'hold' AS signal FROM (SELECT DISTINCT symbol FROM z)
 UNION ALL SELECT z.symbol, z.k, CASE WHEN z.z IS NULL THEN p.side WHEN p.side IS NULL THEN CASE WHEN z.z <= -1.0 THEN 'long' WHEN z.z >= 1.5 THEN 'short' END
  WHEN abs(z.z) <= 0.5 OR (p.side = 'long' AND z.z < -4) OR (p.side = 'short' AND z.z > 4) THEN NULL ELSE p.side END,
 CASE WHEN z.z IS NULL THEN 'hold' WHEN p.side IS NULL THEN CASE WHEN z.z <= -1.0 THEN 'entry_long' WHEN z.z >= 1.5 THEN 'entry_short' ELSE 'hold' END
  WHEN abs(z.z) <= 0.5 THEN 'exit' WHEN (p.side = 'long' AND z.z < -4) OR (p.side = 'short' AND z.z > 4) THEN 'stop_loss' ELSE 'hold' END FROM f p JOIN z ON z.symbol = p.symbol AND z.k = p.k + 1)"""


@query("st09_spread_signals", sql("ticks", f"""WITH RECURSIVE {SPREAD}, level AS (SELECT *, CASE signal WHEN 'entry_long' THEN 1.0 WHEN 'entry_short' THEN 1.5 WHEN 'hold' THEN NULL ELSE 0.5 END::DOUBLE AS threshold FROM z JOIN f USING (symbol, k)),
graded AS (SELECT *, CASE WHEN abs(z) / threshold >= 2 THEN 'very_strong' WHEN abs(z) / threshold >= 1.5 THEN 'strong' WHEN abs(z) / threshold >= 1.2 THEN 'medium' ELSE 'weak' END AS strength FROM level) SELECT symbol, seq, signal, side, {r("CASE signal WHEN 'entry_long' THEN price + 0.5 WHEN 'entry_short' THEN price - 0.5 END")} AS price1,
{r("CASE signal WHEN 'entry_long' THEN price / 15 - 0.1 WHEN 'entry_short' THEN price / 15 + 0.1 END")} AS price2, threshold, strength, {r("""CASE WHEN signal = 'hold' THEN CASE WHEN z IS NULL THEN 0 ELSE 0.5 END ELSE
 least(1, greatest(0, (CASE strength WHEN 'weak' THEN 0.3 WHEN 'medium' THEN 0.6 WHEN 'strong' THEN 0.8 ELSE 0.9 END + (1 / (1 + price / 50) + CASE channel WHEN 'error' THEN 0.6 WHEN 'signup' THEN 0.9 ELSE 0.8 END) / 2) / 2))
 * CASE channel WHEN 'error' THEN 0.8 WHEN 'signup' THEN 1.1 ELSE 1 END END""")} AS confidence FROM graded"""))
def spread_signals(spark, sf):
    return by_key_size(V.ticks(spark, sf).drop("props"), TICKS, _spread_signals)


def _spread_signals(ticks, s):
    d = R.spread_zscore(ticks, "price", s=s)
    d = d.withColumns({
        "entry_long": F.lit(-1.0), "entry_short": F.lit(1.5), "exit": F.lit(0.5), "bid1": F.col("price") - 0.5, "ask1": F.col("price") + 0.5,
        "bid2": F.col("price") / 15 - 0.1, "ask2": F.col("price") / 15 + 0.1, "hedge_confidence": 1 / (1 + F.col("price") / 50),
        "vol_regime": F.when(F.col("channel") == "error", "high").when(F.col("channel") == "signup", "low").otherwise("normal")})
    return shaped(Q.spread_signals(d, s, ["symbol", "seq"]), columns="symbol seq signal side price1 price2 threshold strength confidence")


@query("st10_rolling_garch")
def rolling_garch(spark, sf):
    d = G.rolling_garch(V.bars_1h(spark, sf), "close", BARS, ["symbol", "ts"])
    return shaped(d, 4)


SMOOTH = """n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS k FROM regimes),
f AS (SELECT symbol, 0::BIGINT AS k, 'unknown' AS cur, MAP {}::MAP(VARCHAR, INTEGER) AS cnt, 0.0::DOUBLE AS conf, NULL::DOUBLE AS start, 0.0::DOUBLE AS spent FROM (SELECT DISTINCT symbol FROM n)
 UNION ALL SELECT symbol, k, CASE WHEN c >= 0.3 AND regime <> cur AND seen >= 3 THEN regime ELSE cur END,
 CASE WHEN c < 0.3 THEN cnt WHEN regime = cur OR seen >= 3 THEN MAP {}::MAP(VARCHAR, INTEGER) ELSE map_concat(cnt, MAP {regime: seen}) END,
 CASE WHEN c < 0.3 THEN c * 0.8 WHEN regime <> cur AND seen < 3 THEN c * 0.9 ELSE c END, CASE WHEN c >= 0.3 AND regime <> cur AND seen >= 3 THEN t ELSE s1 END, t - s1 FROM (
 SELECT n.symbol, n.k, n.regime, n.confidence AS c, epoch_us(n.ts) / 1e6 AS t, coalesce(p.start, epoch_us(n.ts) / 1e6) AS s1, p.cur, p.cnt, coalesce(p.cnt[n.regime], 0) + 1 AS seen FROM f p JOIN n ON n.symbol = p.symbol AND n.k = p.k + 1)),
g AS (SELECT n.symbol, n.seq, f.cur AS smoothed, f.conf, f.spent, lag(f.cur, 1, 'unknown') OVER (PARTITION BY n.symbol ORDER BY n.k) AS prev FROM n JOIN f USING (symbol, k))"""


@query("st11_regime_smoothing", sql("regimes", f"WITH RECURSIVE {SMOOTH} SELECT symbol, seq, smoothed, {r('conf')} AS smoothed_confidence, CASE WHEN prev <> smoothed THEN prev END AS from_regime, {r('spent', 3)} AS seconds_in_regime FROM g"))
def regime_smoothing(spark, sf):
    d = Q.regime_smoothing(V.regimes(spark, sf), TICKS, ["symbol", "seq"])
    return shaped(d, columns="symbol seq smoothed smoothed_confidence from_regime seconds_in_regime", per={"seconds_in_regime": 3})


LEARN = """p AS (SELECT event_type AS regime, date_trunc('day', ts)::TIMESTAMP AS ts, (avg(value) - 45) / stddev_pop(value) * 10 AS sharpe, count(*) FILTER (value > 30) / count(*) AS win_rate, min(value) / 3 AS max_drawdown FROM events GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY regime ORDER BY ts) AS k FROM p),
l AS (SELECT regime, 0::BIGINT AS k, 1.0::DOUBLE AS pf, 1.0::DOUBLE AS kf, 1.0::DOUBLE AS ef, 1.0::DOUBLE AS xf FROM (SELECT DISTINCT regime FROM n)
 UNION ALL SELECT regime, k, CASE WHEN max_drawdown > 0.1 THEN greatest(0.3, p1 * 0.95) ELSE p1 END, CASE WHEN max_drawdown > 0.1 THEN greatest(0.3, k1 * 0.95) ELSE k1 END, e1, x1 FROM (
 SELECT n.regime, n.k, n.max_drawdown, CASE WHEN sharpe > 1.5 THEN least(1.2, pf * 1.02) WHEN sharpe < 0.5 THEN greatest(0.5, pf * 0.98) ELSE pf END AS p1, CASE WHEN sharpe > 1.5 THEN least(1.2, kf * 1.01) ELSE kf END AS k1,
 CASE WHEN sharpe < 0.5 AND NOT sharpe > 1.5 THEN least(1.5, ef * 1.01) ELSE ef END AS e1, CASE WHEN win_rate > 0.6 THEN greatest(0.7, xf * 0.99) WHEN win_rate < 0.4 THEN least(1.3, xf * 1.01) ELSE xf END AS x1
 FROM l JOIN n ON n.regime = l.regime AND n.k = l.k + 1))"""


@query("st12_performance_learning", f"WITH RECURSIVE {LEARN} SELECT regime, ts, {r('pf')} AS position_factor, {r('kf')} AS kelly_factor, {r('ef')} AS entry_factor, {r('xf')} AS exit_factor FROM n JOIN l USING (regime, k)")
def performance_learning(spark, sf):
    d = V.channel_ticks(spark, sf).groupBy(F.col("symbol").alias("regime"), F.date_trunc("day", "ts").alias("ts")).agg(
        ((F.avg("price") - 45) / F.stddev_pop("price") * 10).alias("sharpe"), (F.count_if(F.col("price") > 30) / F.count(F.lit(1))).alias("win_rate"), (F.min("price") / 3).alias("max_drawdown"))
    return shaped(Q.performance_learning(d, Series(("regime",), ("ts",), True), ["regime", "ts"]))


GATE = """n AS (SELECT symbol AS account, seq, order_id % 5 + 1 AS s, CASE side WHEN 'buy' THEN quantity ELSE -quantity END AS q, price AS px, epoch(ts) // 86400 AS today, kelly.kelly,
 row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS k FROM fills LEFT JOIN kelly ON kelly.pair = fills.symbol),
f AS (SELECT account, 0::BIGINT AS k, 1e6::DOUBLE AS cash, [0, 0, 0, 0, 0]::DOUBLE[] AS held, [0, 0, 0, 0, 0]::DOUBLE[] AS last, 1e6::DOUBLE AS peak, NULL::DOUBLE AS day, 1e6::DOUBLE AS opened, NULL::VARCHAR AS halted, 0.0::DOUBLE AS approved, NULL::VARCHAR AS reason, NULL::VARCHAR AS result FROM (SELECT DISTINCT account FROM n)
 UNION ALL SELECT account, k, cash - a * px, list_transform(held, lambda x, i: CASE WHEN i = s THEN x + a ELSE x END), last, peak, day, opened, halted, a, why,
 CASE WHEN why IN ('trading_halted', 'daily_loss_limit', 'max_drawdown') THEN 'halted' WHEN why IS NOT NULL THEN 'rejected' WHEN a <> q THEN 'modified' ELSE 'approved' END FROM (
 SELECT *, CASE WHEN why IS NULL THEN fit ELSE 0 END AS a FROM (
 SELECT *, CASE stop WHEN 'daily_loss_limit' THEN 'daily_loss' WHEN 'max_drawdown' THEN 'drawdown' ELSE halt1 END AS halted, coalesce(stop, CASE WHEN value <= 0 THEN 'insufficient_capital' WHEN abs(fit) < 1e-8 THEN 'position_size_exceeded'
  WHEN abs((pos + fit) * px) / value > 0.2 THEN 'concentration_risk' WHEN value < abs(fit * px) * 0.1 + 1000 THEN 'insufficient_capital' END) AS why FROM (
 SELECT *, CASE WHEN abs((pos + q) * px) <= most THEN q WHEN abs(pos * px) >= most THEN 0 WHEN q > 0 THEN least(q, (most - abs(pos * px)) / px) ELSE greatest(q, -(most - abs(pos * px)) / px) END AS fit,
  CASE WHEN halt1 IS NOT NULL THEN 'trading_halted' WHEN abs(q) < 1e-8 OR px <= 0 THEN 'invalid_order' WHEN opened > 0 AND (opened - value) / opened > 0.05 THEN 'daily_loss_limit' WHEN fall > 0.15 THEN 'max_drawdown' END AS stop FROM (
 SELECT *, CASE WHEN fresh THEN today ELSE day0 END AS day, CASE WHEN fresh THEN value ELSE opened0 END AS opened, CASE WHEN fresh AND halt0 = 'daily_loss' AND fall <= 0.15 THEN NULL ELSE halt0 END AS halt1 FROM (
 SELECT *, CASE WHEN peak > 0 THEN (peak - value) / peak ELSE 0 END AS fall, day0 IS NULL OR today > day0 AS fresh, value * CASE WHEN kelly > 0 THEN least(0.1, kelly * 0.25) ELSE 0.1 END AS most FROM (
 SELECT *, greatest(peak0, value) AS peak, held[s] AS pos FROM (
 SELECT *, cash + list_inner_product(held, last) AS value FROM (
 SELECT n.*, f.cash, f.held, list_transform(f.last, lambda x, i: CASE WHEN i = n.s AND n.px > 0 THEN n.px ELSE x END) AS last, f.peak AS peak0, f.day AS day0, f.opened AS opened0, f.halted AS halt0
 FROM f JOIN n ON n.account = f.account AND n.k = f.k + 1)))))))))"""


@query("st13_order_risk_gate", sql("fills closed_trades", f"WITH RECURSIVE {KELLY}, {GATE} SELECT account, seq, result, {r('approved', 4)} AS approved, reason FROM n JOIN f USING (account, k)"))
def order_risk_gate(spark, sf):
    kelly = fraction_of_pairs(spark, sf).select(F.col("pair").alias("account"), "kelly")
    f = V.fills(spark, sf)
    d = f.withColumns({"account": F.col("symbol"), "symbol": F.concat(F.lit("A"), (F.col("order_id") % 5).cast("string")), "quantity": F.when(F.col("side") == "buy", F.col("quantity")).otherwise(-F.col("quantity"))})
    d = d.select("account", "ts", "seq", "symbol", "quantity", "price")
    gate = lambda x, s: Q.order_risk_gate(x.join(broadcast_if_small(kelly), "account", "left"), s, ["account", "seq"], capital=1_000_000.0)
    return shaped(by_key_size(d, Series(("account",), ("ts", "seq")), gate), 4)
