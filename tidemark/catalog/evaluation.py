"""Cross-validation and comparison queries (V1-V7, T1-T6, A31, ST14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.aggregates import EQ, METRIC_NAMES, METRICS_SQL
from tidemark.catalog.base import query, r, rs, shaped, sql
from tidemark.functions.maths import sql_two_sided_normal_p
from tidemark.operators import aggregates as A
from tidemark.operators import comparison as C
from tidemark.operators import rolling as R
from tidemark.operators import validation as W
from tidemark.plans.series import Series
from tidemark.session import checkpointed
from tidemark.sources import views as V

MICROS = "make_timestamp(floor({})::BIGINT)"
BOUNDS = "bounds AS (SELECT epoch_us(min(ts)) AS t0, epoch_us(max(ts)) AS t1, (epoch_us(max(ts)) - epoch_us(min(ts)))::DOUBLE AS span FROM equity)"
TESTS = f"""ids AS (SELECT range AS split_id FROM range(6)),
ts0 AS (SELECT split_id, t0 + span * 0.1::DOUBLE + span * (0.8::DOUBLE - 0.15::DOUBLE) * split_id / 6.0::DOUBLE AS s, span * 0.15::DOUBLE AS len FROM ids, bounds),
tests AS (SELECT split_id, {MICROS.format('s')} AS start, {MICROS.format('s + len')} AS "end" FROM ts0)"""
CANDS = f"""c0 AS (SELECT a.range AS size_id, b.range AS offset_id, t0, span, span * (0.1::DOUBLE + 0.3::DOUBLE * a.range / 4.0::DOUBLE) AS len FROM range(5) a, range(8) b, bounds),
c1 AS (SELECT size_id, offset_id, t0 + (span - len) * offset_id / 8.0::DOUBLE AS s, len, span FROM c0),
cands AS (SELECT *, row_number() OVER (ORDER BY start, "end") AS candidate FROM (SELECT size_id, offset_id, {MICROS.format('s')} AS start, {MICROS.format('s + len')} AS "end", span FROM c1))"""
VALID = """valid AS (SELECT split_id, candidate, size_id, c.start, c."end", span FROM cands c JOIN tests t ON c."end" < t.start - INTERVAL 24 HOUR OR c.start > t."end" + INTERVAL 24 HOUR)"""


def _bounds(spark, sf):
    return W.time_bounds(V.equity(spark, sf))


def _tests(spark, sf):
    return W.test_periods(_bounds(spark, sf), 6, 0.15)


def _valid(spark, sf):
    return checkpointed(W.embargo_filter(W.candidate_periods(_bounds(spark, sf)), _tests(spark, sf)))  # a few hundred rows, read often


@query("v01_cv_test_periods", sql("equity", f'WITH {BOUNDS}, {TESTS} SELECT split_id, start, "end" FROM tests'))
def cv_test_periods(spark, sf):
    return shaped(_tests(spark, sf))


@query("v02_cv_candidate_periods", sql("equity", f'WITH {BOUNDS}, {CANDS} SELECT size_id, offset_id, start, "end", candidate FROM cands'))
def cv_candidate_periods(spark, sf):
    return shaped(W.candidate_periods(_bounds(spark, sf)), columns="size_id offset_id start end candidate")


@query("v03_cv_embargo_filter", sql("equity", f"WITH {BOUNDS}, {TESTS}, {CANDS}, {VALID} SELECT split_id, candidate FROM valid"))
def cv_embargo_filter(spark, sf):
    return _valid(spark, sf).select("split_id", "candidate")


SELECTED = f"""e AS (SELECT split_id, candidate AS i, epoch_us(start) AS s, epoch_us("end") AS e, span FROM valid),
sets AS (SELECT split_id, span, [i] AS path, i AS last, e AS last_end, e - s AS length, 0::BIGINT AS gap FROM e
 UNION ALL SELECT a.split_id, a.span, list_append(a.path, b.i), b.i, b.e, a.length + b.e - b.s, a.gap + greatest(b.s - a.last_end, 0) FROM sets a JOIN e b ON a.split_id = b.split_id AND b.i > a.last WHERE len(a.path) < 8),
scored AS (SELECT *, round(0.7 * (1 - abs(length - span * 0.6) / (span * 0.6)) + 0.3 * (1 / (1 + gap / length)), 9) AS score FROM sets),
best AS (SELECT split_id, score, path, row_number() OVER (PARTITION BY split_id ORDER BY score DESC, len(path), path) AS k FROM scored),
chosen AS (SELECT split_id, score, unnest(path) AS candidate FROM best WHERE k = 1),
train AS (SELECT c.split_id, c.candidate, c.score, v.start, v."end" FROM chosen c JOIN valid v ON c.split_id = v.split_id AND c.candidate = v.candidate)"""
CV = f"{BOUNDS}, {TESTS}, {CANDS}, {VALID}, {SELECTED}"


def _train(spark, sf):
    return checkpointed(W.select_periods(_valid(spark, sf), max_periods=8))  # a few rows per split


@query("v04_cv_select_periods", sql("equity", f'WITH RECURSIVE {CV} SELECT split_id, candidate, start, "end", {r("score")} AS score FROM train'))
def cv_select_periods(spark, sf):
    return shaped(_train(spark, sf))


@query("v04b_cv_select_eight", sql("equity", f'WITH RECURSIVE {CV} SELECT split_id, candidate, start, "end", {r("score")} AS score FROM train'))
def cv_select_eight(spark, sf):
    return shaped(W.select_periods(_valid(spark, sf)))


PURGED = """pc AS (SELECT split_id, start - INTERVAL 12 HOUR AS start, "end" + INTERVAL 12 HOUR AS "end" FROM tests
 UNION ALL SELECT tr.split_id, tr."end", least(tr."end" + INTERVAL 12 HOUR, te.start) FROM train tr JOIN tests te USING (split_id) WHERE tr."end" < te.start
 UNION ALL SELECT tr.split_id, greatest(tr.start - INTERVAL 12 HOUR, te."end"), tr.start FROM train tr JOIN tests te USING (split_id) WHERE tr.start > te."end"),
pm AS (SELECT *, max("end") OVER (PARTITION BY split_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM pc WHERE "end" > start),
pi AS (SELECT *, sum(CASE WHEN past IS NULL OR start > past THEN 1 ELSE 0 END) OVER (PARTITION BY split_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM pm),
purged AS (SELECT split_id, min(start) AS start, max("end") AS "end" FROM pi GROUP BY split_id, island)"""


def _purged(spark, sf):
    return W.purge_periods(_train(spark, sf), _tests(spark, sf))


@query("v05_cv_purge", sql("equity", f'WITH RECURSIVE {CV}, {PURGED} SELECT split_id, start, "end" FROM purged'))
def cv_purge(spark, sf):
    return shaped(_purged(spark, sf))


FLAGS = """flags AS (SELECT q.strategy, q.ts, q.value, t.split_id, q.ts BETWEEN t.start AND t."end" AS is_test,
 EXISTS (SELECT 1 FROM purged p WHERE p.split_id = t.split_id AND q.ts BETWEEN p.start AND p."end") AS is_purged,
 EXISTS (SELECT 1 FROM train p WHERE p.split_id = t.split_id AND q.ts BETWEEN p.start AND p."end") AS raw_train FROM equity q, tests t),
f2 AS (SELECT *, raw_train AND NOT is_purged AS is_train FROM flags)"""


def _intervals(spark, sf):
    train, tests = _train(spark, sf), _tests(spark, sf)
    return W.interval_table(train, tests, W.purge_periods(train, tests))


def _flags(spark, sf):
    return W.flag_rows(V.equity(spark, sf), _intervals(spark, sf))


@query("v06_cv_validate", sql("equity", f"""WITH RECURSIVE {CV}, {PURGED}, {FLAGS} SELECT split_id, count(*) FILTER (is_train) AS train_size, count(*) FILTER (is_test) AS test_size, count(*) FILTER (is_purged) AS purged_size,
bool_or(is_train AND is_test) AS train_test_overlap, bool_or(is_train AND is_purged) AS train_purged_overlap, bool_or(raw_train AND is_test) AS leakage, NOT bool_or(is_train AND (is_test OR is_purged)) AS valid FROM f2 GROUP BY 1"""))
def cv_validate(spark, sf):
    return W.validate_splits(_flags(spark, sf))


@query("a31_cv_coverage", sql("equity", f"""WITH RECURSIVE {CV}, {PURGED}, {FLAGS}, p AS (SELECT strategy, ts, bool_or(is_train) AS tr, bool_or(is_test) AS te FROM f2 GROUP BY 1, 2)
SELECT {r('100.0 * count(*) FILTER (tr) / count(*)')} AS train, {r('100.0 * count(*) FILTER (te) / count(*)')} AS test, {r('100.0 * count(*) FILTER (tr OR te) / count(*)')} AS either, {r('100.0 * count(*) FILTER (tr AND te) / count(*)')} AS both FROM p"""))
def cv_coverage(spark, sf):
    d = _flags(spark, sf).withColumn("row_id", F.struct("strategy", "ts"))
    return shaped(W.coverage(d, "row_id"))


@query("v07_cv_run", sql("equity", f"""WITH {BOUNDS}, {TESTS}, eq2 AS (SELECT strategy, split_id, ts, value FROM equity q JOIN tests t ON q.ts BETWEEN t.start AND t."end"),
g AS (SELECT split_id, ts, sum(value) AS value FROM eq2 GROUP BY 1, 2), {METRICS_SQL.replace('FROM equity', 'FROM (SELECT split_id AS strategy, ts, value FROM g)')}
SELECT strategy AS split_id, {rs('initial final peak', 2)}, {rs(METRIC_NAMES, 5)} FROM perf"""))
def cv_run(spark, sf):
    def metrics(d):
        daily = d.groupBy("split_id", "ts").agg(F.sum("value").alias("value"))
        return A.performance_metrics(daily, Series(("split_id",), ("ts",), True))

    tests = _tests(spark, sf)
    d = W.run_splits(V.equity(spark, sf), W.interval_table(tests.filter("false"), tests), metrics)
    return shaped(d, 5, per={"initial": 2, "final": 2, "peak": 2})


def _moments(spark, sf):
    ret = R.returns(V.equity(spark, sf), "value", EQ)
    return C.paired_moments(ret, "N0", EQ)


MOMENTS = """r0 AS (SELECT strategy, ts, lag(value) OVER (PARTITION BY strategy ORDER BY ts) AS p, value FROM equity),
r1 AS (SELECT strategy, CASE WHEN value > 0 AND p > 0 THEN value / p - 1 ELSE 0.0 END AS ret, row_number() OVER (PARTITION BY strategy ORDER BY ts DESC) AS k FROM r0 WHERE p IS NOT NULL),
m AS (SELECT x.strategy, count(*) AS n, avg(c.ret) AS m1, avg(x.ret) AS m2, stddev_pop(c.ret) AS s1, stddev_pop(x.ret) AS s2, corr(c.ret, x.ret) AS rho FROM r1 x JOIN r1 c ON c.strategy = 'N0' AND c.k = x.k WHERE x.strategy <> 'N0' GROUP BY 1)"""
JK = f"""j0 AS (SELECT *, m1 / s1 AS sharpe1, m2 / s2 AS sharpe2 FROM m), j1 AS (SELECT *, 1 + 0.5 * sharpe1 ** 2 AS g1, 1 + 0.5 * sharpe2 ** 2 AS g2 FROM j0),
j2 AS (SELECT *, (sharpe2 - sharpe1) / sqrt((g1 + g2 - 2 * rho * sqrt(g1 * g2)) / n) AS jk_z FROM j1), jk AS (SELECT *, {sql_two_sided_normal_p('jk_z')} AS jk_p FROM j2)"""


@query("t01_jobson_korkie", sql("equity", f"WITH {MOMENTS}, {JK} SELECT strategy, n, {rs('sharpe1 sharpe2 jk_z jk_p')}, sharpe2 > sharpe1 AND jk_p < 0.05 AS jk_promote FROM jk"))
def jobson_korkie(spark, sf):
    return shaped(C.jobson_korkie(_moments(spark, sf)), columns="strategy n sharpe1 sharpe2 jk_z jk_p jk_promote")


def sql_tail(theta: str, df: str) -> str:
    """Two-sided tail of a t law with ``df`` degrees at t = sqrt(df) tan(theta), by Simpson's rule over the angle."""
    area = f"list_sum(list_transform(range(0, 2001), lambda i: CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * cos({theta} * i / 2000) ** ({df} - 1))) * {theta} / 6000"
    return f"(1 - {area} / (sqrt(pi()) / 2 * exp(lgamma({df} / 2) - lgamma(({df} + 1) / 2))))"


WELCH = f"""w0 AS (SELECT *, s1 ** 2 / (n - 1) AS v1, s2 ** 2 / (n - 1) AS v2, (m2 - m1) / sqrt((s1 ** 2 + s2 ** 2) / 2) AS cohens_d FROM m),
w1 AS (SELECT *, (m2 - m1) / sqrt(v1 + v2) AS welch_t, (v1 + v2) ** 2 * (n - 1) / (v1 ** 2 + v2 ** 2) AS welch_df FROM w0),
w2 AS (SELECT *, atan(abs(welch_t) / sqrt(welch_df)) AS th FROM w1),
welch AS (SELECT *, {sql_tail('th', 'welch_df')} AS welch_p FROM w2)"""
WELCH_OK = "m2 > m1 AND welch_p < 0.05 AND cohens_d > 0.2"


@query("t02_welch_ttest", sql("equity", f"WITH {MOMENTS}, {WELCH} SELECT strategy, {rs('welch_t cohens_d')}, {r('welch_df', 4)} AS welch_df, {r('welch_p', 5)} AS welch_p, {WELCH_OK} AS welch_promote FROM welch"))
def welch_ttest(spark, sf):
    return shaped(C.welch_ttest(_moments(spark, sf)), columns="strategy welch_t welch_df cohens_d welch_p welch_promote", per={"welch_df": 4, "welch_p": 5})


# with equal degrees, the F law is that of a t angle
STEADY = f"""s0 AS (SELECT *, (s1 / s2) ** 2 AS f_stat, (s1 - s2) / s1 AS stability_gain, (n - 1)::DOUBLE AS d FROM m), s3 AS (SELECT *, abs(2 * atan(sqrt(f_stat)) - pi() / 2) AS th FROM s0),
steady AS (SELECT *, {sql_tail('th', 'd')} AS f_p FROM s3)"""
STEADY_OK = "s2 < s1 AND f_p < 0.05 AND stability_gain > 0.05"


@query("t03_variance_f_test", sql("equity", f"WITH {MOMENTS}, {STEADY} SELECT strategy, {rs('f_stat stability_gain f_p', 5)}, {STEADY_OK} AS f_promote FROM steady"))
def variance_f_test(spark, sf):
    return shaped(C.variance_f_test(_moments(spark, sf)), 5, "strategy f_stat stability_gain f_p f_promote")


def _sides(spark, sf):
    p = A.performance_metrics(V.equity(spark, sf), EQ)
    one = p.filter("strategy = 'N0'").select(F.col("max_drawdown").alias("dd1"), F.col("calmar").alias("calmar1"), F.col("sharpe").alias("sr1"))
    two = p.filter("strategy <> 'N0'").select("strategy", F.col("max_drawdown").alias("dd2"), F.col("calmar").alias("calmar2"), F.col("sharpe").alias("sr2"))
    return two.crossJoin(F.broadcast(one))


SIDES = "sides AS (SELECT b.strategy, a.max_drawdown AS dd1, b.max_drawdown AS dd2, a.calmar AS calmar1, b.calmar AS calmar2, a.sharpe AS sr1, b.sharpe AS sr2 FROM perf a, perf b WHERE a.strategy = 'N0' AND b.strategy <> 'N0')"


@query("t04_relative_improvement", sql("equity", f"""WITH {METRICS_SQL}, {SIDES}, g AS (SELECT *, (dd1 - dd2) / dd1 AS dd_gain, (calmar2 - calmar1) / abs(calmar1) AS calmar_gain, (sr2 - sr1) / abs(sr1) AS sharpe_gain FROM sides)
SELECT strategy, {rs('dd_gain calmar_gain sharpe_gain', 4)}, dd2 < dd1 AND dd_gain > 0.1 AS dd_promote, calmar2 > calmar1 AND calmar_gain > 0.1 AS calmar_promote, sr2 > sr1 AND sharpe_gain > 0.1 AS sharpe_promote FROM g"""))
def relative_improvement(spark, sf):
    return shaped(C.simple_tests(_sides(spark, sf)), 4, "strategy dd_gain calmar_gain sharpe_gain dd_promote calmar_promote sharpe_promote")


DECIDED = """d AS (SELECT strategy, count(*) AS tests, count(*) FILTER (ok) AS favourable, max(n) AS samples, coalesce(sum(w * conf) FILTER (ok) / nullif(sum(w) FILTER (ok), 0), 0) AS confidence FROM t GROUP BY 1),
pz AS (SELECT *, favourable >= greatest(1, tests // 2) AND confidence >= 0.8 AND samples >= 30 AS passes FROM d)"""


@query("t05_promotion_decision", sql("equity", f"""WITH {METRICS_SQL}, {SIDES}, {MOMENTS}, {JK}, {WELCH}, {STEADY},
t AS (SELECT strategy, 'sharpe' AS test, sharpe2 > sharpe1 AND jk_p < 0.05 AS ok, 1 - jk_p AS conf, n, 0.3 AS w FROM jk
 UNION ALL SELECT strategy, 'returns', {WELCH_OK}, 1 - welch_p, n, 0.3 FROM welch
 UNION ALL SELECT strategy, 'drawdown', dd2 < dd1 AND (dd1 - dd2) / dd1 > 0.1, least(0.9, (dd1 - dd2) / dd1), 0, 0.2 FROM sides
 UNION ALL SELECT strategy, 'calmar', calmar2 > calmar1 AND (calmar2 - calmar1) / abs(calmar1) > 0.1, least(0.9, (calmar2 - calmar1) / abs(calmar1)), 0, 0.15 FROM sides
 UNION ALL SELECT strategy, 'stability', {STEADY_OK}, 1 - f_p, n, 0.3 FROM steady),
{DECIDED}
SELECT strategy, tests, favourable, samples, {r('confidence', 5)} AS confidence, passes, passes AND row_number() OVER (PARTITION BY passes ORDER BY strategy) = 1 AS promoted FROM pz"""))
def promotion_decision(spark, sf):
    tests = C.promotion_tests(_moments(spark, sf), _sides(spark, sf), "strategy")
    return shaped(C.promotion_decision(tests, "strategy", F.col("n")), 5)


@query("t05b_promotion_three_tests", sql("equity", f"""WITH {METRICS_SQL}, {SIDES}, {MOMENTS}, {JK},
t AS (SELECT strategy, 'sharpe' AS test, sharpe2 > sharpe1 AND jk_p < 0.5 AS ok, 1 - jk_p AS conf, n, 0.3 AS w FROM jk
 UNION ALL SELECT strategy, 'drawdown', dd2 < dd1 AND (dd1 - dd2) / dd1 > 0.0001, 0.9, 0, 0.2 FROM sides
 UNION ALL SELECT strategy, 'calmar', calmar2 > calmar1 AND (calmar2 - calmar1) / abs(calmar1) > 0.1, least(0.9, (calmar2 - calmar1) / abs(calmar1)), 0, 0.15 FROM sides),
d AS (SELECT strategy, count(*) AS tests, count(*) FILTER (ok) AS favourable, max(n) AS samples, coalesce(sum(w * conf) FILTER (ok) / nullif(sum(w) FILTER (ok), 0), 0) AS confidence FROM t GROUP BY 1),
pz AS (SELECT *, favourable >= 1 AND confidence >= 0.8 AND samples >= 30 AS passes FROM d)
SELECT strategy, tests, favourable, samples, {r('confidence', 5)} AS confidence, passes, passes AND row_number() OVER (PARTITION BY passes ORDER BY strategy) = 1 AS promoted FROM pz"""))
def promotion_three_tests(spark, sf):
    jk = C.jobson_korkie(_moments(spark, sf))
    a = jk.select("strategy", F.lit("sharpe").alias("test"), ((F.col("sharpe2") > F.col("sharpe1")) & (F.col("jk_p") < 0.5)).alias("favourable"), (1 - F.col("jk_p")).alias("confidence"), "n")
    s = C.simple_tests(_sides(spark, sf))
    b = s.select("strategy", F.lit("drawdown").alias("test"), ((F.col("dd2") < F.col("dd1")) & (F.col("dd_gain") > 0.0001)).alias("favourable"), F.lit(0.9).alias("confidence"), F.lit(0).cast("long").alias("n"))
    c = s.select("strategy", F.lit("calmar").alias("test"), F.col("calmar_promote").alias("favourable"), F.least(F.lit(0.9), F.col("calmar_gain")).alias("confidence"), F.lit(0).cast("long").alias("n"))
    return shaped(C.promotion_decision(a.unionByName(b).unionByName(c), "strategy", F.col("n")), 5)


@query("t06_split_mean_test", sql("ticks", f"""WITH p AS (SELECT symbol, price, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) <= count(*) OVER (PARTITION BY symbol) // 2 AS f FROM ticks),
a AS (SELECT symbol, count(*) FILTER (f) AS n1, count(*) FILTER (NOT f) AS n2, avg(price) FILTER (f) AS m1, avg(price) FILTER (NOT f) AS m2, var_samp(price) FILTER (f) AS v1, var_samp(price) FILTER (NOT f) AS v2 FROM p GROUP BY 1),
b AS (SELECT *, (n1 + n2 - 2)::DOUBLE AS d, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n2)) AS t_stat FROM a), c AS (SELECT *, atan(abs(t_stat) / sqrt(d)) AS th FROM b)
SELECT symbol, n1, n2, {r('t_stat')} AS t_stat, {r(sql_tail('th', 'd'), 5)} AS p_value FROM c"""))
def split_mean_test(spark, sf):
    return shaped(C.split_mean_test(V.ticks(spark, sf), Series(), "price"), columns="symbol n1 n2 t_stat p_value", per={"p_value": 5})


@query("st14_strategy_performance", sql("closed_trades", f"""WITH u AS (SELECT pair, exit_time, trade_id, CASE WHEN account % 3 = 0 THEN account END AS total_trades, CASE WHEN account % 2 = 0 THEN account // 2 END AS winning_trades, CASE WHEN pnl > 0 THEN pnl END AS gross_profit, CASE WHEN pnl < 0 THEN pnl END AS gross_loss FROM closed_trades),
l AS (SELECT pair, max(exit_time) AS updated_at, {", ".join(f"arg_max({m}, (exit_time, trade_id)) FILTER ({m} IS NOT NULL) AS {m}" for m in ("total_trades", "winning_trades", "gross_profit", "gross_loss"))} FROM u GROUP BY 1)
SELECT pair, updated_at, total_trades, winning_trades, {rs('gross_profit gross_loss', 4)}, {r('coalesce(winning_trades / nullif(total_trades, 0), 0)', 5)} AS win_rate, {r('coalesce(gross_profit / nullif(abs(gross_loss), 0), 0)', 5)} AS profit_factor FROM l"""))
def strategy_performance(spark, sf):
    a, p = F.col("account"), F.col("pnl")
    u = V.closed_trades(spark, sf).select("pair", "exit_time", "trade_id", F.when(a % 3 == 0, a).alias("total_trades"), F.when(a % 2 == 0, F.expr("account div 2")).alias("winning_trades"), F.when(p > 0, p).alias("gross_profit"), F.when(p < 0, p).alias("gross_loss"))
    d = C.strategy_performance_updates(u, "pair", ("exit_time", "trade_id"), ["total_trades", "winning_trades", "gross_profit", "gross_loss"])
    return shaped(d, 4, per={"win_rate": 5, "profit_factor": 5})
