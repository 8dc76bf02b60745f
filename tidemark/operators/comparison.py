"""Statistical comparison of challengers with a champion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.distributions import f_p_value, t_p_value
from tidemark.functions.maths import ratio, two_sided_normal_p
from tidemark.operators.joins import tail_positions
from tidemark.plans.series import Series
from tidemark.plans.sizing import broadcast_if_small

LEVEL = 0.05


def _or0(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def paired_moments(returns: DataFrame, champion: str, s: Series, ret: str = "ret") -> DataFrame:
    """Means, population deviations and correlation of each challenger's returns against the champion's,
    aligned from their ends. Only moments leave this step, one row per challenger."""
    key = s.keys[0]
    placed = tail_positions(returns.filter(F.col(ret).isNotNull()), s).select(key, "from_end", ret)
    base = placed.filter(F.col(key) == champion).select("from_end", F.col(ret).alias("_c"))
    both = placed.filter(F.col(key) != champion).withColumnRenamed(ret, "_x").join(broadcast_if_small(base), "from_end")
    return both.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_c").alias("m1"), F.avg("_x").alias("m2"),
        F.stddev_pop("_c").alias("s1"), F.stddev_pop("_x").alias("s2"), F.corr("_c", "_x").alias("rho"),
    )


def jobson_korkie(m: DataFrame) -> DataFrame:
    """Test of equal Sharpe ratios; (0, 1) where a variance or the asymptotic variance vanishes."""
    a, b = _or0(ratio("m1", "s1")), _or0(ratio("m2", "s2"))
    ga, gb = 1 + 0.5 * a * a, 1 + 0.5 * b * b
    var = (ga + gb - 2 * F.col("rho") * F.sqrt(ga * gb)) / F.col("n")
    ok = (F.col("s1") > 0) & (F.col("s2") > 0) & (var > 0)
    z = F.when(ok, (b - a) / F.sqrt(F.when(var > 0, var)))
    d = m.withColumns({"sharpe1": a, "sharpe2": b, "jk_z": _or0(z)})
    d = d.withColumn("jk_p", F.when(ok, two_sided_normal_p("jk_z")).otherwise(1.0))
    return d.withColumn("jk_promote", (F.col("sharpe2") > F.col("sharpe1")) & (F.col("jk_p") < LEVEL))


def welch_ttest(m: DataFrame) -> DataFrame:
    """Unequal-variance t test of the means, with Cohen's d."""
    n = F.col("n")
    v1, v2 = F.pow("s1", F.lit(2)) / (n - 1), F.pow("s2", F.lit(2)) / (n - 1)
    t = ratio(F.col("m2") - F.col("m1"), F.sqrt(v1 + v2))
    df = ratio((v1 + v2) * (v1 + v2) * (n - 1), v1 * v1 + v2 * v2)
    effect = _or0(ratio(F.col("m2") - F.col("m1"), F.sqrt((F.pow("s1", F.lit(2)) + F.pow("s2", F.lit(2))) / 2)))
    d = m.withColumns({"welch_t": t, "welch_df": df, "cohens_d": effect})
    d = d.withColumn("welch_p", t_p_value(F.col("welch_t"), F.col("welch_df")))
    promote = (F.col("m2") > F.col("m1")) & (F.col("welch_p") < LEVEL) & (F.col("cohens_d") > 0.2)
    return d.withColumn("welch_promote", F.coalesce(promote, F.lit(False)))


def variance_f_test(m: DataFrame) -> DataFrame:
    """Two-sided F test of the variances; a smaller deviation by 5 % or more speaks for the challenger."""
    f = F.when(F.col("s2") > 0, F.pow(F.col("s1") / F.when(F.col("s2") > 0, F.col("s2")), F.lit(2)))
    better = F.when((F.col("s1") == 0) & (F.col("s2") == 0), 0.0).when(F.col("s2") == 0, -1.0).otherwise(_or0(ratio(F.col("s1") - F.col("s2"), "s1")))
    d = m.withColumns({"f_stat": f, "stability_gain": better})
    d = d.withColumn("f_p", f_p_value(F.col("f_stat"), F.col("n") - 1, F.col("n") - 1))
    promote = (F.col("s2") < F.col("s1")) & (F.col("f_p") < LEVEL) & (F.col("stability_gain") > 0.05)
    return d.withColumn("f_promote", F.coalesce(promote, F.lit(False)))


def relative_improvement(champion: Column, challenger: Column, lower_is_better: bool = False) -> Column:
    """Improvement relative to the champion, 0 where that is undefined."""
    if lower_is_better:
        return F.when(champion > 0, (champion - challenger) / F.when(champion > 0, champion)).otherwise(0.0)
    return _or0(ratio(challenger - champion, F.abs(champion)))


def simple_tests(df: DataFrame) -> DataFrame:
    """Drawdown, Calmar and small-sample Sharpe comparisons by relative improvement above 10 %.

    Needs dd1, dd2, calmar1, calmar2, sr1, sr2 (1 = champion)."""
    c = F.col
    d = df.withColumns({
        "dd_gain": relative_improvement(c("dd1"), c("dd2"), True), "calmar_gain": relative_improvement(c("calmar1"), c("calmar2")),
        "sharpe_gain": relative_improvement(c("sr1"), c("sr2")),
    })
    return d.withColumns({
        "dd_promote": (c("dd2") < c("dd1")) & (c("dd_gain") > 0.1),
        "calmar_promote": F.coalesce((c("calmar2") > c("calmar1")) & (c("calmar_gain") > 0.1), F.lit(False)),
        "sharpe_promote": F.coalesce((c("sr2") > c("sr1")) & (c("sharpe_gain") > 0.1), F.lit(False)),
    })


# Weight of each favourable test.
TEST_WEIGHTS = {"sharpe": 0.3, "returns": 0.3, "drawdown": 0.2, "calmar": 0.15, "stability": 0.3}


def promotion_tests(moments: DataFrame, sides: DataFrame, key: str) -> DataFrame:
    """The five tests of each challenger as rows for ``promotion_decision``: Sharpe ratio, returns, drawdown, Calmar
    ratio and stability. ``moments`` as of ``paired_moments``, ``sides`` as for ``simple_tests``."""
    none = F.lit(0).cast("long")
    paired = variance_f_test(welch_ttest(jobson_korkie(moments)))
    plain = simple_tests(sides)

    def rows(d: DataFrame, tests: list[tuple[str, str, Column, Column]]) -> DataFrame:
        each = [F.struct(F.lit(name).alias("test"), F.col(ok).alias("favourable"), conf.alias("confidence"), n.alias("n")) for name, ok, conf, n in tests]
        return d.select(key, F.explode(F.array(*each)).alias("t")).select(key, "t.*")

    n = F.col("n")
    a = rows(paired, [("sharpe", "jk_promote", 1 - F.col("jk_p"), n), ("returns", "welch_promote", 1 - F.col("welch_p"), n), ("stability", "f_promote", 1 - F.col("f_p"), n)])
    b = rows(plain, [(t, f"{c}_promote", F.least(F.lit(0.9), F.col(f"{c}_gain")), none) for t, c in (("drawdown", "dd"), ("calmar", "calmar"))])
    return a.unionByName(b)


def promotion_decision(tests: DataFrame, key: str, samples: Column, least_samples: int = 30, least_confidence: float = 0.8) -> DataFrame:
    """Weigh the favourable tests of each challenger; the first that passes (by key) is promoted.

    ``tests``: key, test, favourable, confidence, n. At least half the tests must be favourable."""
    w = None
    for name, value in TEST_WEIGHTS.items():
        w = F.when(F.col("test") == name, value) if w is None else w.when(F.col("test") == name, value)
    w = F.when(F.col("favourable"), w.otherwise(0.05))
    d = tests.groupBy(key).agg(
        F.count(F.lit(1)).alias("tests"), F.count_if("favourable").alias("favourable"), F.max(samples).alias("samples"),
        _or0(ratio(F.sum(w * F.col("confidence")), F.sum(w))).alias("confidence"),
    )
    passes = (
        (F.col("favourable") >= F.greatest(F.lit(1), F.floor(F.col("tests") / 2))) & (F.col("confidence") >= least_confidence)
        & (F.col("samples") >= least_samples)
    )
    d = d.withColumn("passes", passes)
    first = F.row_number().over(Window.partitionBy("passes").orderBy(key))
    return d.withColumn("promoted", F.col("passes") & (first == 1))


def split_mean_test(df: DataFrame, s: Series, value: str) -> DataFrame:
    """Pooled t test of the first against the second half of each series."""
    from tidemark.plans.series import with_position

    totals = df.groupBy(*s.keys).agg(F.count(F.lit(1)).alias("_n"))
    d = with_position(df, s, "_pos").join(broadcast_if_small(totals), list(s.keys))
    first = F.col("_pos") <= F.floor(F.col("_n") / 2)
    x = F.col(value)
    a = d.groupBy(*s.keys).agg(
        F.count(F.when(first, x)).alias("n1"), F.count(F.when(~first, x)).alias("n2"), F.avg(F.when(first, x)).alias("m1"),
        F.avg(F.when(~first, x)).alias("m2"), F.var_samp(F.when(first, x)).alias("v1"), F.var_samp(F.when(~first, x)).alias("v2"),
    )
    n1, n2 = F.col("n1"), F.col("n2")
    pooled = ratio((n1 - 1) * F.col("v1") + (n2 - 1) * F.col("v2"), n1 + n2 - 2)
    a = a.withColumn("t_stat", ratio(F.col("m1") - F.col("m2"), F.sqrt(pooled * (1 / n1 + 1 / n2))))
    return a.withColumn("p_value", t_p_value(F.col("t_stat"), n1 + n2 - 2))


def strategy_performance_updates(updates: DataFrame, key: str, order: tuple[str, ...], metrics: list[str]) -> DataFrame:
    """Latest non-null value of each metric per strategy, then win rate and profit factor from them."""
    at = F.struct(*[F.col(c) for c in order])
    d = updates.groupBy(key).agg(*[F.max_by(m, F.when(F.col(m).isNotNull(), at)).alias(m) for m in metrics], F.max(order[0]).alias("updated_at"))
    return d.withColumns({
        "win_rate": _or0(ratio("winning_trades", "total_trades")),
        "profit_factor": _or0(ratio("gross_profit", F.abs("gross_loss"))),
    })
