"""Performance, trade, regime and monitoring aggregates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.maths import clip, ratio
from tidemark.operators.ranking import latest_per_key, top_per_key
from tidemark.operators.rolling import drawdown
from tidemark.plans.quantiles import exact_percentiles
from tidemark.plans.series import BARS, TICKS, Series, by_key_size, over_rows, running, so_far
from tidemark.plans.sizing import broadcast_if_small, is_small, settled

YEAR_DAYS = 365.25


def _or0(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def performance_metrics(equity: DataFrame, s: Series, value: str = "value", rf: float = 0.02) -> DataFrame:
    """Return, risk and shape measures of each key's value series, one row per key."""
    ts, keys = s.order[0], list(s.keys)
    v = F.col(value)
    path = drawdown(equity, value, s)
    path = over_rows(path, s, lambda d, w: d.withColumn("_p", F.lag(value, 1).over(w)), before=1)
    path = path.withColumn("ret", F.when(F.col("_p") > 0, ratio(v - F.col("_p"), "_p")))
    tails = exact_percentiles(path, keys, "ret", {"p05": 0.05, "p10": 0.10, "p90": 0.90})
    d = path.join(broadcast_if_small(tails), keys, "left")
    x, at = F.col("ret"), F.struct(*[F.col(c) for c in s.order])
    a = d.groupBy(*keys).agg(
        F.min_by(v, at).alias("initial"), F.max_by(v, at).alias("final"), F.max("peak").alias("peak"),
        ((F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / F.lit(86_400e6)).alias("days"),
        F.count(x).alias("n"), F.stddev_pop(x).alias("_sd"), F.stddev_pop(F.when(x < 0, x)).alias("_down"),
        F.max("drawdown").alias("max_drawdown"), F.max("p05").alias("var_95"),
        F.avg(F.when(x <= F.col("p05"), x)).alias("cvar_95"),
        F.skewness(x).alias("_skew"), F.kurtosis(x).alias("_kurt"),
        F.max("p10").alias("_p10"), F.max("p90").alias("_p90"),
    )
    a = a.withColumn("total_return", ratio(F.col("final") - F.col("initial"), "initial"))
    per_year = F.when(F.col("days") > 0, F.col("n") * YEAR_DAYS / F.col("days")).otherwise(YEAR_DAYS)
    grown = F.pow(1 + F.col("total_return"), ratio(F.lit(YEAR_DAYS), "days"))
    a = a.withColumns({
        "annualized_return": F.when((F.col("days") > 0) & (F.col("total_return") > -1), grown - 1),
        "volatility": F.when(F.col("n") > 1, F.col("_sd") * F.sqrt(per_year)),
        "_dvol": F.col("_down") * F.sqrt(per_year),
    })
    excess = F.col("annualized_return") - rf
    live = F.col("volatility") > 0
    return a.select(
        *keys, "initial", "final", "peak", "total_return", "annualized_return", "volatility", "max_drawdown",
        F.when(live, excess / F.col("volatility")).alias("sharpe"),
        F.when(live & (F.col("_dvol") > 0), excess / F.col("_dvol")).alias("sortino"),
        ratio("annualized_return", "max_drawdown").alias("calmar"),
        "var_95", "cvar_95",
        F.when((F.col("n") >= 3) & (F.col("_sd") > 0), F.col("_skew")).otherwise(0.0).alias("skewness"),
        F.when((F.col("n") >= 4) & (F.col("_sd") > 0), F.col("_kurt")).otherwise(0.0).alias("kurtosis"),
        F.abs(ratio("_p90", "_p10")).alias("tail_ratio"),
    )


def trade_statistics(trades: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    p = F.col("pnl")
    win, loss = F.when(p > 0, p), F.when(p < 0, p)
    hours = (F.unix_micros("exit_time") - F.unix_micros("entry_time")) / F.lit(3600e6)
    return trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_trades"), F.count(win).alias("winning_trades"), F.count(loss).alias("losing_trades"),
        ratio(F.count(win), F.count(F.lit(1))).alias("win_rate"), F.avg(win).alias("average_win"), F.avg(loss).alias("average_loss"),
        F.max(win).alias("largest_win"), F.min(loss).alias("largest_loss"),
        ratio(F.sum(win), F.abs(F.sum(loss))).alias("profit_factor"), F.avg(hours).alias("average_hours"),
    )


def trade_summary(trades: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Closed trades of the last ``days``; zeros when there are none. One row."""
    recent = trades.filter((F.col("status") == "CLOSED") & (F.col("exit_time") >= now - F.make_dt_interval(F.lit(days))))
    p = F.col("pnl")
    d = recent.agg(F.count(F.lit(1)).alias("total_trades"), F.count_if(p > 0).alias("winning_trades"),
                   F.sum(p).alias("_s"), F.avg(p).alias("_a"), F.max(p).alias("_x"), F.min(p).alias("_n"))
    return d.select(
        "total_trades", "winning_trades", (F.col("total_trades") - F.col("winning_trades")).alias("losing_trades"),
        _or0(ratio("winning_trades", "total_trades")).alias("win_rate"), _or0(F.col("_s")).alias("total_pnl"),
        _or0(F.col("_a")).alias("average_pnl"), _or0(F.col("_x")).alias("max_win"), _or0(F.col("_n")).alias("max_loss"),
    )


def hourly_trading_metrics(trades: DataFrame, order: tuple[str, ...], unit: str = "hour") -> DataFrame:
    """Per time slice: pnl, Sharpe of trades, drawdown of the in-slice cumulative pnl, win rate."""
    d = trades.select(F.date_trunc(unit, order[0]).alias("slice"), *order, "pnl")
    if not is_small(d):
        return _sliced_metrics(d, order)
    s = Series(("slice",), order)
    d = running(d, s, {"_cum": ("sum", F.col("pnl"))})
    d = running(d, s, {"_top": ("max", F.col("_cum"))})
    p = F.col("pnl")
    return d.groupBy("slice").agg(
        F.sum(p).alias("pnl"), F.count(p).alias("trades"), _or0(ratio(F.avg(p), F.stddev_pop(p))).alias("sharpe"),
        F.abs(F.min(F.col("_cum") - F.col("_top"))).alias("max_drawdown"), ratio(F.count_if(p > 0), F.count(p)).alias("win_rate"),
    )


_NO_SLICE = -(2**62)
_PIECE = "n long, total double, wins long, square double, top double, low double, worst double"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums and cumulative extremes of each slice's rows in each batch; batches come in order."""
    for number, batch in enumerate(batches):
        slices, cell, pnl = batch["_slice"].to_numpy(), batch["_cell"].to_numpy(), batch["pnl"]
        if not len(slices):
            continue
        known = pnl.is_valid().to_numpy(zero_copy_only=False)
        values = pnl.to_numpy(zero_copy_only=False)
        starts = np.r_[0, np.flatnonzero(np.diff(slices)) + 1, len(slices)]
        out = []
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            x = values[a:b][known[a:b]]
            row = {"_slice": int(slices[a]), "_cell": int(cell[a]), "_batch": number, "n": len(x)}
            if len(x):
                cum = np.cumsum(x)
                row |= {"total": float(cum[-1]), "wins": int((x > 0).sum()), "square": float(((x - x.mean()) ** 2).sum()), "top": float(cum.max()),
                        "low": float(cum.min()), "worst": float((cum - np.maximum.accumulate(cum)).min())}
            out.append(row)
        names = ["_slice", "_cell", "_batch", *[f.split()[0] for f in _PIECE.split(", ")]]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), *[pa.float64()] * 4]
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema(list(zip(names, kinds))))


def _sliced_metrics(d: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """The metrics of slices of any length: ranges of the whole order are summed up piece by piece, and the pieces of a slice
    (one per some thousand rows) meet with the sums and the top of those before."""
    parts = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.unix_micros("slice"), F.lit(_NO_SLICE)).alias("_slice")
    ranged = d.repartitionByRange(parts, "slice", *order).sortWithinPartitions("slice", *order)
    pieces = ranged.select(key, F.spark_partition_id().alias("_cell"), "pnl").mapInArrow(_pieces, f"_slice long, _cell int, _batch long, {_PIECE}")
    w = Window.partitionBy("_slice").orderBy("_cell", "_batch")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    d = pieces.withColumn("_from", F.coalesce(F.sum("total").over(before), F.lit(0.0)))
    d = d.withColumn("_top", F.max(F.col("_from") + F.col("top")).over(before))
    d = d.withColumn("_mean", F.sum("total").over(Window.partitionBy("_slice")) / F.sum("n").over(Window.partitionBy("_slice")))
    fall = F.least(F.col("worst"), F.col("_from") + F.col("low") - F.col("_top"))
    off = F.col("total") / F.col("n") - F.col("_mean")
    n, spread = F.sum("n"), F.sum(F.when(F.col("n") > 0, F.col("square") + F.col("n") * off * off))
    out = d.groupBy("_slice").agg(
        F.sum("total").alias("pnl"), n.alias("trades"), _or0(ratio(F.sum("total") / n, F.sqrt(spread / n))).alias("sharpe"),
        F.abs(F.min(fall)).alias("max_drawdown"), ratio(F.sum("wins"), n).alias("win_rate"),
    )
    return out.select(F.when(F.col("_slice") != _NO_SLICE, F.timestamp_micros("_slice")).alias("slice"), "pnl", "trades", "sharpe", "max_drawdown", "win_rate")


def resample(df: DataFrame, keys: Sequence[str], value: str, label: str, ts: str = "ts", tie: str = "seq", unit: str = "day") -> DataFrame:
    """Sum of values and last label per calendar bucket; empty buckets between first and last read 0 and
    a null label."""
    at = F.struct(ts, tie)
    d = df.groupBy(*keys, F.date_trunc(unit, ts).alias("bucket")).agg(F.sum(value).alias("total"), F.max_by(label, at).alias("label"))
    span = d.groupBy(*keys).agg(F.min("bucket").alias("_a"), F.max("bucket").alias("_b"))
    step = F.expr(f"interval 1 {unit}")
    calendar = span.select(*keys, F.explode(F.sequence("_a", "_b", step)).alias("bucket"))
    return calendar.join(d, [*keys, "bucket"], "left").withColumn("total", _or0(F.col("total")))


def recent_performance(trades: DataFrame, start: Column, end: Column, s: Series) -> DataFrame:
    """Mean and deviation of pnl, win rate, lowest cumulative pnl and Sharpe inside a time range. One row."""
    d = trades.filter((F.col("exit_time") >= start) & (F.col("exit_time") <= end))
    d = running(d.withColumn("_one", F.lit(0)), Series(("_one",), s.order), {"cumulative": ("sum", F.col("pnl"))})
    a = d.agg(F.avg("pnl").alias("avg_return"), F.stddev_samp("pnl").alias("_sd"),
              (F.count_if(F.col("pnl") > 0) / F.count(F.lit(1))).alias("win_rate"), F.abs(F.min("cumulative")).alias("max_drawdown"))
    return a.select("avg_return", "win_rate", "max_drawdown", F.when(F.col("_sd") > 0, F.col("avg_return") / F.col("_sd")).otherwise(0.0).alias("sharpe"))


def regime_statistics(df: DataFrame, regime: str = "regime", confidence: str = "confidence") -> DataFrame:
    c = F.col(confidence)
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    d = df.groupBy(regime).agg(F.count(F.lit(1)).alias("count"), F.avg(c).alias("mean"), F.min(c).alias("min"),
                               F.max(c).alias("max"), F.stddev_pop(c).alias("std"))
    return d.crossJoin(F.broadcast(total)).withColumn("percent", 100.0 * F.col("count") / F.col("_n")).drop("_n")


def current_regime(df: DataFrame, s: Series = TICKS, regime: str = "regime") -> DataFrame:
    return df.groupBy(*s.keys).agg(F.max_by(regime, F.struct(*[F.col(c) for c in s.order])).alias("current"))


def transition_matrix(df: DataFrame, label: str, s: Series = TICKS) -> DataFrame:
    """From/to counts of successive labels of a key and their share of the from row."""
    d = over_rows(df, s, lambda x, w: x.withColumn("from", F.lag(label, 1).over(w)), before=1)
    c = d.filter(F.col("from").isNotNull()).groupBy("from", F.col(label).alias("to")).agg(F.count(F.lit(1)).alias("count"))
    return c.withColumn("probability", F.col("count") / F.sum("count").over(Window.partitionBy("from")))


def regime_durations(df: DataFrame, label: str, s: Series = TICKS) -> DataFrame:
    """Hours of the completed spells of each label: mean, median, population deviation, extremes."""
    spells = by_key_size(df.select(*dict.fromkeys([*s.keys, *s.order, label])), s, lambda d, own: _spells(d, label, own))
    if not is_small(spells):
        spells = settled(spells)  # the moments and the percentiles read it
    h = F.col("hours")
    a = spells.groupBy(label).agg(F.count(h).alias("spells"), F.avg(h).alias("mean"), F.stddev_pop(h).alias("std"), F.min(h).alias("min"), F.max(h).alias("max"))
    return a.join(broadcast_if_small(exact_percentiles(spells, [label], "hours", {"median": 0.5})), label)


def _spells(df: DataFrame, label: str, s: Series) -> DataFrame:
    ts = s.order[0]
    d = over_rows(df, s, lambda x, w: x.withColumn("_prev", F.lag(label, 1).over(w)), before=1)
    starts = d.filter(F.col("_prev").isNull() | (F.col("_prev") != F.col(label)))
    spells = over_rows(starts, s, lambda x, w: x.withColumn("_next", F.lead(ts, 1).over(w)), after=1).filter(F.col("_next").isNotNull())
    return spells.select(label, ((F.unix_micros("_next") - F.unix_micros(ts)) / F.lit(3600e6)).alias("hours"))


def alert_counts(alerts: DataFrame, ts: str = "ts") -> DataFrame:
    """Counts by type, by severity and in total, with the rate per day over the whole period."""
    sets = alerts.groupingSets([["alert_type"], ["severity"], []], "alert_type", "severity")
    counts = sets.agg(F.count(F.lit(1)).alias("count"), F.count_if(F.col("severity") == "critical").alias("critical"))
    days = alerts.agg(((F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / F.lit(86_400e6)).alias("_d"))
    return counts.crossJoin(F.broadcast(days)).withColumn("per_day", ratio("count", "_d")).drop("_d")


def best_worst(df: DataFrame, label: str, score: str) -> DataFrame:
    at = F.struct(F.col(score), F.col(label))
    return df.agg(F.max_by(label, at).alias("best"), F.max(score).alias("best_score"),
                  F.min_by(label, at).alias("worst"), F.min(score).alias("worst_score"))


def exchange_flow_totals(flows: DataFrame, exchanges: Sequence[str], on: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """Totals over exchanges per time with each exchange's net flow kept; ratio recomputed from totals."""
    aggs = [F.sum("inflow").alias("inflow"), F.sum("outflow").alias("outflow")]
    aggs += [F.sum(F.when(F.col("exchange") == e, F.col("outflow") - F.col("inflow"))).alias(f"net_{e}") for e in exchanges]
    d = flows.groupBy(*on).agg(*aggs)
    return d.withColumns({"net_flow": F.col("outflow") - F.col("inflow"), "ratio": F.when(F.col("outflow") > 0, ratio("inflow", "outflow")).otherwise(0.0)})


def series_statistics(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, population deviation, extremes, median, and the unbiased sample skewness and kurtosis."""
    x = F.col(value)
    a = df.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"),
                              F.max(x).alias("max"), F.skewness(x).alias("_g1"), F.kurtosis(x).alias("_g2"))
    n = F.col("n").cast("double")
    a = a.withColumns({
        "skewness": F.when(n > 2, F.col("_g1") * F.sqrt(n * (n - 1)) / (n - 2)),
        "kurtosis": F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("_g2") + 6)),
    }).drop("_g1", "_g2")
    return a.join(broadcast_if_small(exact_percentiles(df, keys, value, {"median": 0.5})), list(keys))


def correlation_matrix(df: DataFrame, value: str = "close", ts: str = "ts", least: int = 5, group: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of every pair of symbols over common times (a < b), 0 where undefined.

    The pair sums are aggregated map-side as the join streams; only one row per pair is shuffled on.
    """
    keys = [*group, ts]
    a = df.select(*keys, F.col("symbol").alias("a"), F.col(value).alias("_x"))
    b = df.select(*keys, F.col("symbol").alias("b"), F.col(value).alias("_y"))
    pairs = a.join(b, keys).filter(F.col("a") < F.col("b"))
    d = pairs.groupBy(*group, "a", "b").agg(F.count(F.lit(1)).alias("n"), ratio(F.covar_pop("_x", "_y"), F.stddev_pop("_x") * F.stddev_pop("_y")).alias("_c"))
    return d.filter(F.col("n") >= least).withColumn("corr", F.coalesce(F.nanvl("_c", F.lit(0.0)), F.lit(0.0))).drop("_c")


def cv_aggregate(results: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Per metric over the splits: mean, sample deviation, extremes, upper median and count."""
    long = results.unpivot(["split_id"], list(metrics), "metric", "value").filter("value is not null and not isnan(value)")
    x = F.col("value")
    ranked = F.array_sort(F.collect_list(x))
    return long.groupBy("metric").agg(
        F.avg(x).alias("mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.element_at(ranked, F.floor(F.count(x) / 2).cast("int") + 1).alias("median"), F.count(x).alias("count"),
    )


def cv_consistency(results: DataFrame) -> DataFrame:
    """Success rate, and consistency of returns and Sharpe ratios over the splits. One row."""
    ret, sh = F.col("total_return"), F.when(F.col("sharpe") != 0, F.col("sharpe"))
    return results.agg(
        F.count(F.lit(1)).alias("splits"), ratio(F.count(ret), F.count(F.lit(1))).alias("success_rate"),
        (1 - ratio(F.stddev_samp(ret), F.abs(F.avg(ret)))).alias("return_consistency"),
        ratio(F.count_if(ret > 0), F.count(ret)).alias("positive_rate"),
        (1 - ratio(F.stddev_samp(sh), F.abs(F.avg(sh)))).alias("sharpe_consistency"),
    )


def kelly_fraction(trades: DataFrame, s: Series, ret: str = "ret", lookback: int = 100, least: int = 20) -> DataFrame:
    """Kelly fraction from each key's last returns, with a reason where it is 0 by rule."""
    counts = trades.groupBy(*s.keys).agg(F.count(F.lit(1)).alias("total"))
    x = F.col(ret)
    a = latest_per_key(trades, s, lookback).groupBy(*s.keys).agg(
        F.count(F.lit(1)).alias("used"), F.avg(F.when(x > 0, x)).alias("avg_win"), F.abs(F.avg(F.when(x < 0, x))).alias("avg_loss"),
        (F.count_if(x > 0) / F.count(F.lit(1))).alias("win_rate"),
    ).join(broadcast_if_small(counts), list(s.keys))
    b, p = ratio("avg_win", "avg_loss"), F.col("win_rate")
    reason = (
        F.when(F.col("total") < least, "insufficient_trades")
        .when(F.col("avg_win").isNull() | F.col("avg_loss").isNull(), "no_wins_or_losses").otherwise("ok")
    )
    raw = F.greatest(F.lit(0.0), ratio(b * p - (1 - p), b))
    return a.withColumn("reason", reason).withColumn("kelly", F.when(F.col("reason") == "ok", raw).otherwise(0.0))


def kelly_position_size(df: DataFrame, portfolio: str, share: float = 0.25, cap: float = 0.1) -> DataFrame:
    by_kelly, by_cap = F.col(portfolio) * F.col("kelly") * share, F.col(portfolio) * cap
    return df.withColumns({
        "size": F.when(F.col("kelly") > 0, F.least(by_kelly, by_cap)).otherwise(0.0),
        "limited_by": F.when(F.col("kelly") <= 0, "none").when(by_kelly <= by_cap, "kelly").otherwise("max_position"),
    })


def portfolio_performance(daily: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Daily return statistics, annualised over 252 days, from daily pnl rows."""
    x = F.when(F.col("start_value") > 0, (F.col("end_value") - F.col("start_value")) / F.col("start_value"))
    a = daily.groupBy(*keys).agg(F.avg(x).alias("avg_daily"), F.stddev_pop(x).alias("daily_volatility"))
    sharpe = _or0(F.when(F.col("daily_volatility") > 0, F.col("avg_daily") / F.col("daily_volatility")))
    return a.withColumns({
        "sharpe": sharpe, "annual_return": F.col("avg_daily") * 252,
        "annual_volatility": F.col("daily_volatility") * 252**0.5, "annual_sharpe": sharpe * 252**0.5,
    })


def signal_statistics(signals: DataFrame, keys: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """Counts by signal type, mean positive confidence, last time and spread statistics."""
    c = F.when(F.col("confidence") > 0, F.col("confidence"))
    aggs = [F.count_if(F.col("signal") == k).alias(f"n_{k}") for k in kinds]
    return signals.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), *aggs, F.avg(c).alias("mean_confidence"), F.max("ts").alias("last_ts"),
        F.avg("spread").alias("spread_mean"), F.stddev_samp("spread").alias("spread_std"),
        F.min("spread").alias("spread_min"), F.max("spread").alias("spread_max"),
    )


def anomaly_statistics(anomalies: DataFrame, cycle: Column) -> DataFrame:
    """Detection cycles, anomalies per cycle, counts by severity and the false-positive rate, by type."""
    d = anomalies.withColumn("_cycle", cycle)
    return d.groupBy("anomaly_type").agg(
        F.countDistinct("_cycle").alias("cycles"), F.count(F.lit(1)).alias("anomalies"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in ("low", "medium", "high", "critical")],
        (F.count_if(F.col("false_positive")) / F.count(F.lit(1))).alias("false_positive_rate"),
    ).withColumn("per_cycle", ratio("anomalies", "cycles"))


def context_summary(df: DataFrame, s: Series, value: str) -> DataFrame:
    """Trend label (declining when the last value is below the first), totals and peak per key."""
    at = F.struct(*[F.col(c) for c in s.order])
    first, last = F.min_by(value, at), F.max_by(value, at)
    return df.groupBy(*s.keys).agg(
        F.count(F.lit(1)).alias("points"), F.when((F.count(F.lit(1)) > 1) & (last < first), "declining").otherwise("stable").alias("trend"),
        F.avg(value).alias("mean"), F.max(value).alias("peak"), F.sum(value).alias("total"), last.alias("latest"),
    )


def trade_counters(trades: DataFrame) -> DataFrame:
    result = F.when(F.col("pnl") > 0, "win").when(F.col("pnl") < 0, "loss").otherwise("breakeven")
    return trades.groupBy("pair", "side", result.alias("result")).agg(
        F.count(F.lit(1)).alias("trades"), F.sum(F.abs("notional")).alias("volume"), F.sum("fee").alias("fees"))


def latency_quantiles(df: DataFrame, service: str, value: str, width: str = "5 minutes", ts: str = "ts") -> DataFrame:
    d = df.withColumn("window_start", F.window(ts, width).start)
    return exact_percentiles(d, [service, "window_start"], value, {"p50": 0.5, "p95": 0.95})


def counter_increase(df: DataFrame, s: Series, value: str, width: str) -> DataFrame:
    """Growth of a counter per window, reading any fall as a restart from zero; and the rate per second."""
    x = F.col(value)
    d = over_rows(df, s, lambda t, w: t.withColumn("_p", F.lag(x, 1).over(w)), before=1)
    grown = F.when(F.col("_p").isNull(), 0.0).when(x < F.col("_p"), x).otherwise(x - F.col("_p"))
    win = F.window(s.order[0], width)
    out = d.groupBy(*s.keys, win.alias("_w")).agg(F.sum(grown).alias("increase"))
    seconds = (F.unix_micros(F.col("_w.end")) - F.unix_micros(F.col("_w.start"))) / F.lit(1e6)
    return out.withColumns({"window_start": F.col("_w.start"), "rate": F.col("increase") / seconds}).drop("_w")


def position_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("symbol", "side").agg(F.sum("quantity").alias("quantity"), F.sum(F.col("quantity") * F.col("price")).alias("notional"))


def pair_cooccurrence(clusters: DataFrame, n: int = 10) -> DataFrame:
    """The n symbol pairs that most often share a cluster. Input: window_id, label, symbol (distinct)."""
    a = clusters.select("window_id", "label", F.col("symbol").alias("a"))
    b = clusters.select("window_id", "label", F.col("symbol").alias("b"))
    counts = a.join(b, ["window_id", "label"]).filter(F.col("a") < F.col("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("together"))
    return counts.orderBy(F.col("together").desc(), "a", "b").limit(n)


def cluster_evaluation(clusters: DataFrame, quality: DataFrame, opportunities: DataFrame, universe: DataFrame) -> DataFrame:
    """Mean quality per window, coverage of the universe and opportunities per window. One row."""
    q = quality.agg(F.avg("silhouette").alias("silhouette"), F.avg("stability").alias("stability"), F.var_pop("stability").alias("stability_variance"),
                    F.avg("clusters").alias("clusters"), F.count(F.lit(1)).alias("windows"))
    c = clusters.agg(F.countDistinct("symbol").alias("_covered"))
    u = universe.agg(F.countDistinct("symbol").alias("_all"))
    o = opportunities.agg(F.count(F.lit(1)).alias("opportunities"), F.avg("expected_return").alias("expected_return"))
    d = q.crossJoin(c).crossJoin(u).crossJoin(o)
    return d.withColumns({"coverage": ratio("_covered", "_all"), "per_window": ratio("opportunities", "windows")}).drop("_covered", "_all")


def classification_quality(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1, from the confusion counts. One row."""
    conf = df.groupBy(F.col(label).alias("l"), F.col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    truth = conf.groupBy(F.col("l").alias("c")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"))
    seen = conf.groupBy(F.col("p").alias("c")).agg(F.sum("n").alias("predicted"))
    d = truth.join(seen, "c", "left")
    d = d.withColumns({"prec": _or0(ratio("tp", "predicted")), "rec": ratio("tp", "support")})
    d = d.withColumn("f1", _or0(ratio(2 * F.col("prec") * F.col("rec"), F.col("prec") + F.col("rec"))))
    total = F.sum("support")
    return d.agg((F.sum("tp") / total).alias("accuracy"), *[
        (F.sum(F.col(c) * F.col("support")) / total).alias(n) for c, n in (("prec", "precision"), ("rec", "recall"), ("f1", "f1"))])


def regression_quality(df: DataFrame, label: str, prediction: str) -> DataFrame:
    e = F.col(label) - F.col(prediction)
    return df.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
                  (1 - ratio(F.sum(e * e), F.var_pop(label) * F.count(label))).alias("r2"))


def cv_coverage(rows: DataFrame, key: str = "row_id") -> DataFrame:
    """Share of rows used for training, for testing, by either and by both. Input: one row per use."""
    per = rows.groupBy(key).agg(F.bool_or(F.col("role") == "train").alias("tr"), F.bool_or(F.col("role") == "test").alias("te"))
    pct = lambda c: (100.0 * F.count_if(c) / F.count(F.lit(1)))
    return per.agg(pct(F.col("tr")).alias("train"), pct(F.col("te")).alias("test"), pct(F.col("tr") | F.col("te")).alias("either"), pct(F.col("tr") & F.col("te")).alias("both"))


def service_health(beats: DataFrame, now: Column, max_age_s: float = 60.0, service: str = "service", s: Series = TICKS) -> DataFrame:
    """Last heartbeat of each service, its age and whether it is fresh."""
    ts = s.order[0]
    d = beats.groupBy(service).agg(F.max_by("status", F.struct(*[F.col(c) for c in s.order])).alias("status"), F.max(ts).alias("last_seen"))
    age = (F.unix_micros(now) - F.unix_micros("last_seen")) / F.lit(1e6)
    return d.withColumn("age_s", age).withColumn("healthy", age <= max_age_s)
