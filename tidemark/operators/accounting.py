"""Positions, realised and unrealised pnl, portfolio value."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.maths import ratio
from tidemark.plans.scans import affine_scan
from tidemark.plans.series import TICKS, Series, by_key_size, over_rows, running
from tidemark.plans.sizing import broadcast_if_small

FLAT = 1e-8


def signed_quantity() -> F.Column:
    return F.when(F.col("side") == "buy", F.col("quantity")).otherwise(-F.col("quantity"))


def average_cost_positions(fills: DataFrame, s: Series = TICKS) -> DataFrame:
    """Quantity, average cost and realised pnl after each fill.

    The quantity is a running sum. Given it, the average cost is a linear recursion: adding blends the
    price in, reducing keeps the cost, opening or flipping restarts at the fill price.
    """
    return by_key_size(fills, s, _average_cost_positions)


def _average_cost_positions(fills: DataFrame, s: Series) -> DataFrame:
    d = running(fills.withColumn("_q", signed_quantity()), s, {"position": ("sum", F.col("_q"))})
    before = F.col("position") - F.col("_q")
    opened = F.abs(before) < FLAT
    adding = F.signum(before) == F.signum("_q")
    closing = ~opened & ~adding & (F.abs("_q") >= F.abs(before))
    flat = F.abs("position") < FLAT
    restart = opened | closing
    m = F.when(restart, 0.0).when(adding, F.abs(before) / F.abs("position")).otherwise(1.0)
    b = (
        F.when(closing & flat, 0.0).when(restart, F.col("price"))
        .when(adding, F.col("price") * F.abs("_q") / F.abs("position")).otherwise(0.0)
    )
    d = affine_scan(d.withColumns({"_m": m, "_b": b}), s, "_m", "_b", "average_cost")

    def build(x: DataFrame, w) -> DataFrame:
        return x.withColumn("_cost", F.coalesce(F.lag("average_cost", 1).over(w), F.lit(0.0)))

    d = over_rows(d, s, build, before=1)
    closed = F.when(opened | adding, 0.0).otherwise(F.least(F.abs("_q"), F.abs(before)) * F.signum(before))
    d = d.withColumn("realized", (F.col("price") - F.col("_cost")) * closed)
    d = running(d, s, {"realized_total": ("sum", F.col("realized"))})
    return d.withColumn(
        "unrealized", F.when(flat, 0.0).otherwise((F.col("price") - F.col("average_cost")) * F.col("position"))
    ).drop("_q", "_m", "_b", "_cost")


def portfolio_value(fills: DataFrame, s: Series = TICKS, capital: float = 1_000_000.0) -> DataFrame:
    """Cash, value, return and peak of each key's account, marked at the fill price: running sums only."""
    return by_key_size(fills, s, lambda d, own: _portfolio_value(d, own, capital))


def _portfolio_value(fills: DataFrame, s: Series, capital: float) -> DataFrame:
    q = signed_quantity()
    d = running(fills, s, {"position": ("sum", q), "_flow": ("sum", -q * F.col("price") - F.col("fee"))})
    d = d.withColumn("cash", F.lit(capital) + F.col("_flow")).drop("_flow")
    d = d.withColumn("value", F.col("cash") + F.col("position") * F.col("price"))
    d = over_rows(d, s, lambda x, w: x.withColumn("_p", F.lag("value", 1).over(w)), before=1)
    d = d.withColumn("return", F.when(F.col("_p") > 0, ratio(F.col("value") - F.col("_p"), "_p"))).drop("_p")
    return running(d, s, {"peak": ("max", F.col("value"))})


def daily_pnl(positions: DataFrame, s: Series = TICKS, capital: float = 1_000_000.0) -> DataFrame:
    """Per key and day from ``average_cost_positions``: realised, unrealised at the close, fees, start
    value, high and low water and the largest drawdown inside the day."""
    return by_key_size(positions, s, lambda d, own: _daily_pnl(d, own, capital))


def _daily_pnl(positions: DataFrame, s: Series, capital: float) -> DataFrame:
    positions = positions.select(*s.keys, *s.order, "fee", "realized", "realized_total", "unrealized")
    day = F.to_date(s.order[0])
    at = F.struct(*[F.col(c) for c in s.order])
    d = running(positions, s, {"_fees": ("sum", F.col("fee"))})
    value = F.lit(capital) + F.col("realized_total") + F.col("unrealized") - F.col("_fees")
    d = d.withColumns({"day": day, "value": value})
    inside = replace(s, keys=(*s.keys, "day"))
    d = running(d, inside, {"_high": ("max", F.col("value"))})
    d = d.withColumn("_dd", ratio(F.col("_high") - F.col("value"), "_high"))
    out = d.groupBy(*s.keys, "day").agg(
        F.sum("realized").alias("realized"), F.max_by("unrealized", at).alias("unrealized"), F.sum("fee").alias("fees"),
        F.max("value").alias("high_water"), F.min("value").alias("low_water"), F.max("_dd").alias("max_drawdown"),
        F.max_by("value", at).alias("end_value"),
    )
    w = Window.partitionBy(*s.keys).orderBy("day")
    return out.withColumn("start_value", F.coalesce(F.lag("end_value", 1).over(w), F.lit(capital)))


def exposures(positions: DataFrame, account: str, value: str = "market_value") -> DataFrame:
    """Net, gross and notional exposure, active count and largest concentration per account."""
    v = F.col(value)
    total = F.sum(v)
    return positions.groupBy(account).agg(
        total.alias("net"), F.sum(F.abs(v)).alias("gross"), F.count_if(F.abs(v) > FLAT).alias("active"),
        F.max(F.abs(v)).alias("largest"), F.max_by("symbol", F.struct(F.abs(v), F.col("symbol"))).alias("largest_symbol"),
    ).withColumn("concentration", ratio("largest", "gross"))


def last_positions(fills: DataFrame, s: Series = TICKS) -> DataFrame:
    """Closing quantity and last price per key."""
    at = F.struct(*[F.col(c) for c in s.order])
    return fills.groupBy(*s.keys).agg(F.sum(signed_quantity()).alias("position"), F.max_by("price", at).alias("last_price"))


def excursions_update(trades: DataFrame, marks: DataFrame, key: str = "trade_id") -> DataFrame:
    """Raise the stored favourable and adverse excursions of open trades by new marks."""
    fresh = marks.groupBy(key).agg(F.max("pnl").alias("_up"), F.min("pnl").alias("_down"))
    d = trades.join(broadcast_if_small(fresh), key, "left")
    return d.withColumns({
        "mfe": F.greatest(F.col("mfe"), F.coalesce(F.col("_up"), F.lit(0.0))),
        "mae": F.greatest(F.col("mae"), F.coalesce(-F.col("_down"), F.lit(0.0))),
    }).drop("_up", "_down")
