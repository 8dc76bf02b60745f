"""As-of, interval, alignment and lookup joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.maths import ratio
from tidemark.functions.rules import five_way
from tidemark.plans.series import BARS, TICKS, Series, asof, over_rows, rows_before, running, with_position
from tidemark.plans.sizing import broadcast_if_small

DAY_S = 86_400


def asof_join(left, right, by: Sequence[str], take: Mapping[str, str], tolerance_s: float | None = None, **kw) -> DataFrame:
    """Backward as-of join: latest right row at or before each left row, within the tolerance."""
    return asof(left, right, tuple(by), take, tolerance_s=tolerance_s, **kw)


def nearest_join(left: DataFrame, right: DataFrame, by: Sequence[str], take: Mapping[str, str], ts: str = "ts", tie: str = "seq") -> DataFrame:
    """Closest right row in time on either side; a tie goes to the later one."""
    names = list(take.values())
    back = {c: f"_b_{n}" for c, n in take.items()}
    fore = {c: f"_f_{n}" for c, n in take.items()}
    d = asof(left, right, tuple(by), back, ts, tie, right_ts="_b_ts")
    d = asof(d, right, tuple(by), fore, ts, tie, right_ts="_f_ts", forward=True)
    at = F.unix_micros(ts)
    later = F.col("_b_ts").isNull() | (F.unix_micros("_f_ts") - at <= at - F.unix_micros("_b_ts"))
    picked = {n: F.when(later, F.col(f"_f_{n}")).otherwise(F.col(f"_b_{n}")) for n in names}
    picked["nearest_ts"] = F.when(later, F.col("_f_ts")).otherwise(F.col("_b_ts"))
    return d.withColumns(picked).drop("_b_ts", "_f_ts", *back.values(), *fore.values())


def return_labels(features: DataFrame, prices: DataFrame, days: int = 1, value: str = "close", s: Series = BARS) -> DataFrame:
    """Label each feature row by the return from its nearest price to the nearest one ``days`` later."""
    px = prices.select(*s.keys, "ts", F.col(value).alias("_px"), F.lit(0).alias("seq"))
    base = features.select(*s.keys, "ts").withColumn("seq", F.lit(0))
    now = nearest_join(base, px, s.keys, {"_px": "current"}).drop("nearest_ts")
    ahead = now.withColumnRenamed("ts", "_now").withColumn("ts", F.col("_now") + F.make_dt_interval(F.lit(days)))
    full = nearest_join(ahead, px, s.keys, {"_px": "future"}).drop("nearest_ts", "ts").withColumnRenamed("_now", "ts")
    return full.withColumn("label", five_way(ratio(F.col("future") - F.col("current"), "current"), 0.005, 0.02)).drop("seq")


def pair_prices(ticks: DataFrame, pairs: DataFrame, max_age_s: float = 10.0) -> DataFrame:
    """At every tick of either leg, the latest price of both legs, each no older than ``max_age_s``.

    ``pairs`` has pair_id, a, b. A symbol in several pairs is copied once per pair; one scan by pair follows.
    """
    legs = pairs.select("pair_id", F.explode(F.array(
        F.struct(F.col("a").alias("symbol"), F.lit("a").alias("leg")), F.struct(F.col("b").alias("symbol"), F.lit("b").alias("leg"))
    )).alias("l")).select("pair_id", "l.*")
    d = ticks.join(broadcast_if_small(legs), "symbol")
    hit = F.struct("price", "ts")
    s = Series(("pair_id",))
    d = running(d, s, {"_a": ("last", F.when(F.col("leg") == "a", hit)), "_b": ("last", F.when(F.col("leg") == "b", hit))})
    now = F.unix_micros("ts")
    fresh = lambda c: (now - F.unix_micros(f"{c}.ts")) <= max_age_s * 1e6
    return (
        d.filter(fresh("_a") & fresh("_b") & (F.col("_b.price") != 0))
        .select("pair_id", "ts", "seq", F.col("_a.price").alias("price_a"), F.col("_b.price").alias("price_b"),
                (F.col("_a.price") / F.col("_b.price")).alias("price_ratio"))
    )


def latest_of_streams(streams: Mapping[str, DataFrame], value: str, s: Series = TICKS, ttl_s: float = 30.0) -> DataFrame:
    """At every row of any stream, the latest value of each stream of the same key, all within the TTL."""
    union = None
    for name, df in streams.items():
        part = df.select(*s.keys, *s.order, F.col(value).alias("_v"), F.lit(name).alias("_stream"))
        union = part if union is None else union.unionByName(part)
    ts = s.order[0]
    specs = {f"_{n}": ("last", F.when(F.col("_stream") == n, F.struct(F.col("_v"), F.col(ts).alias("at")))) for n in streams}
    d = running(union, s, specs)
    fresh = None
    for n in streams:
        ok = (F.unix_micros(ts) - F.unix_micros(f"_{n}.at")) <= ttl_s * 1e6
        fresh = ok if fresh is None else fresh & ok
    return d.filter(fresh).select(*s.keys, *s.order, *[F.col(f"_{n}._v").alias(n) for n in streams])


def flows_inner(inflow: DataFrame, outflow: DataFrame, on: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """Inflow and outflow at common times; net = out - in, ratio in/out with 0 where nothing flows out."""
    d = inflow.select(*on, F.col("value").alias("inflow")).join(outflow.select(*on, F.col("value").alias("outflow")), list(on))
    return d.withColumns({
        "net_flow": F.col("outflow") - F.col("inflow"),
        "inflow_outflow_ratio": F.when(F.col("outflow") > 0, ratio("inflow", "outflow")).otherwise(0.0),
    })


def whales_left(transactions: DataFrame, volume: DataFrame, on: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    d = transactions.select(*on, F.col("value").alias("whale_count"))
    v = volume.select(*on, F.col("value").alias("whale_volume"))
    return d.join(v, list(on), "left").withColumn("whale_volume", F.coalesce("whale_volume", F.lit(0.0)))


def health_left(addresses, transactions, hash_rate, fees, on: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """Network health per time of the address series; missing transactions and fees count as 0."""
    named = {"tx_count": transactions, "hash_rate": hash_rate, "fee": fees}
    d = addresses.select(*on, F.col("value").alias("addresses"))
    for name, df in named.items():
        d = d.join(df.select(*on, F.col("value").alias(name)), list(on), "left")
    d = d.withColumns({"tx_count": F.coalesce("tx_count", F.lit(0.0)), "fee": F.coalesce("fee", F.lit(0.0))})
    score = (
        0.5 * F.least(F.lit(1.0), F.col("addresses") / 1e6)
        + 0.3 * F.when(F.col("tx_count") > 0, F.least(F.lit(1.0), F.col("tx_count") / 3e5)).otherwise(0.0)
        + F.when(F.coalesce("hash_rate", F.lit(0.0)) != 0, 0.2).otherwise(0.0)
    )
    return d.withColumn("health_score", F.least(F.lit(1.0), score))


def metrics_full_outer(*sides: DataFrame, on: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """Rows for every time seen on any side; absent sides read null."""
    out = sides[0]
    for side in sides[1:]:
        out = out.join(side, list(on), "full_outer")
    return out


def align_symbols(df: DataFrame, s: Series = BARS) -> DataFrame:
    """Keep the times at which every symbol has a row. One row per (key, time) is assumed."""
    ts = s.order[0]
    total = df.agg(F.countDistinct(*s.keys).alias("_all"))
    complete = df.groupBy(ts).agg(F.count(F.lit(1)).alias("_n")).crossJoin(F.broadcast(total)).filter("_n = _all")
    return df.join(complete.select(ts), ts, "left_semi")


def outer_series(df: DataFrame, names: Sequence[str], series: str = "series", value: str = "value", ts: str = "ts") -> DataFrame:
    """One column per named series, outer-joined on time. Names are given, so no scan to find them."""
    return df.groupBy(ts).pivot(series, list(names)).agg(F.first(value))


def symbol_pairs(df: DataFrame, group: str, symbol: str = "symbol") -> DataFrame:
    """All symbol pairs a < b seen in a group. The group's member list is a set of names: rows are
    reduced to distinct members before they meet."""
    members = df.select(group, symbol).distinct()
    a, b = members.withColumnRenamed(symbol, "a"), members.withColumnRenamed(symbol, "b")
    return a.join(b, group).filter(F.col("a") < F.col("b"))


def trade_order_link(links: DataFrame, trades: DataFrame, orders: DataFrame) -> DataFrame:
    """Bridge rows (trade_id, order_id, role) whose trade and order both exist."""
    return links.join(trades.select("trade_id"), "trade_id", "left_semi").join(orders.select("order_id"), "order_id", "left_semi")


def unlinked(links: DataFrame, trades: DataFrame, orders: DataFrame) -> DataFrame:
    """Bridge rows that miss their trade or their order, with the reason."""
    no_trade = links.join(trades.select("trade_id"), "trade_id", "left_anti").withColumn("missing", F.lit("trade"))
    no_order = links.join(orders.select("order_id"), "order_id", "left_anti").withColumn("missing", F.lit("order"))
    return no_trade.unionByName(no_order)


def _with_buckets(intervals: DataFrame, start: str, end: str, width_s: int) -> DataFrame:
    first, last = (F.floor(F.unix_micros(F.col(c)) / F.lit(width_s * 1_000_000)) for c in (start, end))
    return intervals.withColumn("_bucket", F.explode(F.sequence(first.cast("long"), last.cast("long"))))


def interval_join(df: DataFrame, intervals: DataFrame, ts: str = "ts", start: str = "start", end: str = "end",
                  width_s: int = 7 * DAY_S, how: str = "inner", extra: Sequence[str] = ()) -> DataFrame:
    """Rows inside [start, end] of each interval: equi-join on time buckets, then the exact bounds, so no
    nested loop. ``how`` is inner or left_semi."""
    bucket = F.floor(F.unix_micros(F.col(ts)) / F.lit(width_s * 1_000_000)).cast("long")
    left = df.withColumn("_bucket", bucket)
    right = broadcast_if_small(_with_buckets(intervals, start, end, width_s))
    cond = (left["_bucket"] == right["_bucket"]) & (left[ts] >= right[start]) & (left[ts] <= right[end])
    for c in extra:
        cond = cond & (left[c] == right[c])
    joined = left.join(right, cond, how)
    if how == "left_semi":
        return joined.drop("_bucket")
    out = joined.drop(left["_bucket"]).drop(right["_bucket"])
    for c in extra:
        out = out.drop(right[c])
    return out


def period_membership(df: DataFrame, intervals: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows that lie in any of the intervals."""
    return interval_join(df, intervals, ts, how="left_semi")


def tail_positions(df: DataFrame, s: Series, name: str = "from_end") -> DataFrame:
    """1 for the last row of a key, 2 for the one before, and so on."""
    totals = df.groupBy(*s.keys).agg(F.count(F.lit(1)).alias("_n"))
    placed = with_position(df, s, "_pos").join(broadcast_if_small(totals), list(s.keys))
    return placed.withColumn(name, F.col("_n") - F.col("_pos") + 1).drop("_n", "_pos")


def tail_align(a: DataFrame, b: DataFrame, s: Series, value: str = "value", names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Pair two series from their ends: last with last, and so on, over the shorter length."""
    left = tail_positions(a, s).select(*s.keys, "from_end", F.col(value).alias(names[0]))
    right = tail_positions(b, s).select(*s.keys, "from_end", F.col(value).alias(names[1]))
    return left.join(right, [*s.keys, "from_end"])


def benchmark_corr(df: DataFrame, benchmark: DataFrame, value: str = "close", n: int = 50, least: int = 10, s: Series = BARS) -> DataFrame:
    """Correlation of the last n-1 differences with those of the benchmark at common times."""
    ts = s.order[0]
    both = df.join(benchmark.select(ts, F.col(value).alias("_bench")), ts)

    def build(d: DataFrame, w) -> DataFrame:
        d = d.withColumns({"_x": F.col(value) - F.lag(value, 1).over(w), "_y": F.col("_bench") - F.lag("_bench", 1).over(w)})
        frame = rows_before(w, n - 1)
        enough = F.count("_x").over(frame) > least
        corr = F.corr("_x", "_y").over(frame)
        return d.withColumn("benchmark_corr", F.when(enough, F.coalesce(F.nanvl(corr, F.lit(0.0)), F.lit(0.0))))

    return over_rows(both, s, build, n - 1).drop("_x", "_y", "_bench")
