"""Market-shaped views over the star-schema tables and the event stream.

Each view is a lazy DataFrame over one directory of Parquet tables. Time columns are cast from the
zone-less file type to session-zone timestamps; both casts and filters on them reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_id() -> F.Column:
    """Unique id of a line item: order, line and part together."""
    return (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey") % 1_000_000


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: symbol, ts, seq, price, channel, props."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("symbol"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        F.col("value").alias("price"),
        F.col("event_type").alias("channel"),
        "props",
    )


def channel_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks with the event type as the symbol: few, long series."""
    return ticks(spark, sf_dir).withColumn("symbol", F.col("channel"))


def bars(df: DataFrame, unit: str = "hour") -> DataFrame:
    """OHLCV bars per symbol; ties in time are broken by ``seq``. Partial aggregation before the shuffle."""
    at = F.struct("ts", "seq")
    return df.groupBy("symbol", F.date_trunc(unit, "ts").alias("ts")).agg(
        F.min_by("price", at).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", at).alias("close"),
        F.sum("price").alias("volume"),
        F.count(F.lit(1)).alias("n"),
    )


def bars_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(channel_ticks(spark, sf_dir), "hour")


def metric_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long metric points (symbol, ts = day, metric, value): mean value per day and channel."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(
            F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("symbol"),
            F.date_trunc("day", F.col("ts").cast("timestamp")).alias("ts"),
            F.col("event_type").alias("metric"),
        )
        .agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n"))
    )


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills per supplier; ``seq`` is unique per fill and breaks ties of equal ship dates."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("P"), F.col("l_suppkey").cast("string")).alias("symbol"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        line_id().alias("seq"),
        F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("fee"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linestatus").alias("book_side"),
    )


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Book levels, one row each: the lines of an order are the levels of one book."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("book_id"),
        F.concat(F.lit("P"), (F.col("l_suppkey")).cast("string")).alias("symbol"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        line_id().alias("seq"),
        F.when(F.col("l_linestatus") == "O", "bid").otherwise("ask").alias("side"),
        (F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100 + 0.5003) / 100.0).alias("price"),
        F.col("l_quantity").alias("quantity"),
    )


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books with sorted level arrays (bids descending, asks ascending)."""
    from tidemark.operators.book import assemble_books

    return assemble_books(levels(spark, sf_dir), ["book_id"], None)


def closed_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed trades with entry, exit and realised pnl."""
    line = table(spark, sf_dir, "lineitem").select(  # before the join, so that fewer columns meet in it
        "l_orderkey",
        line_id().alias("trade_id"),
        F.concat(F.lit("P"), F.col("l_suppkey").cast("string")).alias("pair"),
        F.col("l_shipdate").cast("timestamp").alias("exit_time"),
        (F.col("l_extendedprice") * (F.col("l_discount") - F.col("l_tax"))).alias("pnl"),
        F.col("l_extendedprice").alias("notional"),
        F.col("l_quantity").alias("quantity"),
        F.when(F.col("l_returnflag") == "R", "short").otherwise("long").alias("side"),
        F.when(F.col("l_linestatus") == "O", "OPEN").otherwise("CLOSED").alias("status"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("fee"),
    )
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("account"), F.col("o_orderdate").cast("timestamp").alias("entry_time")
    )
    d = line.join(orders, line.l_orderkey == orders.o_orderkey)
    return d.select("trade_id", "pair", "account", "entry_time", "exit_time", "pnl", "notional", "quantity", "side", "status", "fee")


def equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Portfolio value per customer nation and day."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return (
        orders.join(customers, orders.o_custkey == customers.c_custkey)
        .groupBy(
            F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("strategy"),
            F.col("o_orderdate").cast("timestamp").alias("ts"),
        )
        .agg(F.sum("o_totalprice").alias("value"))
    )


def nation_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly price/volume series per nation, the symbols of the correlation graph."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return (
        orders.join(customers, orders.o_custkey == customers.c_custkey)
        .groupBy(
            F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("symbol"),
            F.date_trunc("month", F.col("o_orderdate").cast("timestamp")).alias("ts"),
        )
        .agg(
            F.avg("o_totalprice").alias("close"),
            F.sum("o_totalprice").alias("volume"),
            F.max("o_totalprice").alias("high"),
            F.min("o_totalprice").alias("low"),
        )
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    )


# Regime read from the event type.
CHANNEL_REGIME = {"view": "low_vol_bull", "click": "high_vol_bear", "purchase": "stable_range", "signup": "crisis", "error": "high_vol_range"}


def regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regime classifications per symbol, with the previous regime and a confidence in 0..1."""
    from tidemark.plans.series import TICKS, by_key_size, over_rows

    label = None
    for k, v in CHANNEL_REGIME.items():
        label = F.when(F.col("channel") == k, v) if label is None else label.when(F.col("channel") == k, v)
    d = ticks(spark, sf_dir).withColumns({"regime": label, "confidence": F.least(F.col("price") / 100, F.lit(1.0))})
    def build(x: DataFrame, s) -> DataFrame:
        return over_rows(x, s, lambda y, w: y.withColumn("previous", F.lag("regime", 1).over(w)), before=1)

    return by_key_size(d, TICKS, build)


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One quote per tick: half a unit either side of the price, sizes from the sequence number."""
    return ticks(spark, sf_dir).select(
        "symbol", "ts", "seq", "channel", (F.col("price") - 0.5).alias("bid"), (F.col("price") + 0.5).alias("ask"),
        (1 + F.col("seq") % 10).cast("double").alias("bid_qty"), (1 + F.col("seq") % 7).cast("double").alias("ask_qty"),
    )


def quote_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order beside every tick: buys on views and clicks, with a limit and a stop around the price."""
    buy = F.col("channel").isin("view", "click")
    return ticks(spark, sf_dir).select(
        "symbol", "ts", "seq", F.col("seq").alias("order_id"), F.when(buy, "buy").otherwise("sell").alias("side"),
        (1 + F.col("seq") % 5).cast("double").alias("quantity"),
        F.when(buy, F.col("price") * 0.7).otherwise(F.col("price") * 1.3).alias("limit"),
        F.when(buy, F.col("price") * 1.4).otherwise(F.col("price") * 0.6).alias("stop"),
    )


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Update id ranges of a feed with gaps where the sequence number ends in 7."""
    from tidemark.plans.series import TICKS, with_position

    d = with_position(ticks(spark, sf_dir), TICKS, "pos")
    return d.select("symbol", "ts", "seq", (F.col("pos") * 2 - 1 + F.when(F.col("seq") % 10 == 7, 1).otherwise(0)).alias("first_id"), (F.col("pos") * 2).alias("final_id"))
