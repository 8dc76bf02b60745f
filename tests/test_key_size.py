"""Tables of many short keys take one window per key however large they are; only long keys are split."""

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from tidemark.operators import accounting as K
from tidemark.operators import aggregates as A
from tidemark.operators import book as B
from tidemark.operators import recursive as Q
from tidemark.operators.ranking import merge_intervals
from tidemark.plans import folds, series, sizing
from tidemark.plans.series import TICKS, Series

RULES = ["tidemark.small.mb", "tidemark.key.rows", "tidemark.block.rows", "tidemark.layout"]


@pytest.fixture
def large(spark):
    """Every table counts as large; returns a switch for the rows of a long key."""
    spark.conf.set("tidemark.small.mb", "0")
    yield lambda rows: (spark.conf.set("tidemark.key.rows", str(rows)), spark.conf.set("tidemark.block.rows", "16"))
    for name in RULES:
        spark.conf.unset(name)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    n = 240
    symbol = np.where(rng.random(n) < 0.5, "HOT", np.array(["A", "B", None], dtype=object)[rng.integers(0, 3, n)])
    return spark.createDataFrame(pd.DataFrame({
        "symbol": symbol, "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 3 * 86400, n) // 600 * 600, unit="s"), "seq": np.arange(n),
        "order_id": np.arange(n), "side": np.where(rng.random(n) < 0.4, "sell", "buy"), "quantity": rng.integers(1, 9, n) * 1.0,
        "price": np.round(rng.uniform(20, 80, n), 2), "fee": 0.1, "regime": np.array(list("xyz"))[rng.integers(0, 3, n)],
    })).withColumns({"bid": F.col("price") - 0.5, "ask": F.col("price") + 0.5, "bid_qty": F.lit(1.0), "ask_qty": F.lit(1.0),
                     "limit": F.when(F.col("side") == "buy", F.col("price") * 0.9).otherwise(F.col("price") * 1.1), "probability": F.col("price") / 100, "recent_std": F.lit(1.0)})


def daily(d):
    return series.by_key_size(d, TICKS, lambda x, s: K.daily_pnl(K.average_cost_positions(x, s), s))


CASES = {
    "a20": daily, "st06": K.average_cost_positions, "st07": K.portfolio_value, "w09": lambda d: Q.macd(d, "price"), "w08": lambda d: Q.rsi_wilder(d, "price", 5),
    "st00": lambda d: Q.ewm(d, "price", "ema", span=10), "a09": lambda d: series.by_key_size(d, TICKS, lambda x, s: A._spells(x, "regime", s)),
    "b16": lambda d: B.limit_fills(d.select("symbol", "ts", "seq", "order_id", "side", "quantity", "limit"), d.select("symbol", "ts", "seq", "bid", "ask", "bid_qty", "ask_qty")),
    "fold": lambda d: Q.circuit_breaker(d, TICKS, ["symbol", "seq"]),
    "u04": lambda d: merge_intervals(d.select("symbol", F.col("ts").alias("start"), (F.col("ts") + F.expr("interval 2 hours")).alias("end"), "seq"), Series(("symbol",), ("start", "seq"))),
    "a04": lambda d: A.hourly_trading_metrics(d.withColumn("pnl", F.when(F.col("seq") % 9 > 0, F.col("price") - 50)), ("ts", "seq"), "day"),
}


def told(df):
    return sorted((tuple(f"{v:.8g}" if isinstance(v, float) else repr(v) for v in r) for r in df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("name", sorted(CASES))
def test_short_keys_write_no_checkpoint(spark, large, rows, name, monkeypatch):
    spark.conf.set("tidemark.layout", "plain")
    want = told(CASES[name](rows))
    spark.conf.set("tidemark.layout", "auto")
    large(1000)

    def never(df):
        raise AssertionError("a table of short keys was checkpointed")

    for module in (series, folds, sizing):
        monkeypatch.setattr(module, "checkpointed", never)
    assert told(CASES[name](rows)) == want


@pytest.mark.parametrize("name", ["st06", "w09", "w08", "b16", "fold", "u04"])
def test_long_keys_beside_short_ones(spark, large, rows, name):
    spark.conf.set("tidemark.layout", "plain")
    want = told(CASES[name](rows))
    spark.conf.set("tidemark.layout", "auto")
    large(60)
    assert told(CASES[name](rows)) == want


def test_blocks_of_heavy_steps_are_bounded(spark, large, rows):
    """Whatever the general size of a block, the detector gets ``BOCD_ROWS`` rows at a time."""
    large(10)
    spark.conf.set("tidemark.block.rows", "500000")
    sizes = folds.fold(rows, TICKS, lambda r, state: (pd.DataFrame({"n": [len(r)]}), None), "n long", 25)
    assert Q.BOCD_ROWS <= 25_000 and max(r.n for r in sizes.collect()) <= 25


def test_slices_of_a_topic_follow_the_longest_key(spark, monkeypatch):
    """A key costs a call per slice, so more keys must not mean more slices; more rows of one key do."""
    from tidemark.catalog import streaming as C

    monkeypatch.setattr(C, "PIECE", 100)
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id"))
    many = spark.range(2000).select((F.col("id") % 40).cast("string").alias("symbol"), at.alias("ts"))
    one = spark.range(2000).select(F.lit("HOT").alias("symbol"), at.alias("ts"))
    assert len(C._cuts(many, "symbol")[0]) == 2 and len(C._cuts(one, "symbol")[0]) == 19
