"""Refits do not depend on how a series is cut into blocks."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import garch as G
from tidemark.plans.series import Series, with_blocks

S = Series(("symbol",), ("seq",))


def walk(n):
    rng = np.random.default_rng(4)
    return pd.DataFrame({"symbol": "HOT", "seq": np.arange(n), "x": 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))})


def test_equal_for_any_block(spark, monkeypatch):
    df = spark.createDataFrame(walk(1500))
    run = lambda: G.rolling_garch(df, "x", S, ["seq"], window=60, least=50, every=40).toPandas().sort_values("seq", ignore_index=True)
    one = run()
    monkeypatch.setattr(G, "BLOCK_ROWS", 400)
    many = run()
    assert len(one) == len(many) == 1500 and one["volatility"].notna().sum() > 1400
    columns = [c for c in one.columns if c != "converged"]
    assert np.allclose(one[columns].astype(float), many[columns].astype(float), rtol=1e-9, equal_nan=True)


def test_a_hot_key_spreads(spark):
    """10,000 rows of one key: no block holds more rows than stated, halo aside, and every row has one home."""
    d = with_blocks(spark.createDataFrame(walk(10_000)), S, before=262, most=G.BLOCK_ROWS)
    per = d.groupBy("_blk").agg(F.count_if(~F.col("_halo")).alias("own"), F.count_if(F.col("_halo")).alias("halo")).collect()
    assert sum(r.own > 0 for r in per) == 5 and max(r.own for r in per) <= G.BLOCK_ROWS and max(r.halo for r in per) <= 262 and sum(r.own for r in per) == 10_000
