"""The parallel filter must equal the step function that streams use, in both layouts."""

import numpy as np
import pandas as pd
import pytest

from tidemark.operators.recursive import kalman_hedge_ratio
from tidemark.operators.states import kalman_step
from tidemark.plans.filters import OUT, gains
from tidemark.plans.series import Series

S = Series()


def rows_of(n, hole=None):
    rng = np.random.default_rng(3)
    symbol = np.where(rng.random(n) < 0.7, "HOT", np.where(rng.random(n) < 0.5, "A", None))
    z = 1 + np.cumsum(rng.normal(0, 0.01, n))
    if hole is not None:
        z[hole] = np.nan
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 500, n) * 60, unit="s")
    return pd.DataFrame({"symbol": symbol, "ts": ts, "seq": np.arange(n), "z": z})


def sequential(pdf, **params):
    parts = []
    for _, g in pdf.groupby("symbol", dropna=False):
        parts.append(kalman_step("z", ["symbol", "seq"], **params)(g.sort_values(["ts", "seq"], ignore_index=True), None)[0])
    return pd.concat(parts).sort_values("seq", ignore_index=True)


@pytest.mark.parametrize("params", [{}, {"ratio": 2.0, "q": 0.0, "r": 0.01, "p0": 5.0}])
def test_equals_the_sequential_filter(spark, layout, params):
    pdf = rows_of(700)
    got = kalman_hedge_ratio(spark.createDataFrame(pdf), "z", S, ["symbol", "seq"], **params).toPandas().sort_values("seq", ignore_index=True)
    want = sequential(pdf, **params)
    assert (got["seq"] == want["seq"]).all()
    assert np.allclose(got[list(OUT)], want[list(OUT)], rtol=1e-9, atol=1e-11)


def test_missing_values_and_empty_tables(spark, layout):
    pdf = rows_of(120, hole=60)
    df = spark.createDataFrame(pdf)
    got = kalman_hedge_ratio(df, "z", S, ["symbol", "seq"]).toPandas().sort_values("seq", ignore_index=True)
    assert np.allclose(got[list(OUT)].astype(float), sequential(pdf)[list(OUT)], rtol=1e-9, atol=1e-11, equal_nan=True)
    assert kalman_hedge_ratio(df.limit(0), "z", S, ["symbol", "seq"]).count() == 0


def test_the_covariance_settles():
    assert len(gains(10**6, 1e-5, 1e-3, 1.0)) < 5_000


def test_a_hot_key_of_many_blocks(spark):
    """100,000 rows, most of one key, in blocks of 4,096."""
    pdf = rows_of(100_000)
    spark.conf.set("tidemark.layout", "split")
    spark.conf.set("tidemark.block.rows", "4096")
    try:
        got = kalman_hedge_ratio(spark.createDataFrame(pdf), "z", S, ["symbol", "seq"]).toPandas().sort_values("seq", ignore_index=True)
    finally:
        spark.conf.unset("tidemark.layout")
        spark.conf.unset("tidemark.block.rows")
    assert np.allclose(got[list(OUT)], sequential(pdf)[list(OUT)], rtol=1e-8, atol=1e-10)
