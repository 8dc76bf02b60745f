"""Blocked products against the join of all pairs and against numpy."""

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import pairs as P
from tidemark.operators.aggregates import correlation_matrix


def gappy(symbols=40, times=12, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for w in range(2):
        base = rng.normal(size=(4, times))
        for i in range(symbols):
            x = base[i % 4] + rng.normal(0, 0.4, times)
            if i == 7:
                x[:] = 3.25
            rows += [(w, f"s{i:02d}", t, float(x[t])) for t in range(times) if rng.random() > 0.25]
    pdf = pd.DataFrame(rows, columns=["w", "symbol", "t", "close"])
    pdf["ts"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(pdf["t"], unit="h")
    return pdf.drop(columns="t")


def back(df, columns=("w", "a", "b")):
    return df.toPandas().sort_values(list(columns), ignore_index=True)


def test_all_pairs_equal_the_join(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 9)
    pdf = gappy()
    pdf = pd.concat([pdf, pdf[pdf["symbol"] == "s03"].head(2)])  # repeated rows
    pdf.loc[pdf["symbol"] == "s11", "close"] = np.inf
    df = spark.createDataFrame(pdf)
    got, want = back(P.correlated_pairs(df, group=["w"])), back(correlation_matrix(df, group=["w"]))
    assert len(got) == len(want) > 1000 and (got[["w", "a", "b", "n"]] == want[["w", "a", "b", "n"]]).all(None)
    assert np.allclose(got["corr"], want["corr"], atol=1e-9)


def test_thresholds_and_strongest(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 9)
    df = spark.createDataFrame(gappy())
    every = back(correlation_matrix(df, group=["w"]))
    got = back(P.correlated_pairs(df, group=["w"], at_least=0.6, at_most=-0.5))
    assert len(got) == ((every["corr"] >= 0.6) | (every["corr"] <= -0.5)).sum()
    top = back(P.correlated_pairs(df, group=["w"], strongest=15))
    order = lambda d: d.assign(s=-d["corr"].abs().round(9)).sort_values(["w", "s", "a", "b"]).groupby("w").head(15)[["w", "a", "b"]].to_numpy().tolist()
    assert order(top) == order(every) and len(top) < len(every)


def test_odd_rows(spark):
    pdf = gappy(6)
    pdf.loc[pdf["symbol"] == "s01", "symbol"] = None
    pdf.loc[::7, "close"] = None
    df = spark.createDataFrame(pdf.astype({"close": object}).where(pdf.notna(), None), "w long, symbol string, close double, ts timestamp")
    got = back(P.correlated_pairs(df, least=2), ["a", "b"])
    want = back(correlation_matrix(df.dropna(), least=2), ["a", "b"])
    assert (got[["a", "b", "n"]] == want[["a", "b", "n"]]).all(None) and np.allclose(got["corr"], want["corr"], atol=1e-9)
    assert P.correlated_pairs(df.limit(0)).count() == 0


def test_ten_thousand_symbols(spark):
    """Planted groups of twenty: rows leave only for pairs that pass."""
    rng = np.random.default_rng(2)
    symbols, times = 10_000, 24
    x = (np.repeat(rng.normal(size=(symbols // 20, times)), 20, 0) + rng.normal(0, 0.2, (symbols, times))).round(4)
    z = x - x.mean(1, keepdims=True)
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    want = sum(int((np.triu(z[i : i + 1000] @ z.T, i + 1) >= 0.9).sum()) for i in range(0, symbols, 1000))
    pdf = pd.DataFrame({"symbol": np.repeat([f"s{i:05d}" for i in range(symbols)], times), "close": x.ravel(),
                        "ts": np.tile(pd.date_range("2024-01-01", periods=times, freq="h"), symbols)})
    got = P.correlated_pairs(spark.createDataFrame(pdf), at_least=0.9)
    assert got.count() == want > 80_000
