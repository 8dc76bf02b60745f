"""The split plans of one hot key must equal brute force, as must the plain ones."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators.rolling import moving_average
from tidemark.plans.folds import fold
from tidemark.plans.quantiles import exact_percentiles
from tidemark.plans.ranges import first_at_or_below, first_touch, interval_extremes, range_extremes
from tidemark.plans.scans import affine_scan
from tidemark.plans.series import Series, asof, over_time, running, with_position

S = Series()


@pytest.fixture(scope="module")
def hot():
    """Two thirds of the rows belong to one symbol; times repeat, so ``seq`` has to break ties."""
    rng = np.random.default_rng(7)
    n = 300
    symbol = np.where(rng.random(n) < 0.67, "HOT", np.array(["A", "B", "C"])[rng.integers(0, 3, n)])
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 4 * 86400, n) // 600 * 600, unit="s")
    return pd.DataFrame({"symbol": symbol, "ts": ts, "seq": np.arange(n), "price": np.round(rng.normal(50, 10, n), 2)})


def ordered(pdf):
    return pdf.sort_values(["symbol", "ts", "seq"], ignore_index=True)


def back(df, columns):
    return ordered(df.toPandas())[columns]


def test_positions_and_running(spark, layout, hot):
    df = spark.createDataFrame(hot)
    want = ordered(hot)
    g = want.groupby("symbol")["price"]
    want["pos"] = g.cumcount() + 1
    want["total"], want["top"] = g.cumsum(), g.cummax()
    d = running(with_position(df, S), S, {"total": ("sum", F.col("price")), "top": ("max", F.col("price")), "n": ("count", F.col("price")),
                                          "last": ("last", F.when(F.col("price") > 50, F.col("price")))})
    got = back(d, ["symbol", "seq", "pos", "total", "top", "n", "last"])
    assert (got["pos"] == want["pos"]).all() and (got["n"] == want["pos"]).all()
    assert np.allclose(got["total"], want["total"]) and np.allclose(got["top"], want["top"])
    high = want["price"].where(want["price"] > 50).groupby(want["symbol"]).ffill()
    assert np.allclose(got["last"].astype(float), high, equal_nan=True)


def test_finite_frames(spark, layout, hot):
    got = back(moving_average(spark.createDataFrame(hot), "price", (5,)), ["symbol", "ma_5"])
    want = ordered(hot).groupby("symbol")["price"].rolling(5, min_periods=1).mean()
    assert np.allclose(got["ma_5"], want)


def test_time_frames(spark, layout, hot):
    d = over_time(spark.createDataFrame(hot), S, 7200, lambda x, w: x.withColumn("n", F.count(F.lit(1)).over(w.rangeBetween(-7200, 0))))
    want = ordered(hot)
    n = [((want["symbol"] == r.symbol) & (want["ts"] <= r.ts) & (want["ts"] >= r.ts - pd.Timedelta(hours=2))).sum() for r in want.itertuples()]
    assert back(d, ["n"])["n"].tolist() == n


def test_linear_recursion(spark, layout, hot):
    d = affine_scan(spark.createDataFrame(hot).withColumns({"m": F.lit(0.9), "b": F.col("price") * 0.1}), S, "m", "b", "y")
    want = ordered(hot)
    out = []
    for _, g in want.groupby("symbol"):
        y = 0.0
        for p in g["price"]:
            y = 0.9 * y + 0.1 * p
            out.append(y)
    assert np.allclose(back(d, ["y"])["y"], out)


def test_fold_with_state_machine(spark, layout, hot):
    def step(rows, state):
        on, out = bool(state), []
        for p in rows["price"]:
            on = True if p > 62 else False if p < 38 else on
            out.append(on)
        return rows[["symbol", "ts", "seq"]].assign(on=out), on

    got = back(fold(spark.createDataFrame(hot), S, step, "symbol string, ts timestamp, seq long, on boolean"), ["on"])
    want = pd.concat([step(g, None)[0] for _, g in ordered(hot).groupby("symbol")])
    assert got["on"].tolist() == want["on"].tolist()


@pytest.mark.parametrize("forward", [False, True])
def test_asof(spark, layout, hot, forward):
    df = spark.createDataFrame(hot)
    left, right = df.filter("seq % 3 = 0"), df.filter("seq % 3 <> 0")
    got = asof(left.drop("price"), right, ("symbol",), {"price": "p"}, forward=forward).toPandas()
    r = hot[hot["seq"] % 3 != 0]
    for row in got.itertuples():
        c = r[(r["symbol"] == row.symbol) & ((r["ts"] >= row.ts) if forward else (r["ts"] <= row.ts))].sort_values(["ts", "seq"])
        if len(c):
            assert row.p == (c.iloc[0] if forward else c.iloc[-1])["price"]
        else:
            assert pd.isna(row.p)


def test_percentiles_with_many_ties(spark, layout, hot):
    pdf = hot.assign(v=np.where(hot["seq"] % 3 == 0, 1.0, hot["price"].round(0)))
    probs = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.95, "e": 1.0}
    got = exact_percentiles(spark.createDataFrame(pdf), ["symbol"], "v", probs).toPandas().set_index("symbol")
    for k, g in pdf.groupby("symbol"):
        assert np.allclose(got.loc[k, list(probs)].astype(float), np.quantile(g["v"], list(probs.values())))
    whole = exact_percentiles(spark.createDataFrame(pdf), [], "v", probs).toPandas()
    assert np.allclose(whole.iloc[0][list(probs)].astype(float), np.quantile(pdf["v"], list(probs.values())))


def test_range_helpers_by_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(100):
        v = rng.integers(0, 30, int(rng.integers(1, 40))).astype(float)
        lo = rng.integers(0, len(v), 20)
        hi = np.array([int(rng.integers(s, len(v))) for s in lo])
        lim = rng.integers(-2, 32, 20).astype(float)
        want = [next((i for i in range(s, len(v)) if v[i] <= x), -1) for s, x in zip(lo, lim)]
        assert first_at_or_below(v, lo, lim).tolist() == want
        a, b = range_extremes(v, lo, hi)
        assert all(a[i] == v[lo[i]:hi[i] + 1].min() and b[i] == v[lo[i]:hi[i] + 1].max() for i in range(20))


def test_first_touch_and_interval_extremes(spark, layout, hot):
    df = spark.createDataFrame(hot)
    q = df.select("symbol", "ts", F.col("seq").alias("id"), (F.col("price") - 8).alias("limit"), (F.col("ts") + F.expr("interval 20 hours")).alias("until"))
    placed = with_position(df, S, "hit_pos").select("symbol", "hit_pos", F.col("seq").alias("hit"))
    hit = first_touch(q, df, S, "id", "limit", "price").join(placed, ["symbol", "hit_pos"]).toPandas().set_index("id")["hit"].to_dict()
    ext = interval_extremes(q, df, S, "id", "ts", "until", "price").toPandas().set_index("id")
    for r in hot.itertuples():
        c = hot[(hot["symbol"] == r.symbol) & (hot["ts"] >= r.ts)].sort_values(["ts", "seq"])
        touch = c[c["price"] <= r.price - 8]
        assert hit.get(r.seq) == (touch["seq"].iloc[0] if len(touch) else None)
        inside = c[c["ts"] <= r.ts + pd.Timedelta(hours=20)]["price"]
        assert (ext.loc[r.seq, "low"], ext.loc[r.seq, "high"]) == (inside.min(), inside.max())


def test_null_keys_stay_in_both_layouts(spark, layout):
    rows = [(None if k % 4 == 0 else "a", (pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=k // 2)).to_pydatetime(), k, float(k)) for k in range(200)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, seq long, price double")
    placed = with_position(df, S).collect()
    own = {s: sorted(r.seq for r in placed if r.symbol == s) for s in (None, "a")}
    assert len(placed) == 200 and all(own[r.symbol].index(r.seq) + 1 == r.pos for r in placed)
    totals = running(df, S, {"t": ("sum", F.col("price"))}).collect()
    assert len(totals) == 200 and all(r.t == sum(x for x in own[r.symbol] if x <= r.seq) for r in totals)
    scanned = affine_scan(df.selectExpr("*", "1D as m", "price as b"), S, "m", "b", "y").collect()
    assert len(scanned) == 200 and all(abs(r.y - sum(x for x in own[r.symbol] if x <= r.seq)) < 1e-9 for r in scanned)
    halves = {r.symbol: r.p for r in exact_percentiles(df, ["symbol"], "price", {"p": 0.5}).collect()}
    assert halves == {s: float(np.median(own[s])) for s in own}


def test_equal_times_are_split(spark, layout):
    from tidemark.plans.series import _with_cells

    df = spark.range(500).selectExpr("'HOT' as symbol", "timestamp'2024-01-01' as ts", "id as seq", "cast(id as double) as price")
    got = with_position(df, S).collect()
    assert sorted((r.seq, r.pos) for r in got) == [(k, k + 1) for k in range(500)]
    cells, columns = _with_cells(df, S)
    assert cells.groupBy(*columns).count().agg(F.max("count")).first()[0] < 200
