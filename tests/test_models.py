"""Models and state machines against planted or hand-made truths."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.distributions import f_cdf, t_two_sided
from tidemark.operators import models as M
from tidemark.operators import states as ST
from tidemark.operators import validation as W
from tidemark.operators.garch import fit_garch
from tidemark.plans.series import BARS, Series


def minutes(n, step=60):
    return pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n) * step, unit="s")


def test_distribution_tails():
    assert t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert t_two_sided(1.0, 1) == pytest.approx(0.5, abs=1e-12)
    assert f_cdf(4.964602744, 1, 10) == pytest.approx(0.95, abs=1e-8)
    assert f_cdf(1.0, 5, 5) == pytest.approx(0.5, abs=1e-12)


def direct_bocd(x, hazard=1 / 250, longest=500, warmup=10):
    """The definition, run length by run length."""
    def density(v, data):
        n = len(data)
        if n == 0:
            a, b, k, m = 1.0, 1.0, 1.0, 0.0
        else:
            mean, var = np.mean(data), np.var(data, ddof=1) if n > 1 else 1.0
            k, a = 1.0 + n, 1.0 + n / 2
            m, b = n * mean / k, 1.0 + 0.5 * n * var + 0.5 * n * mean**2 / k
        df, s2 = 2 * a, b * (k + 1) / (a * k)
        c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi * s2)
        return max(1e-10, c * (1 + (v - m) ** 2 / (df * s2)) ** (-(df + 1) / 2))

    probs, out = np.array([1.0]), []
    for i, v in enumerate(x):
        if i + 1 < warmup:
            out.append(0.0)
            continue
        seen = x[: i + 1]
        pred = np.array([density(v, seen[-r:] if r else []) for r in range(len(probs))])
        grow = pred * probs * (1 - hazard)
        change = pred[0] * hazard * probs.sum()
        p = change / (grow.sum() + change)
        new = np.r_[p, grow][: longest]
        probs = new / new.sum()
        out.append(p)
    return out


def test_bocd_equals_its_definition_in_any_chunking():
    rng = np.random.default_rng(1)
    x = np.r_[rng.normal(0, 1, 40), rng.normal(4, 1.5, 40)]
    rows = pd.DataFrame({"x": x, "i": range(80)})
    step = ST.bocd_step("x", ["i"])
    whole, _ = step(rows, None)
    first, state = step(rows[:33], None)
    second, _ = step(rows[33:], state)
    assert np.allclose(whole["probability"], direct_bocd(x.tolist()), atol=1e-10)
    assert np.allclose(np.r_[first["probability"], second["probability"]], whole["probability"])


def test_breaker_transitions():
    p = [0.1, 0.95, 0.5, 0.1, 0.1, 0.1, 0.1]
    t = pd.to_datetime(["2024-01-01 00:00", "2024-01-01 00:01", "2024-01-01 00:03", "2024-01-01 00:07", "2024-01-01 00:08", "2024-01-01 00:09", "2024-01-01 00:10"])
    out, _ = ST.breaker_step(["ts"])(pd.DataFrame({"ts": t, "probability": p, "recent_std": 1.0}), None)
    assert out["state"].tolist() == ["NORMAL", "HALT", "HALT", "RECOVERY", "RECOVERY", "RECOVERY", "NORMAL"]
    assert out["event"].tolist() == [None, "halt", None, None, None, None, "recovery"]
    p = [0.75, 0.75, 0.1]
    out, _ = ST.breaker_step(["ts"])(pd.DataFrame({"ts": minutes(3), "probability": p, "recent_std": 1.0}), None)
    assert out["state"].tolist()[:2] == ["WARNING", "HALT"] and out["severity"].tolist()[1] == "HIGH"


def test_lifecycle_timeouts():
    t = pd.to_datetime(["2024-01-01 00:00", "2024-01-01 00:10", "2024-01-01 00:11", "2024-01-01 00:12", "2024-01-01 00:13", "2024-01-03 00:00"])
    trig = ["entry_signal", "position_entered", "reset", "entry_signal", "position_entered", "hold"]
    out, _ = ST.lifecycle_step(["ts"])(pd.DataFrame({"ts": t, "trigger": trig}), None)
    assert out["state"].tolist() == ["ENTERING", "ERROR", "SEARCHING", "ENTERING", "IN_POSITION", "EXITING"]


def test_smoothing_needs_three_confirmations():
    rows = pd.DataFrame({"ts": minutes(8), "regime": ["a", "a", "a", "b", "b", "a", "b", "b"], "confidence": [0.9] * 8})
    out, _ = ST.smoothing_step(["ts"])(rows, None)
    assert out["smoothed"].tolist() == ["unknown", "unknown", "a", "a", "a", "a", "a", "a"]


def test_risk_gate_halts_and_cuts():
    rows = pd.DataFrame({"ts": minutes(4), "symbol": ["X"] * 4, "quantity": [50.0, 500.0, 10.0, 10.0], "price": [100.0, 100.0, 40.0, 40.0]})
    out, _ = ST.risk_gate_step(["ts"])(rows, None)
    assert out["result"].tolist() == ["approved", "modified", "halted", "halted"]
    assert out["approved"].tolist()[1] == pytest.approx(50.0)


def test_garch_recovers_planted_parameters():
    rng = np.random.default_rng(3)
    e, s2, r = 0.0, 1.0, []
    for _ in range(4000):
        s2 = 0.05 + 0.1 * e * e + 0.85 * s2
        e = math.sqrt(s2) * rng.normal()
        r.append(e)
    mu, omega, alpha, beta, ll, nxt, rest = fit_garch(np.array(r))
    assert rest
    assert abs(alpha - 0.1) < 0.04 and abs(beta - 0.85) < 0.07 and 0 < nxt < 20


def brute_dbscan(x, eps, least):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    near = d <= eps
    core = near.sum(1) >= least
    label = np.full(len(x), -1)
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            stack = [i]
            while stack:
                j = stack.pop()
                if label[j] >= 0:
                    continue
                label[j] = i
                stack += [k for k in np.flatnonzero(near[j] & core) if label[k] < 0]
    return core, label, near


def test_dbscan_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    x = np.r_[rng.normal(0, 0.15, (60, 2)), rng.normal(1.2, 0.2, (40, 2)), rng.uniform(-1, 3, (30, 2))]
    df = spark.createDataFrame(pd.DataFrame({"id": range(len(x)), "x": x[:, 0], "y": x[:, 1]}))
    got = M.dbscan(df, ["x", "y"], "id", 0.2, 4).toPandas().set_index("id")["label"].sort_index().to_numpy()
    core, label, near = brute_dbscan(x, 0.2, 4)
    for i, j in itertools.combinations(np.flatnonzero(core), 2):
        assert (got[i] == got[j]) == (label[i] == label[j])
    for i in np.flatnonzero(~core):
        reach = set(got[np.flatnonzero(near[i] & core)])
        assert (got[i] in reach) if reach else got[i] == -1


def test_changepoints_find_planted_breaks(spark):
    rng = np.random.default_rng(2)
    x = np.r_[rng.normal(0, 0.3, 100), rng.normal(3, 0.3, 100), rng.normal(-1, 0.3, 100)]
    df = spark.createDataFrame(pd.DataFrame({"symbol": "S", "ts": minutes(300), "x": x}))
    got = M.changepoints(df, "x", BARS, breaks=2).toPandas()
    assert sorted(got["position"]) == [100, 200]


def test_isolation_scores_rank_outliers_first(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (400, 2))
    x[:5] += 9
    df = spark.createDataFrame(pd.DataFrame({"id": range(400), "x": x[:, 0], "y": x[:, 1]}))
    got = M.isolation_scores(df, ["x", "y"], "id", trees=40).toPandas().sort_values("score", ascending=False)
    assert set(got["id"].head(5)) == set(range(5)) and 20 <= got["anomaly"].sum() <= 60


def test_hidden_regimes_are_recovered(spark):
    rng = np.random.default_rng(6)
    z = np.repeat([0, 1, 0, 1], 60)
    df = spark.createDataFrame(pd.DataFrame({"symbol": "S", "ts": minutes(240), "x": np.where(z == 0, rng.normal(0, 1, 240), rng.normal(6, 1, 240))}))
    model = M.fit_regimes(df, ["x"], k=2, rounds=8)
    got = M.predict_regimes(df, model).toPandas().sort_values("ts")
    assert (got["state"].to_numpy() == z).mean() > 0.97


def test_equal_labels_agree(spark):
    df = spark.createDataFrame([(i, i % 3, (i % 3) + 10) for i in range(30)], "id int, a int, b int")
    assert M.adjusted_rand(df, "a", "b").first()["ari"] == pytest.approx(1.0)


def test_period_selection_equals_enumeration(spark):
    bounds = W.time_bounds(spark.sql("SELECT explode(sequence(timestamp'2024-01-01', timestamp'2024-07-01', interval 1 day)) AS ts"))
    every = W.candidate_periods(bounds).filter("candidate % 4 = 0")
    valid = every.crossJoin(spark.range(1).select(F.col("id").alias("split_id")))
    got = W.select_periods(valid, max_periods=5).toPandas()
    c = every.toPandas().sort_values("candidate")
    us = lambda t: t.timestamp()
    span, target = c["span"].iloc[0] / 1e6, 0.6 * c["span"].iloc[0] / 1e6
    best = -1.0
    for n in range(1, 6):
        for combo in itertools.combinations(list(c.itertuples()), n):
            length = sum(us(p.end) - us(p.start) for p in combo)
            gap = sum(max(0.0, us(b.start) - us(a.end)) for a, b in zip(combo, combo[1:]))
            best = max(best, 0.7 * (1 - abs(length - target) / target) + 0.3 / (1 + gap / length))
    assert got["score"].iloc[0] == pytest.approx(best, abs=1e-8)


def test_splits_keep_training_clear_of_test(spark, sf):
    from tidemark.catalog.evaluation import _flags

    v = W.validate_splits(_flags(spark, sf)).toPandas()
    assert v["valid"].all() and (v["train_size"] > 0).all() and (v["test_size"] > 0).all()


def test_regimes_that_differ_only_in_correlation(spark):
    draw = np.random.default_rng(4)
    state = (np.arange(600) // 100) % 2
    a, b = draw.normal(size=(2, 600))
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(600), unit="h")
    df = spark.createDataFrame(pd.DataFrame({"symbol": "A", "ts": ts, "x": a + 0.3 * state, "y": np.where(state, -a, a) + 0.2 * b}))
    got = M.predict_regimes(df, M.fit_regimes(df, ["x", "y"], k=2, rounds=30)).toPandas().sort_values("ts")
    right = (got["state"].to_numpy() == state).mean()
    assert max(right, 1 - right) >= 0.9
