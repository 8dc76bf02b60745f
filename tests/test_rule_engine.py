"""The rule engine against a row-by-row version of every method, and its scans as rules grow."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import features as FE
from tidemark.operators import models as M
from tidemark.plans.series import Series

S = Series(("metric",), ("ts", "seq"))
NAMES = ("pnl", "volume", "delay", "shift")


def made(spark, n=300):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(n):
        values = {"pnl": rng.normal(0, 400), "volume": rng.normal(100, 5) + (90 if k % 71 == 70 else 0), "delay": rng.exponential(1.0), "shift": rng.normal(10, 0.1) + (9 if k > 280 else 0)}
        rows += [(m, k // 2, k, None if k == 9 else float(values[m])) for m in NAMES]
    rows += [("ignored", k, k, 1e9) for k in range(50)] + [(None, 1, 1, 5.0)]
    return spark.createDataFrame(rows, "metric string, ts long, seq long, value double")


def level(m, t):
    return next((name for name, f in (("critical", 3), ("high", 2), ("medium", 1.5)) if abs(m) >= abs(t) * f), "low")


def brute(series, rule):
    name, _, metric, method, t, n = rule
    rows = sorted((r.ts, r.seq, r.value) for r in series.where("metric is not null").collect() if r.metric == metric)
    for i, (_, seq, x) in enumerate(rows):
        if method == "threshold" and x is not None and x <= t:
            yield name, metric, seq, level(x, t), 0.95, abs(x)
        if method == "zscore" and x is not None:
            past = [v for _, _, v in rows[max(0, i - n + 1) : i] if v is not None]
            if len(past) >= n - 1 and np.std(past) and abs(z := (x - np.mean(past)) / np.std(past)) >= t:
                yield name, metric, seq, level(z, t), min(0.99, abs(z) / 5), abs(z)
        if method == "iqr" and x is not None:
            frame = [v for _, _, v in rows[max(0, i - n + 1) : i + 1] if v is not None]
            if len(frame) >= n:
                lo, hi = np.percentile(frame, [25, 75])
                d = max(lo - t * (hi - lo) - x, x - hi - t * (hi - lo)) / (hi - lo)
                if d > 0:
                    yield name, metric, seq, level(d, t), min(0.99, d / 3), d


RULES = [("a", "k", "pnl", "zscore", 2.0, 24), ("b", "k", "pnl", "threshold", -300.0, 1), ("c", "k", "volume", "zscore", 3.0, 24), ("d", "k", "volume", "zscore", 2.0, 6),
         ("e", "k", "delay", "iqr", 1.5, 48), ("f", "k", "delay", "iqr", 1.0, 20), ("g", "k", "delay", "zscore", 2.5, 12), ("h", "k", "missing", "zscore", 1.0, 3)]


def test_framed_methods_equal_brute_force(spark, layout):
    series = made(spark)
    got = {(r.rule, r.metric, r.seq): (r.severity, round(r.confidence, 9), round(r.magnitude, 9)) for r in FE.anomaly_rules(series, RULES).collect()}
    want = {(a, m, q): (s, round(c, 9), round(g, 9)) for rule in RULES for a, m, q, s, c, g in brute(series, rule)}
    assert set(got) == set(want) and {a for a, _, _ in want} == set("abcdefg")
    for k, (s, c, g) in want.items():
        assert got[k][0] == s and got[k][1] == pytest.approx(c, abs=1e-7) and got[k][2] == pytest.approx(g, abs=1e-7)


def test_change_points_and_forests(spark):
    series = made(spark)
    rules = [("p", "k", "shift", "changepoint", 0.3, 48), ("q", "k", "pnl", "changepoint", 50.0, 48), ("r", "k", "volume", "isolation_forest", 0.01, 1), ("s", "k", "shift", "isolation_forest", 0.01, 1)]
    got = FE.anomaly_rules(series, rules).collect()
    moved = [r for r in got if r.rule == "p"]
    assert len(moved) == 1 and moved[0].seq in range(276, 286) and moved[0].severity == level(moved[0].magnitude, 0.3) and moved[0].confidence == 0.8
    assert not [r for r in got if r.rule == "q"]
    one = M.window_features(series.where("metric = 'volume'"), "value", S)
    alone = M.isolation_scores(one, ["value", "f_mean", "f_std", "f_min", "f_max"], ["metric", "ts", "seq"], group="metric").where("anomaly").collect()
    assert {r.seq for r in got if r.rule == "r"} == {r.seq for r in alone} and 0 < len(alone) <= 30
    assert {70, 141, 212} <= {r.seq for r in alone}  # the planted peaks
    assert all(r.confidence == pytest.approx(min(0.95, r.magnitude)) for r in got if r.rule in "rs")


def test_scans_do_not_grow_with_rules(spark):
    plan = lambda rules: FE.anomaly_rules(made(spark), rules)._jdf.queryExecution().optimizedPlan().toString()
    few, many = plan(RULES[:1]), plan([(f"{n}{k}", *r) for k in range(5) for n, *r in RULES])
    scans = lambda text: text.count("LogicalRDD") + text.count("LocalRelation")
    assert scans(few) == scans(many) > 0 and few.count("Window") == many.count("Window")


def test_odd_rules_and_empty_series(spark):
    with pytest.raises(ValueError, match="unknown methods"):
        FE.anomaly_rules(made(spark), [("a", "k", "pnl", "guess", 1.0, 1)])
    rules = [*RULES, ("p", "k", "shift", "changepoint", 0.3, 48), ("r", "k", "volume", "isolation_forest", 0.01, 1)]
    assert FE.anomaly_rules(made(spark).limit(0), rules).count() == 0


def test_one_long_series_fills_many_tasks(spark, monkeypatch):
    monkeypatch.setattr("tidemark.plans.series.HEAVY_SMALL_MB", 0, raising=False)
    monkeypatch.setattr(FE, "FRAME_ROWS", 200, raising=False)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        one = spark.createDataFrame([("pnl", k, k, float(k * 7919 % 1009)) for k in range(4000)], "metric string, ts long, seq long, value double").repartition(4)
        tasks = lambda d: d.select(F.spark_partition_id()).distinct().count()
        assert tasks(FE.anomaly_rules(one, [("a", "k", "pnl", "zscore", 1.0, 24), ("b", "k", "pnl", "iqr", 0.1, 24)])) > 2
        assert tasks(M.isolation_scores(M.window_features(one, "value", S), ["value", "f_mean"], list(S.keys + S.order), trees=5, group="metric")) > 2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_packed_trees_walk_like_nodes():
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(0, 1, (400, 3)), 1)
    trees = [np.array(M._grow(x[k::4][:64], rng, 6)) for k in range(4)] + [np.array(M._grow(x[:1], rng, 1))]

    def length(nodes, row):
        at = depth = 0
        while nodes[at, 0] >= 0:
            at, depth = int(nodes[at, 2 if row[int(nodes[at, 0])] < nodes[at, 1] else 3]), depth + 1
        return depth + float(M._expected_depth(nodes[at, 4:5])[0])

    want = [sum(length(t, row) for t in trees) / len(trees) for row in x]
    assert M._path_lengths(x, [M._packed(t) for t in trees]).tolist() == pytest.approx(want, rel=1e-15)
