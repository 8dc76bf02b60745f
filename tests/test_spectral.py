"""Spectral clusters of points: planted rings, a hot point, the exact small case, odd rows, the consensus query."""

import numpy as np
import pandas as pd

from tidemark.catalog import load
from tidemark.operators import models as M


def rand_index(spark, rows):
    return M.adjusted_rand(spark.createDataFrame(rows, "a long, b long"), "a", "b").first().ari


def rings(n, rng):
    turn, ring = rng.uniform(0, 2 * np.pi, n), np.arange(n) % 2
    r = np.where(ring == 0, 1.0, 3.0) + rng.normal(0, 0.05, n)
    return pd.DataFrame({"id": np.arange(n), "x": r * np.cos(turn), "y": r * np.sin(turn), "ring": ring})


def test_rings_and_a_hot_point(spark):
    d = rings(6000, np.random.default_rng(5))
    d.loc[d.index % 3 == 0, ["x", "y", "ring"]] = [1.0, 0.0, 0]  # a third of all rows in one point
    df = spark.createDataFrame(d)
    got = M.spectral_points(df, ["x", "y"], "id", 2, gamma=10.0).join(df.select("id", "ring"), "id").collect()
    assert len(got) == 6000
    assert rand_index(spark, [(r.label, r.ring) for r in got]) >= 0.95


def test_embedding_of_few_points_is_that_of_the_whole_graph(spark):
    rng = np.random.default_rng(11)
    x = np.r_[rng.normal(0, 0.4, (60, 2)), rng.normal(3, 0.4, (60, 2)), rng.normal((0, 4), 0.4, (60, 2))]
    df = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(x)], "id long, x double, y double")
    got = {r.id: r.label for r in M.spectral_points(df, ["x", "y"], "id", 3).collect()}
    w = np.exp(-((x[:, None] - x[None]) ** 2).sum(2))
    root = np.sqrt(w.sum(1))
    _, vectors = np.linalg.eigh(w / root[:, None] / root)
    e = vectors[:, -3:] / root[:, None]
    centres = np.array([e[k * 60 : k * 60 + 60].mean(0) for k in range(3)])
    want = ((e[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    assert rand_index(spark, [(got[k], int(want[k])) for k in range(180)]) == 1.0


def test_odd_rows(spark):
    rows = [(1, 0.0, 0.0), (2, None, 0.0), (3, float("nan"), 1.0), (4, float("inf"), 1.0), (5, 5.0, 5.0), (5, 5.0, 5.0), (None, 0.0, 0.1)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    got = M.spectral_points(df, ["x", "y"], "id", 2).collect()
    assert len(got) == 7
    assert {r.id for r in got if r.label == -1} == {2, 3, 4}
    by = {r.id: r.label for r in got}
    assert by[1] == by[None] != by[5]
    assert M.spectral_points(df.limit(0), ["x", "y"], "id", 2).count() == 0
    same = spark.createDataFrame([(k, 1.0, 1.0) for k in range(4)], "id long, x double, y double")
    assert {r.label for r in M.spectral_points(same, ["x", "y"], "id", 2).collect()} == {0}


def test_consensus(spark):
    rows = [(k, k % 3, k % 3, k % 3) for k in range(30)]
    alone = spark.createDataFrame(rows, "id long, km long, db long, sp long")
    got = M.consensus_clusters(alone, ["km", "db", "sp"], "id", 3).collect()
    assert rand_index(spark, [(r.label, r.id % 3) for r in got]) == 1.0
    rows = [(k, k % 3, k % 3 if k > 5 else -1, k % 3 if k > 9 else 0) for k in range(60)]
    mixed = spark.createDataFrame(rows, "id long, km long, db long, sp long")
    got = M.consensus_clusters(mixed, ["km", "db", "sp"], "id", 2).collect()
    assert len(got) == 60 and all(r.label >= 0 for r in got)


def test_consensus_query_covers_every_symbol(spark, sf):
    queries = load()[0]
    got = queries["m09_consensus_clusters"](spark, sf).collect()
    want = queries["m07b_spectral_points"](spark, sf).collect()
    assert sorted(r.id for r in got) == sorted(r.id for r in want) and all(r.label >= 0 for r in got)
