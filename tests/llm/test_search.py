"""Exact top-k against brute force; recall and exact scores of the permutation index; odd rows."""

import numpy as np
import pytest

from tidemark.llm import permutation, topk
from tidemark.llm.queries import op4_exact_topk, op5_permutation_ann

INF, NAN = float("inf"), float("nan")


def vectors_of(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    return np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)


def ranked(ids, scores, own, k):
    order = [i for i in np.lexsort((ids, -scores)) if ids[i] != own][:k]
    return [(int(ids[i]), scores[i]) for i in order]


@pytest.mark.parametrize("block", [8192, 64])
def test_top_k_equals_brute_force(spark, sf, block):
    ids, x = vectors_of(spark, sf)
    x = np.floor(256 * x).astype(np.int64)
    got = (op4_exact_topk(spark, sf) if block == 8192 else topk.top_k(spark.read.parquet(f"{sf}/embeddings.parquet"), block=block)).collect()
    want = [(int(ids[q]), r + 1, i, int(s)) for q in np.flatnonzero(ids % 50 == 0) for r, (i, s) in enumerate(ranked(ids, x @ x[q], ids[q], 5))]
    assert sorted(map(tuple, got)) == sorted(want)


def test_bounds_stop_early_and_keep_ties():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(3000, 64)) / 8
    x[100:140] = x[100]
    lists = topk.Lists(np.arange(3000), x, 5)
    whole = topk.whole(x).astype(np.int64)
    for q, ids, scores in lists(np.arange(0, 3000, 50), x[::50]):
        want = ranked(np.arange(3000), whole @ whole[q], q, 5)
        order = np.lexsort((ids, -scores))[:5]
        assert [(int(ids[i]), int(scores[i])) for i in order] == [(i, int(s)) for i, s in want]


@pytest.mark.parametrize("block", [8192, 600])
def test_permutation_index_recall(spark, block):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(6000, 64)) * draw.uniform(0.5, 1.5, (6000, 1))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    hit = total = 0
    rows = permutation.nearest(frame, every=100, block=block).collect()
    found = {}
    for r in rows:
        found.setdefault(r.query_id, []).append(r)
    for q in range(0, 6000, 100):
        own = sorted(found[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21)) and [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        assert all(abs(r.score - x[q] @ x[r.vec_id]) < 1e-9 for r in own)
        hit += len({r.vec_id for r in own} & {i for i, _ in ranked(np.arange(6000), x @ x[q], q, 20)})
        total += 20
    assert hit >= 0.9 * total


@pytest.mark.parametrize("block", [8192, 600])
def test_recall_with_a_third_equal(spark, block):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(6000, 64)) * draw.uniform(0.5, 1.5, (6000, 1))
    same = draw.permutation(6000)[:2000]
    x[same] = x[same[0]]
    x[same, 0] = 0.0
    x[same[::2], 0] = -0.0
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in permutation.nearest(frame, every=100, block=block).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hit = {True: [], False: []}
    for q in range(0, 6000, 100):
        # scores of one vector differ in no bit here, so ties go by id
        scores = np.array([float(np.dot(v, x[q])) for v in x])
        hit[q in same].append(len(found[q] & {i for i, _ in ranked(np.arange(6000), scores, q, 20)}) / 20)
    assert hit[True] and np.mean(hit[True]) >= 0.99 and np.mean(hit[False]) >= 0.9, {k: np.mean(v) for k, v in hit.items()}


def test_query_recall(spark, sf):
    ids, x = vectors_of(spark, sf)
    found = {}
    for r in op5_permutation_ann(spark, sf).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    want = {int(ids[q]): {i for i, _ in ranked(ids, x @ x[q], ids[q], 20)} for q in np.flatnonzero(ids % 20 == 0)}
    assert set(found) == set(want) and sum(len(found[q] & want[q]) for q in want) >= 0.9 * 20 * len(want)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0], 1), (1, None, 1), (2, [NAN, 1.0], 2), (3, [1.0, None], 3), (4, [INF, 0.0], 4), (5, [0.0, 0.0], 5), (6, [1.0], 6), (6, [1.0], 6), (None, [1.0, 1.0], 7), (100, [1.0, 2.0], 8), (7, [1e300, 0.0], 9), (8, [], 10)]
    frame = spark.createDataFrame(rows[:-2], "vec_id long, embedding array<double>, score long")
    exact = sorted(map(tuple, topk.top_k(frame).collect()))
    assert exact == [(0, 1, 100, 327680), (0, 2, 6, 65536), (0, 3, 6, 65536), (0, 4, 5, 0), (100, 1, 0, 327680), (100, 2, 6, 65536), (100, 3, 6, 65536), (100, 4, 5, 0)]
    near = sorted(map(tuple, permutation.nearest(frame).collect()))
    assert near == [(0, 1, 100, 5.0), (0, 2, 6, 1.0), (0, 3, 6, 1.0), (100, 1, 0, 5.0), (100, 2, 6, 1.0), (100, 3, 6, 1.0)]
    more = spark.createDataFrame(rows, frame.schema)
    assert topk.top_k(more).count() == 10 and topk.top_k(frame.limit(0)).count() == 0 and permutation.nearest(frame.limit(0)).count() == 0


def test_large_components_are_exact(spark):
    draw = np.random.default_rng(6)
    x = draw.integers(-10**6, 10**6, (300, 8)).astype(float) / 4
    x[:40] *= draw.choice([1.0, 1e6, 1e12], (40, 8))
    x[40:60] = x[40]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    whole = [[int(np.floor(256 * v)) for v in row] for row in x]
    limit = (1 << 63) - 1
    got = sorted(map(tuple, topk.top_k(frame, every=10, block=64).collect()))
    want = []
    for q in range(0, 300, 10):
        scores = sorted((-max(-limit - 1, min(limit, sum(a * b for a, b in zip(whole[q], whole[i])))), i) for i in range(300) if i != q)[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    assert got == sorted(want)


def test_query_recall_on_more_vectors(spark):
    sf = "/root/testdata/sf0.1"
    ids, x = vectors_of(spark, sf)
    found = {}
    for r in op5_permutation_ann(spark, sf).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    want = {int(ids[q]): {i for i, _ in ranked(ids, x @ x[q], ids[q], 20)} for q in np.flatnonzero(ids % 20 == 0)}
    assert sum(len(found[q] & want[q]) for q in want) >= 0.95 * 20 * len(want)
