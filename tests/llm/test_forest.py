"""The LSH forest against brute force over full sets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import forest
from tidemark.llm.queries import op12_minhash_forest


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {*zip(words, words[1:])} if len(words) > 1 else {tuple(words)} if words else set()


def plain(rows):
    """rows: (key, text); (key, set size, smallest key reachable, kept) by comparing all pairs."""
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and find(i) != find(j) and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    found = [least.get(find(i)) if sets[i] else rows[i][0] for i in range(len(rows))]
    return [(k, len(s), c, k is not None and k == c) for (k, _), s, c in zip(rows, sets, found)]


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    assert sorted(map(tuple, op12_minhash_forest(spark, sf).collect())) == plain([tuple(d) for d in docs])


def edited(draw, base, share):
    return " ".join(w if draw.random() >= share else f"w{draw.randrange(10**6)}" for w in base)


@pytest.mark.parametrize("limits", [(64, 4096, 512), (2, 8, 4)])
def test_groups_of_mixed_likeness(spark, limits):
    draw = random.Random(11)
    rows = []
    for g in range(6):
        base = [f"g{g}x{draw.randrange(4000)}" for _ in range(draw.choice([40, 150, 400]))]
        for _ in range(60 if g else 250):
            rows.append((len(rows), edited(draw, base, draw.random() * 0.12)))
    shared = " ".join(f"line{i}" for i in range(12))
    rows += [(len(rows) + i, shared + " " + " ".join(f"o{draw.randrange(10**6)}" for _ in range(draw.randrange(1, 25)))) for i in range(150)]
    draw.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    small, chunk, sets = limits
    got = sorted(map(tuple, forest.near_duplicates(docs, small=small, chunk=chunk, sets=sets).collect()))
    want = sorted(plain(rows))
    lost = sum(g != w for g, w in zip(got, want))
    assert len(got) == len(want) and [g[:2] for g in got] == [w[:2] for w in want] and lost == 0, lost


def test_likeness_of_exactly_four_fifths(spark):
    words = [f"a{i}" for i in range(10)]
    one = " ".join(words)  # nine shingles; eight of ten shared with the next
    rows = [(5, one), (6, " ".join([*words[:9], "z"])), (7, "x y"), (8, "x y"), (9, "X  Y\n"), (3, " ".join(words + ["b"])), (20, "p q r s t u"), (21, "p q r s t v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, forest.near_duplicates(docs).collect())) == sorted(plain(rows))


def test_odd_rows(spark):
    long = " ".join(f"w{i % 5000}v{i % 77}" for i in range(100_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "One"), (6, "two"), (None, "one"), (None, None), (None, "no key at all"), (7, "same words here"), (7, "same words here"), (7, "other words there"), (8, "other words there"), (9, long), (10, long + " more"), (11, "É é"), (12, "é é")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int")
    assert sorted(map(tuple, forest.near_duplicates(docs).collect()), key=str) == sorted(plain(rows), key=str)
    assert forest.near_duplicates(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        forest.near_duplicates(docs, percent=50)


def test_signatures_estimate_likeness():
    draw = np.random.default_rng(2)
    for both, own in ((800, 100), (300, 300), (50, 500)):
        values = draw.integers(0, 1 << 63, both + 2 * own).astype(np.uint64)
        one, two = values[: both + own], np.r_[values[:both], values[both + own :]]
        assert abs((forest.signature(one) == forest.signature(two)).mean() - both / (both + 2 * own)) < 0.15
