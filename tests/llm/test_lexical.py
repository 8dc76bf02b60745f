"""Lexical search against brute force by the definition, and the tree's bounds and pruning."""

import math
import re
from collections import Counter

import numpy as np

from tidemark.llm import lexical
from tidemark.llm.queries import op11_lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def plain(docs, items, k=20):
    bags = [(key, plain_terms(text)) for key, text in docs]
    n, length = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    df = Counter(t for _, b in bags for t in set(b))
    out = []
    for item, text in items:
        asked = Counter(plain_terms(text))
        scores = []
        for key, bag in bags:
            tfs, m = Counter(bag), 75 + 25 * len(bag) * n // length if length else 0
            score = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tfs[t] // (1000 * tfs[t] + 12 * m)) for t, c in asked.items() if t in tfs)
            if score > 0 and key is not None:
                scores.append((-score, key))
        out += [(item, r + 1, key, -s) for r, (s, key) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def test_query_equals_brute_force(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    got = sorted(map(tuple, op11_lexical_search(spark, sf).collect()))
    assert got == plain([(d.doc_id, d.text) for d in docs], [(i.item_id, i.text) for i in items])


def test_blocks_and_turns_give_the_same(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    assert sorted(map(tuple, lexical.rank(docs, items, block=70, asked=2000).collect())) == sorted(map(tuple, op11_lexical_search(spark, sf).collect()))


def test_odd_rows(spark):
    rows = [(1, "Cat dog", 1), (1, "Cat dog", 1), (2, None, 2), (3, "", 3), (4, " .,;", 4), (None, "cat cat", 5), (5, "CAT É é naïve", 6), (6, "cat " * 50_000, 7), (7, "bird", 8), (8, "dog", 9), (9, "dog", 9)]
    asked = [(10, "cat dog cat"), (11, None), (12, "!!"), (13, "É"), (None, "bird"), (14, "unseen"), (15, "dog"), (15, "cat")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    items = spark.createDataFrame(asked, "item_id long, text string")
    wanted = [a for a in asked if a != (15, "dog")]
    for k in (1, 3, 20):
        got = sorted(map(tuple, lexical.rank(docs, items, k).collect()), key=str)
        assert got == sorted(plain([r[:2] for r in rows], [(i, t) for i, t in wanted if i is not None], k) + plain_null(rows, k), key=str)
    assert lexical.rank(docs.limit(0), items).count() == 0 and lexical.rank(docs, items.limit(0)).count() == 0


def plain_null(rows, k):
    return [(None, *r[1:]) for r in plain([r[:2] for r in rows], [(0, "bird")], k)]


def test_bounds_hold_and_prune():
    draw = np.random.default_rng(4)
    x = draw.integers(0, 10**9, (5000, 40)) * (draw.random((5000, 40)) < 0.1)
    x[:30] = draw.integers(5 * 10**8, 10**9, (30, 40))
    x[100:1500] = x[100]
    asked = draw.integers(0, 3, (5, 40))
    tree, ids = lexical.Tree(x), draw.permutation(5000)
    bounds = tree.bounds(asked)
    for node in range(len(tree.radius)):
        own = x[tree.order[tree.first[node] : tree.end[node]]] @ asked.T
        assert len(own) and (own.max(0) <= bounds[:, node]).all()
    best = [lexical.Best(20) for _ in asked]
    scored = lexical.search(tree, ids, asked, best)
    for q, top in zip(asked, best):
        order = np.lexsort((ids, -(x @ q)))[:20]
        assert top.ids.tolist() == ids[order].tolist() and top.scores.tolist() == (x @ q)[order].tolist()
    assert scored < 5 * (5000 / 64) / 2
