"""Source mixing: targets against a plain sharing loop, words near them, whole copies, odd rows."""

import re

from tidemark.llm import mixing
from tidemark.llm.queries import op3_source_mix


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full = {}
    while True:
        free = [s for s in names if s not in full]
        left, w = sum(sizes.values()) - sum(full.values()), sum(weight[s] for s in free)
        out = {s: left * weight[s] / w for s in free}
        over = {s: 3.0 * sizes[s] for s in free if out[s] > 3 * sizes[s]}
        if not over:
            return out | full
        full |= over


def check(rows, sources, texts):
    words = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in texts.items()}
    sizes = {}
    for k, s in sources.items():
        sizes[s] = sizes.get(s, 0) + words[k]
    want, taken = plain_targets(sizes), dict.fromkeys(sizes, 0)
    for r in rows:
        s = sources[r.doc_id]
        assert r.size == words[r.doc_id] and r.source_size == sizes[s] and abs(r.target - want[s]) <= 1e-6 * max(1, want[s])
        assert 0 <= r.taken <= 3 * r.size and (r.taken == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    return {s: (taken[s], want[s]) for s in sizes}


def test_query_meets_targets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = op3_source_mix(spark, sf).collect()
    assert len(rows) == len(docs)
    for got, want in check(rows, {d.doc_id: d.source for d in docs}, {d.doc_id: d.text for d in docs}).values():
        assert abs(got - want) <= max(2, 0.02 * want)
    assert sorted(rows) == sorted(op3_source_mix(spark, sf).collect())


def test_rates_are_the_tilted_ones(spark):
    docs = spark.createDataFrame([(k, "w " * (1 + k % 7), "ab"[k % 2]) for k in range(200)], "doc_id long, text string, source string")
    rows = mixing.mix(docs).collect()
    for s in "ab":
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.rate * r.size for r in own) - own[0].target) < 1e-4 * own[0].target
        assert len({(r.size, r.rate) for r in own}) == 7


def test_odd_rows(spark):
    rows = [(1, None, "a", 1), (2, "", None, 1), (None, "x y z", None, 1), (4, "x " * 9, "\U0001F600", 1), (4, "x " * 9, "\U0001F600", 1), (5, "y " * 30_000, "￮", 2), (6, "one two", "a", 3), (7, "b", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix(docs).collect()
    assert len(got) == 8 and all(0 <= r.copies <= 3 for r in got)
    assert {r.source_size for r in got if r.source is None} == {3}
    want = plain_targets({"a": 2, "b": 1, "￮": 30_000, "\U0001F600": 18, None: 3})
    assert all(abs(r.target - want[r.source]) < 1e-6 * want[r.source] for r in got)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r.copies for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed(docs.where("false")).count() == 0
    blank = spark.createDataFrame([(1, "", "a"), (2, None, "b")], "doc_id long, text string, source string")
    assert [(r.target, r.copies) for r in mixing.mix(blank).collect()] == [(0.0, 1), (0.0, 1)]
