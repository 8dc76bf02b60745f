"""SimHash fingerprints and components against brute force."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash
from tidemark.llm.queries import op7_simhash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(items):
    """items: (key, fingerprint); smallest key reachable over distances of two or less, for each item."""
    root = list(range(len(items)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if (items[i][1] ^ items[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(items):
        least[find(i)] = min(k, least.get(find(i), k))
    return [least[find(i)] for i in range(len(items))]


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    items = sorted((d.doc_id, plain_fingerprint(d.text)) for d in docs)
    want = [(k, f"{f:016x}", c) for (k, f), c in zip(items, plain_components(items))]
    assert sorted(map(tuple, op7_simhash(spark, sf).collect())) == want


def test_hash_is_the_engine_s_own(spark):
    text = "Éa b\tc  D"
    row = spark.createDataFrame([(text,)], "t string").select(F.xxhash64(F.lit("Éa b c")).alias("x"), F.xxhash64(F.lit("b c d")).alias("y")).first()
    both = [np.int64(x).view(np.uint64) for x in (row.x, row.y)]
    assert plain_fingerprint("Éa b c d") == int(both[0] & both[1]) == np.int64(simhash.fingerprint(text.encode())).view(np.uint64)


def test_links_of_dense_and_split_buckets(spark):
    draw = random.Random(3)
    values = {0, -1}
    for _ in range(12):
        centre = draw.getrandbits(64)
        for _ in range(60):
            x = centre
            for _ in range(draw.randrange(5)):
                x ^= 1 << draw.randrange(64)
            values.add(int(np.uint64(x).view(np.int64)))
    values = sorted(values)
    want = plain_components([(v, v & (1 << 64) - 1) for v in values])
    for chunk in (8192, 16):
        fps = spark.createDataFrame([(v,) for v in values], "fp long")
        roots = {r.node: r.root for r in simhash.components(simhash.links(fps, chunk=chunk)).collect()}
        least = {}
        for v in values:
            r = roots.get(v, v)
            least[r] = min(v, least.get(r, v))
        assert [least[roots.get(v, v)] for v in values] == want


def test_odd_rows(spark):
    long = "word " * 200_000
    rows = [(1, None, 5), (2, "", 5), (None, " \n", 5), (3, "a b c d", 5), (3, "a b c d", 5), (9, long, 5), (10, long + "word", 5), (None, "lonely text of some words", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=str)
    ids = {(r[0], r[2]) for r in got}
    assert len(got) == 8 and {(1, 1), (2, 1), (None, 1), (3, 3), (9, 9), (10, 9), (None, None)} == ids
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = sorted((r.doc_id for r in simhash.one_of_each(docs).collect()), key=str)
    assert kept == [1, 3, 9, None, None]


def test_one_of_each_keeps_rows_of_repeated_keys_apart(spark):
    a, b, c = "one text of a few words here", "quite another text that nothing resembles", "a third one of its own kind"
    rows = [(1, a, 1), (2, a, 2), (2, b, 3), (3, c, 4), (3, c, 5), (4, c, 6), (None, a, 7), (None, None, 8), (5, None, 9), (6, "", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, th int")
    got = sorted(((r.doc_id, r.text) for r in simhash.one_of_each(docs).collect()), key=str)
    assert got == sorted([(1, a), (2, b), (3, c), (None, a), (None, None), (5, None)], key=str)
    assert simhash.one_of_each(docs).columns == docs.columns
