"""Quality classifier: held-out accuracy, the fold of the contract, odd rows."""

import zlib

import numpy as np

from tidemark.llm import quality
from tidemark.llm.queries import op6_quality

LARGER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = op6_quality(spark, LARGER).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{LARGER}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    bad = [p for y, p in held if y == 0]
    good = [p for y, p in held if y == 1]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_labels_of_the_held_out_fold_do_not_matter(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.where(~quality.is_held_out())
    a = quality.classify(docs, labels).orderBy("doc_id").collect()
    assert a == quality.classify(docs, turned).orderBy("doc_id").collect()


def test_features_do_not_depend_on_the_block():
    classes = quality.byte_classes()
    texts = [b"", b" ", b"word", b"the the the cat\nsat sat\n\n on\tthe mat" * 7, "na\u00efve caf\u00e9 \U0001f600 ".encode() * 9, b"x" * 50, b"a\n" * 40 + b" a"]
    for t in texts:
        whole = quality.features(t, classes)
        words, rows = t.split(), t.split(b"\n") if t else []
        assert whole[-6] == len(set(words)) / max(1, len(words)) and whole[-3] == len(set(rows)) / max(1, len(rows))
        assert whole[-5] == sum(a == b for a, b in zip(words, words[1:])) / max(1, len(words))
        for block in (1, 2, 7, 64):
            assert np.array_equal(whole, quality.features(t, classes, block))


def test_risk_slope_and_curvature_against_differences():
    rng = np.random.default_rng(2)
    x, w = rng.normal(size=(40, 3)), rng.normal(size=4)
    loss = lambda v: np.sum(np.log1p(np.exp(np.c_[x, np.ones(40)] @ v)))
    got, e = quality.unlabelled_terms(x, w), np.eye(4) * 1e-4
    assert np.isclose(got[0], loss(w))
    assert np.allclose(got[1:5], [(loss(w + d) - loss(w - d)) / 2e-4 for d in e], atol=1e-5)
    want = [[(loss(w + a + b) - loss(w + a - b) - loss(w - a + b) + loss(w - a - b)) / 4e-8 for b in e] for a in e]
    assert np.allclose(got[5:].reshape(4, 4), want, atol=1e-3)


def test_fit_reaches_a_lower_risk_than_plain_descent_and_stays_non_negative():
    rng = np.random.default_rng(4)
    good, bad = rng.normal(0.8, 1, (4000, 2)), rng.normal(-0.8, 1, (1500, 2))
    p, u, prior = good[:1500], np.r_[good[1500:], bad], 2500 / 4000

    def risk(v):
        s, t = np.c_[p, np.ones(len(p))] @ v, np.c_[u, np.ones(len(u))] @ v
        rest = np.mean(np.logaddexp(0, t)) - prior * np.mean(np.logaddexp(0, s))
        return prior * np.mean(np.logaddexp(0, -s)) + rest + quality.RIDGE / len(p) * (v[:-1] @ v[:-1]) / 2, rest

    w, b = quality.non_negative_fit(p, lambda v: quality.unlabelled_terms(u, v), len(u), prior)
    v = np.zeros(3)
    for _ in range(3000):
        e = np.eye(3) * 1e-5
        v = v - 0.3 * np.array([(risk(v + d)[0] - risk(v - d)[0]) / 2e-5 for d in e])
    assert risk(np.r_[w, b])[0] <= risk(v)[0] + 1e-6 and risk(np.r_[w, b])[1] >= 0
    assert np.mean((u @ w + b > 0) == (np.arange(4000) < 2500)) > 0.8


def test_odd_rows(spark):
    long = "a fine sentence of words. " * 60_000
    rows = [(k, "Plain words in a row, and more of them.", 1) for k in range(30)] + [(None, None, 1), (40, "", 2), (41, long, 2), (41, long, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(30)] + [(None, 0, 0), (5, None, 0), (5, 0, 0), (77, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 34 and all(0 <= r.score <= 1 for r in got)
    assert quality.good_ones(docs, labels).columns == docs.columns
    assert {(r.score, r.predicted) for r in quality.classify(docs, labels.limit(0)).collect()} == {(0.5, 1)}
    assert quality.classify(docs.limit(0), labels).count() == 0
