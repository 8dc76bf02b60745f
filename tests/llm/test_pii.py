"""Personal data: base spans against plain expressions, looser spans, odd rows, a plan without Python."""

import hashlib
import random
import re

from tidemark.llm import pii
from tidemark.llm.queries import op2_pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in value.split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits or "0"), "phone": 10 <= len(digits) <= 15}[kind]


def plain(text):
    found = [(m.start(), k, m.end()) for k, kind in enumerate(PLAIN) for m in re.finditer(PLAIN[kind], text or "") if passes(kind, m.group())]
    return [f"{list(PLAIN)[k]}:{a}:{b}" for a, k, b in sorted(found)]


def check(rows, texts):
    for r in rows:
        want = plain(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (r.doc_id, want, r.spans)
        assert [getattr(r, f"n_{k}") for k in PLAIN] == [sum(w.startswith(k + ":") for w in want) for k in PLAIN]
        assert set(want) <= set(r.spans.split(",")) or not want


def test_query_equals_plain_expressions(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op2_pii(spark, sf).collect()
    assert len(rows) == len(texts)
    check(rows, texts)


def test_random_texts_and_odd_rows(spark):
    draw = random.Random(5)
    parts = ["a", "Z9", "@", ".", "..", "-", "+", " ", "1", "12", "255", "256", "0001", "4111 1111 1111 1111", "(495) 555-0100", "é", "\n", "b@c.de", "\U0001F600", "_", "+7 495 123-45-67", "10.0.0.1"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(40))) for _ in range(400)]
    texts += [None, "", "9" * 50_000, "a." * 50_000, "x" * 50_000 + "@", "1.2.3.4 " * 5_000, "+1" + "-" * 50_000]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, row int")
    from tidemark.llm.queries import pii_digests

    rows = pii_digests(pii.personal(docs)).collect()
    assert len(rows) == len(texts)
    check(rows, dict(enumerate(texts)))
    twice = spark.createDataFrame([(None, "a@b.cd", 1), (None, "a@b.cd", 1)], docs.schema)
    assert [r.spans for r in pii_digests(pii.personal(twice)).collect()] == ["email:0:6"] * 2
    assert pii.personal(docs.limit(0)).count() == 0


def test_spans_stay_with_their_documents_when_a_later_scan_is_cut_anew(spark, tmp_path):
    texts = {k: "x" * (k % 7) + f" a{k}@b.cd" for k in range(400)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(8).write.parquet(str(tmp_path / "docs"))
    from tidemark.llm.queries import pii_digests

    cut = {"spark.sql.files.openCostInBytes": ("64m", "0"), "spark.sql.files.minPartitionNum": ("8", "1")}
    before = {name: spark.conf.get(name, None) for name in cut}
    try:
        for name, (first, _) in cut.items():
            spark.conf.set(name, first)
        docs = spark.read.parquet(str(tmp_path / "docs"))
        assert docs.rdd.getNumPartitions() > 1
        out = pii_digests(pii.personal(docs))
        for name, (_, second) in cut.items():
            spark.conf.set(name, second)
        assert spark.read.parquet(str(tmp_path / "docs")).rdd.getNumPartitions() == 1
        rows = out.collect()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    assert len(rows) == len(texts)
    check(rows, texts)


def test_looser_spans_are_learnt(spark):
    rows = [(k, f"call +1 ({100 + k}) 555-{1000 + k}, order {k:03d}.{k}.999.{300 + k} ref {4000 + k} {5000 + k} {6000 + k} {7000 + k} end") for k in range(300)]
    rows += [(1000, "call (212) 555-1234, thanks")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    from tidemark.llm.queries import pii_digests

    got = {r.doc_id: r for r in pii_digests(pii.personal(docs)).collect()}
    assert got[1000].spans == "phone:5:19" and got[1000].n_phone == 0
    plan = pii.personal(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
