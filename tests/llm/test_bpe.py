"""Byte-level BPE against the library, and exact round trips."""

import hashlib
import random

import public_tokenizers as P

from tidemark.llm import bpe
from tidemark.llm.queries import RANKS, op10_byte_bpe

PATH = P.path(RANKS)


def library():
    with open(PATH, "rb") as f:
        return bpe.encoder(f.read(), P.PATTERN)


def test_query_equals_the_library(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    enc = library()
    got = op10_byte_bpe(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = enc.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_chunks_meet_again_in_odd_texts(spark):
    draw = random.Random(1)
    parts = ["don't", " ", "\n\n", "\n", "   ", "été", "日本語", "👩‍👩‍👧", "12", "x" * 90, "!!", "'re", "'", " a", "\t", "　"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(400))) for _ in range(60)]
    texts += ["x" * 700, " " * 700, "\n" * 300 + "x" * 300, "a" * 63 + " b" * 300, None, "", "<|endoftext|>" * 30]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    enc = library()
    for chunk, overlap in ((64, 20), (128, 40)):
        got = {r.doc_id: r.ids for r in bpe.encode(docs, PATH, P.PATTERN, chunk=chunk, overlap=overlap).collect()}
        assert got == {k: enc.encode_ordinary(t or "") for k, t in enumerate(texts)}


def test_odd_rows_and_clashing_columns(spark):
    long = "lorem ipsum, dolor " * 9_000
    rows = [(None, "abc", 1, "x"), (None, None, 2, "y"), (7, long, 3, None), (7, long, 3, None)]
    docs = spark.createDataFrame(rows, "key long, text string, ids int, row string")
    out = bpe.decode(bpe.encode(docs, PATH, P.PATTERN), PATH)
    assert out.columns == ["key", "row", "ids", "decoded"]
    got = sorted(((r.key, r.row, bytes(r.decoded).decode()) for r in out.collect()), key=str)
    assert got == sorted([(None, "x", "abc"), (None, "y", ""), (7, None, long), (7, None, long)], key=str)
    assert bpe.encode(docs.limit(0), PATH, P.PATTERN).count() == 0
