"""Token counts per section against decoding the tokens one by one."""

import re

import public_tokenizers as P

from tidemark.llm import bpe, token_counts
from tidemark.llm.queries import RANKS, op8_token_counts

PATH = P.path(RANKS)


def plain(enc, text, rule):
    """Sections (start, end, tokens, crossing) of lines, each token's characters found by growing the text."""
    bounds, at = [], 0
    for line in re.findall("[^\n]*\n|[^\n]+", text):
        bounds.append((at, at + len(line)))
        at += len(line)
    bounds = bounds or [(0, len(text))]
    tokens, over = [0] * len(bounds), [0] * len(bounds)
    data, pos = text.encode(), 0
    for piece in enc.decode_tokens_bytes(enc.encode_ordinary(text)):
        a, b = (sum(x & 0xC0 != 0x80 for x in data[:n]) - 1 for n in (pos + 1, pos + len(piece)))
        own = [next(k for k, (s, e) in enumerate(bounds) if s <= c < e) for c in (a, b)]
        if rule == "share" and own[0] != own[1]:
            for k in range(own[0], own[1] + 1):
                tokens[k] += (min(bounds[k][1], b + 1) - max(bounds[k][0], a)) / (b + 1 - a)
        else:
            tokens[own[rule == "last"]] += 1
        over[own[rule == "last"]] += own[0] != own[1]
        pos += len(piece)
    return [(k, s, e, t, o) for k, ((s, e), t, o) in enumerate(zip(bounds, tokens, over))]


def library():
    with open(PATH, "rb") as f:
        return bpe.encoder(f.read(), P.PATTERN)


def test_query_equals_brute_force_on_small_texts_and_totals_on_all(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    enc, got = library(), {}
    for r in op8_token_counts(spark, sf).collect():
        got.setdefault(r.doc_id, []).append((r.section, r.start, r.end, r.n_tokens, r.n_crossing))
    assert set(got) == set(docs)
    for k, t in docs.items():
        assert sum(x[3] for x in got[k]) == len(enc.encode_ordinary(t))
        if len(t) < 600:
            assert sorted(got[k]) == plain(enc, t, "first")


def test_rules_and_odd_rows(spark):
    texts = [None, "", "\n\n\n a\n", "日本\n\n\n語", "x" * 5, "a \n\n \nb", "line\n" * 50_000]
    docs = spark.createDataFrame([(None if k == 4 else k, t, k) for k, t in enumerate(texts)] + [(1, "", 1)], "doc_id long, text string, section int")
    enc = library()
    for rule in token_counts.RULES:
        got = token_counts.section_counts(docs, PATH, P.PATTERN, rule=rule).collect()
        for k, t in enumerate(texts[:6]):
            own = sorted(tuple(r)[1:] for r in got if r.doc_id == (None if k == 4 else k))
            want = plain(enc, t or "", rule)
            own = sorted(set(own))
            assert [x[:3] + x[4:] for x in own] == [x[:3] + x[4:] for x in want]
            assert all(abs(a[3] - b[3]) < 1e-9 for a, b in zip(own, want))
        assert sum(r.doc_id == 6 for r in got) == 50_000
    assert token_counts.section_counts(docs.limit(0), PATH, P.PATTERN).count() == 0
