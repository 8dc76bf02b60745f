"""Cross-tokenizer alignment against brute force with the tokenizers' own libraries."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from tidemark.llm import alignment
from tidemark.llm.queries import op13_cross_tokenizer

A, B = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def plain_groups(a, b):
    """a, b: (id, start, end); lists of (A ids, B ids) between common ends."""
    out, i, j = [], 0, 0
    for e in sorted({x[2] for x in a} & {x[2] for x in b}):
        own = ([], [])
        while i < len(a) and a[i][2] <= e:
            own[0].append(a[i][0])
            i += 1
        while j < len(b) and b[j][2] <= e:
            own[1].append(b[j][0])
            j += 1
        out.append(own)
    return out


def spans(ids, tokens):
    out, at = [], 0
    for i in ids:
        out.append((i, at, at + len(tokens[i])))
        at += len(tokens[i])
    return out


def plain(texts):
    """Figures of each text, by the definition."""
    one, two = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    byte_of = alignment.byte_level()
    token_a = {i: bytes(byte_of.get(c, 0) for c in t) for t, i in one.get_vocab().items()}
    token_b = {i: bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in range(two.get_piece_size())}
    docs, counts = [], Counter()
    for t in texts:
        groups = []
        if t:
            a, b = one.encode(" " + t, add_special_tokens=False).ids, two.encode(t)
            if b"".join(token_a[i] for i in a) == b"".join(token_b[i] for i in b) == (" " + t).encode():
                groups = plain_groups(spans(a, token_a), spans(b, token_b))
        links = Counter((i, j) for x, y in groups for i in x for j in y)
        counts.update(set(links))
        docs.append((groups, links))
    most = {}
    for (i, _), c in counts.items():
        most[i] = max(c, most.get(i, 0))
    out = []
    for groups, links in docs:
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        best = sum(n for p, n in links.items() if counts[p] == most[p[0]])
        total = sum(n * counts[p] for p, n in links.items())
        out.append((sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(links.values()), best, total, hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return out


def test_query_equals_brute_force(spark, sf):
    docs = [d for d in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in op13_cross_tokenizer(spark, sf).collect()}
    want = plain([d.text for d in docs])
    assert [got[d.doc_id] for d in docs] == want and len(got) == len(docs) and sum(w[0] > 0 for w in want) > 100


def test_odd_rows(spark):
    draw = random.Random(5)
    odd = "".join(chr(draw.choice([draw.randrange(32, 127), draw.randrange(0xA0, 0x2000), draw.randrange(0x4E00, 0x9FFF), draw.randrange(0x1F300, 0x1F700), 10, 32])) for _ in range(4000))
    texts = [None, "", " ", "a", "a  b\n\n\tc", "▁ x", "<|endoftext|> </s> <0x41>", "ﬁ ﬀ Å", "naïve café 日本語 🙂🙂", odd, "x" * 5000, "word " * 30_000, "same words", "same words", " " * 700 + "z", "é" * 300]
    rows = [(k if k != 4 else None, t, 7) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int")
    for dealt in (1 << 18, 3):
        got = alignment.align(docs, A, B, dealt=dealt).collect()
        assert sorted((str(r.doc_id), *(r[c] for c in COLUMNS)) for r in got) == sorted((str(r[0]), *w) for r, w in zip(rows, plain(texts)))
    assert alignment.align(docs.limit(0), A, B).count() == 0
    twice = docs.where("doc_id = 13")
    assert [r.count_sum for r in alignment.align(twice.union(twice), A, B).collect()] == [4, 4]


def test_groups_of_long_chains():
    draw = random.Random(8)
    for _ in range(200):
        size = draw.randrange(1, 60)
        cuts = [sorted({size, *(draw.randrange(1, size + 1) for _ in range(draw.randrange(1, 40)))}) for _ in range(2)]
        label_a, label_b, to_a, to_b = alignment.groups_of(*(np.array(c) for c in cuts))
        ends = sorted(set(cuts[0]) & set(cuts[1]))
        assert label_a.tolist() == [sum(e < c for e in ends) for c in cuts[0]] and label_b.tolist() == [sum(e < c for e in ends) for c in cuts[1]]
        assert to_a.tolist() == [sum(c <= e for c in cuts[0]) for e in ends] and to_b.tolist() == [sum(c <= e for c in cuts[1]) for e in ends]
    # one end in common: odd offsets against even ones
    label_a, label_b, to_a, _ = alignment.groups_of(np.r_[np.arange(1, 4001, 2), 4001], np.r_[np.arange(2, 4001, 2), 4001])
    assert not label_a.any() and not label_b.any() and len(to_a) == 1


def test_large_groups_count_links_like_small_ones(monkeypatch):
    draw = np.random.default_rng(1)
    ids_a, ids_b = draw.integers(0, 9, 60), draw.integers(0, 9, 50)
    to_a, to_b, doc = np.array([20, 30, 60]), np.array([1, 30, 50]), np.array([0, 0, 1])
    whole = alignment.linked(ids_a, ids_b, to_a, to_b, doc)
    monkeypatch.setattr(alignment, "LARGE", 1 << 30)
    assert all(np.array_equal(x, y) for x, y in zip(whole, alignment.linked(ids_a, ids_b, to_a, to_b, doc)))
