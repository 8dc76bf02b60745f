"""Quality classifier by positive-unlabelled learning.

Features describe the form of the whole text: how often one class of byte follows another, word and line
repetition, lengths. A logistic scorer minimises the non-negative unbiased risk: the loss of trusted positives as
positive, weighted by the class prior, plus the loss of unlabelled texts as negative less the share of it that
positives explain, kept from going below zero. The prior is the share of good texts among the labels it may see.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import text_batches, text_of, written
from tidemark.plans.sums import summed

#: Bound of the labelled positives that the scorer is fitted on, taken by the hash of the key.
POSITIVES = 8_000
#: Newton steps at most, and the length of a step (largest change of a weight) under which they end.
STEPS = 25
NEAR = 1e-3
#: Ridge of the weights, spread over the positives: the fewer there are, the closer the weights stay to zero. Chosen
#: between two folds of the visible labels, without the held-out one.
RIDGE = 20.0
#: Bytes that are taken apart at a time; results do not depend on it.
BLOCK = 1 << 20

#: Classes of a byte, in order; the last two are control bytes and bytes of non-ASCII characters.
CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".,;:", b"!?", b"|", b"#$%&*~^@", b"()[]{}<>", b"'\"`-_/\\+=")
KINDS = len(CLASSES) + 2


def byte_classes() -> np.ndarray:
    out = np.full(256, KINDS - 2, np.uint8)
    out[128:] = KINDS - 1
    for k, members in enumerate(CLASSES):
        out[list(members)] = k
    return out


WIDTH = KINDS * KINDS + 8
SPACE = re.compile(rb"[ \t-\r]")


def _pieces(text: bytes, block: int) -> Iterator[bytes]:
    """``text`` cut at white space, about ``block`` bytes at a time, so that no word is cut."""
    at = 0
    while len(text) - at > block:
        cut = SPACE.search(text, at + block)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def features(text: bytes, classes: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Numbers between 0 and about 2 for a whole text; words and lines are counted over all of it."""
    pairs, words, repeats, last, known = np.zeros(KINDS * KINDS), 0, 0, None, set()
    for at in range(0, len(text), block):
        c = classes[np.frombuffer(text[at : at + block + 1], np.uint8)].astype(np.int16)
        pairs += np.bincount(c[:-1] * KINDS + c[1:], minlength=KINDS * KINDS)
    for part in _pieces(text, block):
        w = part.split()
        if w:
            words += len(w)
            repeats += sum(map(eq, w, w[1:])) + (w[0] == last)
            last = w[-1]
            known.update(w)
    rows = text.split(b"\n") if text else []
    few = max(1, words)
    more = [np.log1p(len(text)) / 10, np.log1p(words) / 10, len(known) / few, repeats / few, len(text) / few / 20, len(set(rows)) / max(1, len(rows)), np.log1p(few / max(1, len(rows))) / 5, float(words < 5)]
    return np.r_[np.sqrt(pairs / max(1.0, pairs.sum())), more]


def described(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` and ``x``, the features of every row as 32-bit floats, written once."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = byte_classes()
        for batch in batches:
            rows = [features(t, classes).astype(np.float32).tobytes() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], [key, "x"])

    kind = docs.schema[key].dataType.simpleString()
    return written(docs.select(key, text_of(text).alias("_text")).mapInArrow(run, f"`{key}` {kind}, x binary"))


def _rows(x) -> np.ndarray:
    return np.frombuffer(b"".join(x), np.float32).reshape(-1, WIDTH).astype(float)


def unlabelled_terms(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Summed over rows ``x``: loss as negative, its slope and its curvature by the weights, offset last."""
    x = np.c_[x, np.ones(len(x))]
    s = x @ w
    p = _sigmoid(s)
    return np.r_[np.logaddexp(0, s).sum(), x.T @ p, ((x * (p * (1 - p))[:, None]).T @ x).ravel()]


def non_negative_fit(positive: np.ndarray, unlabelled, n: float, prior: float, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and offset of the logistic scorer by Newton steps from zero on the unbiased risk, which is convex for
    this loss; ``unlabelled(w)`` returns the sums of ``unlabelled_terms`` over all ``n`` unlabelled rows.

    A step after which the risk is higher, or the part of the unlabelled loss that positives do not explain is below
    zero, is halved; the fit ends where no step is left, so that part never turns negative.
    """
    p = np.c_[positive, np.ones(len(positive))]
    size, held = p.shape[1], np.r_[np.full(p.shape[1] - 1, RIDGE / len(p)), 0.0]

    def at(w: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
        sums, s = unlabelled(w) / n, p @ w
        rest = sums[0] - prior * np.mean(np.logaddexp(0, s))
        risk = prior * np.mean(np.logaddexp(0, -s)) + rest + held @ (w * w) / 2
        # as positive less as negative, the loss of a positive is minus its score
        return risk, rest, sums[1 : size + 1] - prior * p.mean(0) + held * w, sums[size + 1 :].reshape(size, size) + np.diag(held + 1e-6)

    w = np.zeros(size)
    risk, _, slope, curve = at(w)
    move = -np.linalg.solve(curve, slope)
    for _ in range(steps):
        if np.abs(move).max() < NEAR:
            break
        new = at(w + move)
        if new[1] < 0 or new[0] > risk + 1e-9:
            move = move / 2
            continue
        w = w + move
        risk, _, slope, curve = new
        move = -np.linalg.solve(curve, slope)
    return w[:-1], float(w[-1])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def train(found: DataFrame, positives: DataFrame, prior: float, key: str = "doc_id", most: int = POSITIVES) -> dict | None:
    """A model from rows of ``found`` (``described``) whose key is in ``positives`` (trusted) against all of ``found`` as
    unlabelled text.

    Positives are sampled by the hash of the key down to ``most`` rows; means, spreads and the unlabelled part of the
    risk are sums over every row, one pass a step. None without positives or documents.
    """
    few = positives.select(key).where(F.col(key).isNotNull()).distinct().orderBy(F.xxhash64(F.lit(1), F.col(key)), key).limit(most)
    rows = found.join(F.broadcast(few), key, "left_semi").orderBy(F.xxhash64(F.lit(1), F.col(key)), key, "x").limit(most).select("x").collect()
    if not rows:
        return None
    p = _rows([r.x for r in rows])
    vectors = found.select("x")
    sums = summed(vectors, lambda pdf: np.r_[len(pdf), (x := _rows(pdf["x"])).sum(0), (x * x).sum(0)], 2 * WIDTH + 1)
    n, mean = sums[0], sums[1 : WIDTH + 1] / sums[0]
    # rounded, as sums of floats depend on the order of tasks
    mean, spread = mean.round(9), (np.sqrt(np.maximum(sums[WIDTH + 1 :] / n - mean * mean, 0)) + 1e-3).round(9)

    def unlabelled(w: np.ndarray) -> np.ndarray:
        return summed(vectors, lambda pdf: unlabelled_terms((_rows(pdf["x"]) - mean) / spread, w), 1 + (WIDTH + 1) + (WIDTH + 1) ** 2)

    w, b = non_negative_fit((p - mean) / spread, unlabelled, n, prior)
    w, b = w.round(6), round(b, 6)
    return {"weights": w / spread, "offset": float(b - (w * mean / spread).sum())}


def score(found: DataFrame, model: dict | None, key: str = "doc_id") -> DataFrame:
    """``key`` and ``score`` in [0, 1] for every row of ``found`` (``described``); without a model 0.5."""
    if model is None:
        return found.select(key, F.lit(0.5).alias("score"))
    weights, offset = model["weights"], model["offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_sigmoid(x @ weights + offset))], [key, "score"])

    kind = found.schema[key].dataType.simpleString()
    return found.select(key, "x").mapInArrow(run, f"`{key}` {kind}, score double")


def is_held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fitted(found: DataFrame, labels: DataFrame, key: str = "doc_id") -> dict | None:
    """The model learnt from labels outside the held-out third and all texts; a document with both labels counts as good."""
    seen = labels.where(~is_held_out(key) & F.col("quality").isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max("quality").alias("quality"))
    total, good = seen.agg(F.count("*"), F.count_if(F.col("quality") == 1)).first()
    prior = min(0.99, max(0.01, (good + 1) / (total + 2)))
    return train(found, seen.where("quality = 1"), prior, key)


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``held_out``, ``score``, ``predicted`` for every row of ``docs``.

    Null text counts as empty and is scored like any other; null keys are never learnt from as positives; repeated
    rows score alike; without usable labels every score is 0.5; an empty table gives no rows. Other columns are not read.
    """
    found = described(docs, key, text)
    scored = score(found, fitted(found, labels, key), key)
    return scored.select(key, is_held_out(key).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def good_ones(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least 0.5, scored beside their other columns."""
    model = fitted(described(docs, key, text), labels, key)
    if model is None:
        return docs
    text_batches(docs.sparkSession)
    weights, offset, at = model["weights"], model["offset"], docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = byte_classes()
        for batch in batches:
            x = np.array([features(t or b"", classes).astype(np.float32) for t in batch.column(at).cast(pa.binary()).to_pylist()])
            yield batch.filter(pa.array(_sigmoid(x.astype(float) @ weights + offset) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
