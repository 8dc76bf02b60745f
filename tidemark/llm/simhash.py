"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint has 64 bits over the XXH64 values of a text's 3-word shingles. Two fingerprints that differ in at
most two bits agree on at least two of their four 16-bit quarters, so six tables keyed by two quarters hold every
pair within two bits. Each bucket is compared vertically: bit plane ``b`` of 64 fingerprints
is one machine word, distances of 64 lanes are counted at once by carry-save counters, and words in which all
lanes have passed the radius are abandoned. Buckets over a size limit are dealt out as pairs of chunks, so no
bucket needs one task, whatever its size. A block returns a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import row_groups, text_batches, text_of, written
from tidemark.llm.components import components

SEED = 42
WORDS = 3
RADIUS = 2
QUARTERS = 4
CHUNK = 8192
SHINGLES_AT_ONCE = 1 << 16
TILE = 1 << 16
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Signed 64-bit fingerprint of UTF-8 text: A-Z lowered, ASCII white space splits, no words give zero."""
    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    n = len(parts) - words + 1
    if n <= 1:
        return int(np.uint64(xxhash.xxh64_intdigest(joined, SEED)).view(np.int64))
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[:n], ends[words - 1 :]
    digest, seed = xxhash.xxh64_intdigest, SEED
    counts = np.zeros(64, np.int64)
    for at in range(0, n, SHINGLES_AT_ONCE):
        part = slice(at, at + SHINGLES_AT_ONCE)
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[part].tolist(), ends[part].tolist())], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``fp`` (long) for every row; null text counts as empty, repeated and null keys keep their rows."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(t) for t in batch.column(1).cast(pa.binary()).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], [key, "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text_of(text).alias("_text")).mapInArrow(run, f"`{key}` {kind}, fp long")


def links(fps: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """Links ``a``, ``b`` between distinct values of ``fps.fp`` whose closure is that of all pairs within ``radius``."""
    if radius > RADIUS:
        raise ValueError("the two-quarter tables hold pairs of up to two differing bits")
    quarter = [F.shiftrightunsigned("fp", 64 // QUARTERS * q).bitwiseAND(0xFFFF) for q in range(QUARTERS)]
    tables = [F.struct(F.lit(t).alias("t"), (F.shiftleft(quarter[x], 16) + quarter[y]).alias("k")) for t, (x, y) in enumerate(combinations(range(QUARTERS), 2))]
    entries = fps.select("fp").distinct().select("fp", F.explode(F.array(*tables)).alias("e")).select("fp", "e.*")
    sizes = entries.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    split = F.ceil(F.col("n") / chunk).cast("int")
    dealt = entries.join(sizes, ["t", "k"]).select("t", "k", "fp", split.alias("c"), F.pmod(F.xxhash64("fp"), split).cast("int").alias("own"))
    dealt = dealt.select("t", "k", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("other"))
    dealt = dealt.select("t", "k", "fp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    keys = ["t", "k", "i", "j"]
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys, "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in row_groups(batches, keys, 4 * chunk):
            column = {c: rows.column(c).to_numpy() for c in [*keys, "side", "fp"]}
            new = np.ones(rows.num_rows, bool)
            new[1:] = np.any([column[c][1:] != column[c][:-1] for c in keys], axis=0)
            a, b = compare(np.cumsum(new) - 1, column["i"] == column["j"], column["side"], column["fp"].astype(np.int64), radius)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def compare(block: np.ndarray, alone: np.ndarray, side: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (value, root value) of the links inside sorted blocks; in blocks of two chunks, of those across."""
    n = len(fps)
    group = np.cumsum(np.r_[True, (block[1:] != block[:-1]) | (side[1:] != side[:-1])]) - 1
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[first, n])
    words = (sizes + 63) // 64
    base = np.cumsum(words) - words
    lane = base[group] * 64 + np.arange(n) - first[group]
    width = int(words.sum())
    # planes[b][w]: bit b of the 64 lanes of word w
    lanes = np.zeros(width * 64, np.int64)
    lanes[lane] = fps
    row_of = np.zeros(width * 64, np.int64)
    row_of[lane] = np.arange(n)
    bits = np.unpackbits(lanes.view(np.uint8).reshape(width, 64, 8), axis=2, bitorder="little")
    planes = np.ascontiguousarray(np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")).view("<u8").reshape(64, width)
    used = np.zeros(width * 64, np.uint8)
    used[lane] = 1
    occupied = np.packbits(used.reshape(width, 64), axis=1, bitorder="little").view("<u8").reshape(width)
    # a row meets the words from its own on, or those of the other chunk
    following = np.r_[block[first][1:] == block[first][:-1], False] if len(first) > 1 else np.array([False])
    across = ~alone & following[group]
    own = lane // 64
    from_word = np.where(alone, own, base[np.minimum(group + 1, len(base) - 1)])
    last = np.where(alone, (base + words)[group], (base + words)[np.minimum(group + 1, len(base) - 1)])
    number = np.where(alone | across, last - from_word, 0)
    total = np.r_[0, np.cumsum(number)]
    label = np.arange(n)
    q_bits = fps.view(np.uint64)
    for at in range(0, int(total[-1]), TILE):
        combo = np.arange(at, min(at + TILE, int(total[-1])))
        q = np.searchsorted(total, combo, "right") - 1
        w = from_word[q] + combo - total[q]
        valid = occupied[w]
        same = w == own[q]
        later = ALL << (lane[q] % 64).astype(np.uint64)
        valid = np.where(same & alone[q], valid & (later << np.uint64(1)), valid)
        q, w, near = _within(planes, q_bits[q], q, w, ~valid, radius)
        if len(q):
            hit = np.unpackbits(np.ascontiguousarray(near).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            at_q, at_lane = np.nonzero(hit)
            label = _merge(label, q[at_q], row_of[w[at_q] * 64 + at_lane])
    child = np.flatnonzero(label != np.arange(n))
    return fps[child], fps[label[child]]


def _within(planes, value, q, w, over, radius):
    """Lanes of word ``w`` within ``radius`` of ``value``: counters start so that one too many carries out of them."""
    size = max(1, int(radius).bit_length())
    start = (1 << size) - 1 - radius
    counter = [np.full(len(q), ALL if start >> c & 1 else 0, np.uint64) for c in range(size)]
    for b in range(64):
        carry = planes[b][w] ^ (np.uint64(0) - (value >> np.uint64(b) & np.uint64(1)))
        for c in range(size):
            counter[c], carry = counter[c] ^ carry, counter[c] & carry
        over = over | carry
        if b % 8 == 7:
            alive = over != ALL
            if b == 63 or np.count_nonzero(alive) * 2 < len(alive):
                q, w, value, over, counter = q[alive], w[alive], value[alive], over[alive], [c[alive] for c in counter]
                if not len(q):
                    break
    return q, w, ~over


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (smallest row of each set) after joining rows ``i`` and ``j`` pairwise."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        parent = np.arange(len(label))
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(parent, parent[parent]):
            parent = parent[parent]
        label = parent[label]


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """``key``, ``fp`` and ``component_id``, the smallest key among all rows reachable over links, for every row.

    Rows of equal fingerprint belong together; rows without words have fingerprint zero and link like others. A
    null key keeps its row and is never chosen, unless its component has no other; an empty table gives no rows.
    Further columns of ``docs`` are not read.
    """
    fps = written(fingerprints(docs, key, text))
    classes = fps.groupBy("fp").agg(F.min(key).alias("least"))
    roots = components(links(fps, radius))
    joined = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    of = written(joined.join(smallest, "root").select("fp", "component_id"))
    return fps.join(of, "fp", "left").select(key, "fp", "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest key; of such rows one with the least text hash.

    Rows of a repeated key are told apart by their texts, so each is kept or lost with its own component. Rows that
    are equal in key and text stand for each other. Rows without a key are all kept.
    """
    rows = docs.select(F.col(key).alias("k"), text_of(text).alias("t")).select("k", "t", F.xxhash64("t").alias("th"))
    prints = written(fingerprints(rows.withColumn("id", F.struct("k", "th")), "id", "t").select("id.*", "fp"))
    classes = prints.groupBy("fp").agg(F.min("k").alias("least"))
    roots = components(links(prints, radius)).withColumnRenamed("node", "fp")
    roots = written(classes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    pair = F.col("k").alias("_of_k"), F.col("th").alias("_of_th")  # the columns of ``docs`` may have any plain name
    # the smallest key of a component, and of its texts the one of the least hash
    first = prints.where("k IS NOT NULL").join(roots, "fp").groupBy("root").agg(F.min(F.struct("k", "th")).alias("first"))
    first = written(first.select("first.*").groupBy("k", "th").count().select(*pair))
    own = docs.withColumn("_th", F.xxhash64(text_of(text)))
    same = (F.col(key) == F.col("_of_k")) & (F.col("_th") == F.col("_of_th"))
    kept = own.join(first, same, "left_semi")
    several = written(prints.where("k IS NOT NULL").groupBy("k", "th").count().where("count > 1").select(*pair))
    repeated = kept.join(several, same, "left_semi").dropDuplicates([key, "_th"])
    return kept.join(several, same, "left_anti").unionByName(repeated).unionByName(own.where(F.col(key).isNull())).drop("_th")
