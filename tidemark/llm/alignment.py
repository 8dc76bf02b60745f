"""Cross-tokenizer alignment by pointer jumping.

Two tokenizers cut the same bytes into tokens. Every token points to the farthest-right token that overlaps it: a
token of A to the token of B that holds its last byte, and the other way round. Pointers never go left, and the
chain from a token ends at the first byte offset where tokens of both end, so replacing every pointer by its
successor's until nothing changes (a logarithm of the longest chain) labels each token with its group's last token.

A batch of documents is aligned at once: their bytes follow each other, and a document's end is an end of both.
Linked id pairs are written once per document; corpus-wide document counts come back to the documents in slices of
A ids, so that no task, broadcast or driver holds the table of all pairs.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import shared_file, text_batches, text_of, written

#: The pre-tokenizer of byte-level vocabulary files (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: An id pair is one integer: the A id and 15 bits of the B id.
B_BITS = 15
SLICES = 8
#: Documents whose pair lists meet one copy of a slice of the counts.
DEALT = 1 << 16
#: Groups of more token pairs are expanded from distinct ids.
LARGE = 256


def byte_level() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(shifted)}


def vocabulary_a(data: bytes) -> list[bytes]:
    """Bytes of each id of a byte-level BPE file; ids of special tokens are left empty."""
    file, of = json.loads(data), byte_level()
    special = {t["id"] for t in file.get("added_tokens", [])}
    entries = file["model"]["vocab"]
    out = [b""] * (max(entries.values()) + 1)
    for piece, i in entries.items():
        if i not in special:
            out[i] = bytes(of[c] for c in piece)
    return out


def encoder_a(tokens: list[bytes]) -> tiktoken.Encoding:
    """Merges of such a file are numbered in the order in which they apply, so ids serve as ranks."""
    return tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens) if t}, special_tokens={})


def vocabulary_b(model: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    """Bytes of each piece: U+2581 is a space, <0xHH> a byte."""
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]


class Pool:
    """The bytes of a vocabulary, end to end."""

    def __init__(self, tokens: list[bytes]):
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.length[ids]
        ends = np.cumsum(size)
        return self.bytes[np.repeat(self.start[ids] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


def groups_of(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Group number (from 0) of each token of A and of B, and how many tokens of A and of B end with each group."""
    n, size = len(ends_a), int(ends_a[-1])
    # tokens of a side that end before a byte: the number of the one that holds it
    closed_a, closed_b = np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)
    closed_a[ends_a], closed_b[ends_b] = 1, 1
    common = closed_a[ends_b] == 1
    np.cumsum(closed_a, out=closed_a)
    np.cumsum(closed_b, out=closed_b)
    # at equal ends the token of B is the last
    point = np.concatenate([n + closed_b[ends_a - 1], np.where(common, n + np.arange(len(ends_b)), closed_a[ends_b - 1])])
    while True:
        further = point[point]
        if np.array_equal(further, point):
            break
        point = further
    number = np.cumsum(common) - 1
    label = number[point - n]
    last = ends_b[common]
    return label[:n], label[n:], closed_a[last], closed_b[last]


def linked(ids_a: np.ndarray, ids_b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray, doc_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, id pair and number of links, sorted by document, slice and pair; groups end before ``to_a``, ``to_b``."""
    n_a, n_b = np.diff(np.r_[0, to_a]), np.diff(np.r_[0, to_b])
    small = n_a * n_b <= LARGE
    # each A token of a small group meets all B tokens of it
    group_a = np.repeat(np.arange(len(to_a)), n_a)
    use = np.flatnonzero(small[group_a])
    times = n_b[group_a[use]]
    a = np.repeat(use, times)
    g = group_a[a]
    b = np.arange(len(a)) - np.repeat(np.cumsum(times) - times, times) + (to_b - n_b)[g]
    key = [_packed(doc_of[g], ids_a[a], ids_b[b])]
    count = [np.ones(len(a), np.int64)]
    for g in np.flatnonzero(~small):
        x, cx = np.unique(ids_a[to_a[g] - n_a[g] : to_a[g]], return_counts=True)
        y, cy = np.unique(ids_b[to_b[g] - n_b[g] : to_b[g]], return_counts=True)
        key.append(_packed(doc_of[g], np.repeat(x, len(y)), np.tile(y, len(x))))
        count.append(np.outer(cx, cy).ravel())
    if len(key) == 1:
        key, count = np.unique(key[0], return_counts=True)
    else:
        key, at = np.unique(np.concatenate(key), return_inverse=True)
        count = np.bincount(at, np.concatenate(count)).astype(np.int64)
    return key >> 40, key & ((1 << 36) - 1), count


def _packed(doc, a, b):
    a = a.astype(np.int64)
    return (np.asarray(doc, np.int64) << 40) | ((a % SLICES) << 36) | (a << B_BITS) | b


class Printed:
    """Ids with the mark that follows each, as bytes of one width, blanks left out when joined."""

    def __init__(self, size: int):
        marks = [b",", b"|", b";", b""]
        width = len(str(size)) + 1
        rows = [str(i).encode() + m for i in range(size) for m in marks]
        self.rows = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(-1, width)
        self.length = np.array([len(r) for r in rows], np.int64)

    def digests(self, ids: np.ndarray, mark: np.ndarray, bounds: np.ndarray) -> list[str]:
        """Hex digests of the runs of ids between ``bounds``."""
        row = ids * 4 + mark
        data = self.rows[row].tobytes().replace(b"\0", b"")
        at = np.r_[0, np.cumsum(self.length[row])][bounds]
        return [hashlib.sha256(data[x:y]).hexdigest() for x, y in zip(at[:-1], at[1:])]


def aligned(texts: list[str], encoding, pool_a: Pool, model, pool_b: Pool, printed: Printed):
    """Per text n_a, n_b, n_groups, n_links and the digest; and the links as (text, pair with slice, number)."""
    n = len(texts)
    data = [b" " + t.encode() if t else b"" for t in texts]
    lists_a = [encoding.encode_to_numpy(" " + t, disallowed_special=()) if t else np.zeros(0, np.int64) for t in texts]
    lists_b = [np.array(x, np.int64) for x in model.encode(texts, num_threads=1)] if n else []
    for k, (d, b) in enumerate(zip(data, lists_b)):
        if not d or pool_b.length[b].sum() != len(d) or pool_a.length[lists_a[k]].sum() != len(d):
            lists_a[k] = lists_b[k] = np.zeros(0, np.int64)
            data[k] = b""
    # the bytes themselves, both of them
    at = np.cumsum([0, *map(len, data)])
    whole = np.frombuffer(b"".join(data), np.uint8)
    off = np.zeros(n, bool)
    for lists, pool in ((lists_a, pool_a), (lists_b, pool_b)):
        other = np.flatnonzero(pool.joined(np.concatenate([np.zeros(0, np.int64), *lists]).astype(np.int64)) != whole)
        off[np.unique(np.searchsorted(at, other, "right") - 1)] = True
    for k in np.flatnonzero(off):
        lists_a[k] = lists_b[k] = np.zeros(0, np.int64)
    n_a, n_b = np.array([len(x) for x in lists_a], np.int64), np.array([len(x) for x in lists_b], np.int64)
    empty = np.zeros(n, np.int64)
    if not n_a.sum():
        return n_a, n_b, empty, empty, [""] * n, (empty[:0], empty[:0], empty[:0])
    ids_a, ids_b = np.concatenate(lists_a).astype(np.int64), np.concatenate(lists_b)
    group_a, group_b, to_a, to_b = groups_of(np.cumsum(pool_a.length[ids_a]), np.cumsum(pool_b.length[ids_b]))
    doc_of = np.repeat(np.arange(n), n_a)[to_a - 1]
    per_a, per_b = np.diff(np.r_[0, to_a]), np.diff(np.r_[0, to_b])
    n_groups = np.bincount(doc_of, minlength=n)
    n_links = np.bincount(doc_of, per_a * per_b, minlength=n).astype(np.int64)
    # tokens in the order of the text form: a group's A ids, then its B ids
    ids, mark = np.empty(len(ids_a) + len(ids_b), np.int64), np.zeros(len(ids_a) + len(ids_b), np.int64)
    ids[np.arange(len(ids_a)) + np.r_[0, to_b[:-1]][group_a]] = ids_a
    ids[np.arange(len(ids_b)) + to_a[group_b]] = ids_b
    mark[to_a + to_b - per_b - 1] = 1
    mark[to_a + to_b - 1] = 2
    bounds = np.cumsum(np.r_[0, n_a + n_b])
    mark[bounds[1:][n_a > 0] - 1] = 3
    shas = [x if c else "" for x, c in zip(printed.digests(ids, mark, bounds), n_a)]
    return n_a, n_b, n_groups, n_links, shas, linked(ids_a, ids_b, to_a, to_b, doc_of)


def _written_links(docs: DataFrame, path_a: str, path_b: str, key: str, text: str) -> DataFrame:
    """A row per document (slice -1) with its figures, and one per document and slice with its id pairs."""
    spark = docs.sparkSession
    text_batches(spark)
    file_a, file_b = shared_file(spark, path_a), shared_file(spark, path_b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sentencepiece.SentencePieceProcessor(model_proto=file_b.value)
        tokens = vocabulary_a(file_a.value)
        pool_a, pool_b = Pool(tokens), Pool(vocabulary_b(model))
        encoding, printed = encoder_a(tokens), Printed(max(len(pool_a.length), len(pool_b.length)))
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            n = batch.num_rows
            *figures, shas, (doc, pair, count) = aligned(batch.column(1).to_pylist(), encoding, pool_a, model, pool_b, printed)
            ids = np.arange(row, row + n)
            row += n
            none = pa.nulls(n, pa.list_(pa.int32()))
            columns = [pa.array(ids), pa.array(np.full(n, -1, np.int32)), none, none, batch.column(0), *[pa.array(f) for f in figures], pa.array(shas)]
            yield pa.RecordBatch.from_arrays(columns, names)
            part = doc * SLICES + (pair >> B_BITS) % SLICES
            first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
            offsets = pa.array(np.r_[first, len(part)].astype(np.int32))
            m = len(first)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for v in (pair, count)]
            columns = [pa.array(ids[doc[first]]), pa.array((part[first] % SLICES).astype(np.int32)), *lists, pa.nulls(m, batch.column(0).type), *[pa.nulls(m, pa.int64())] * 4, pa.nulls(m, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["row", "slice", "pairs", "links", key, "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    kind = docs.schema[key].dataType.simpleString()
    schema = f"row long, slice int, pairs array<int>, links array<int>, `{key}` {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    return written(docs.select(key, text_of(text).alias("_text")).mapInArrow(run, schema))


def pair_counts(links: DataFrame) -> DataFrame:
    """``slice``, ``pair``, ``n`` documents that hold it linked, and ``best``: no pair of its A id has more."""
    each = links.where("slice >= 0").select("slice", F.explode("pairs").alias("pair")).groupBy("slice", "pair").agg(F.count("*").alias("n"))
    each = written(each)
    a = F.shiftright("pair", B_BITS)
    most = each.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    return each.join(most, a == F.col("a")).select("slice", "pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", dealt: int = DEALT) -> DataFrame:
    """Per document ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and ``groups_sha256``.

    A encodes a space and the text, B the text alone (it adds the space). Null and empty texts and texts whose token
    bytes differ from space and text have no tokens: zeros and an empty digest column. Every row of ``docs`` keeps
    its row, repeated rows count as documents each and null keys are kept; an empty table gives no rows; other
    columns are not read. A group's links are formed from its distinct ids, so a text without common ends costs the
    product of its distinct ids, not of its tokens.
    """
    links = _written_links(docs, path_a, path_b, key, text)
    parts = max(1, -(-links.where("slice < 0").count() // dealt))
    counts = pair_counts(links).groupBy("slice", F.shiftright("pair", B_BITS + 6).alias("chunk"))
    counts = counts.agg(F.sort_array(F.collect_list(F.struct("pair", "n", "best"))).alias("c"))
    table = counts.select("slice", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(-1).cast("long").alias("row"), F.col("c.pair").alias("pairs"), F.col("c.n").alias("values"), F.col("c.best").alias("best"))
    asked = links.where("slice >= 0").select("slice", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int").alias("part"), "row", "pairs", F.col("links").cast("array<long>").alias("values"), F.lit(None).cast("array<boolean>").alias("best"))
    met = table.unionByName(asked).repartition(min(20_000, 2 * SLICES * parts), "slice", "part").sortWithinPartitions("slice", "part", "row")

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, known = None, [], None
        for batch in batches:
            at = np.stack([batch.column(c).to_numpy() for c in (0, 1)])
            ask = batch.column(2).to_numpy() >= 0
            edges = np.flatnonzero(np.r_[True, (at[:, 1:] != at[:, :-1]).any(0) | (ask[1:] != ask[:-1]), True])
            for x, y in zip(edges[:-1], edges[1:]):
                if now != tuple(at[:, x]):
                    now, held, known = tuple(at[:, x]), [], None
                pairs, values, best = [batch.column(c).slice(x, y - x) for c in (3, 4, 5)]
                flat = pairs.flatten().to_numpy()
                if not ask[x]:
                    held.append((flat, values.flatten().to_numpy(), best.flatten().to_numpy(zero_copy_only=False)))
                    continue
                if known is None:
                    known = [np.concatenate(h) for h in zip(*held)]
                    order = np.argsort(known[0], kind="stable")
                    known, held = [k[order] for k in known], []
                place = np.searchsorted(known[0], flat)
                number = values.flatten().to_numpy()
                begins = np.cumsum(np.r_[0, np.diff(pairs.offsets.to_numpy())])[:-1]
                sums = [np.add.reduceat(number * known[c][place], begins) for c in (1, 2)]
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(x, y - x), *[pa.array(s.astype(np.int64)) for s in sums]], ["row", "count_sum", "n_best"])

    found = met.select("slice", "part", "row", "pairs", "values", "best").mapInArrow(resolve, "row long, count_sum long, n_best long")
    found = found.groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    out = links.where("slice < 0").join(found, "row", "left")
    zero = F.lit(0).cast("long")
    return out.select(key, "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
