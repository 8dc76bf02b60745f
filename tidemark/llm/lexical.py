"""Exact ranked lexical search as maximum inner product over sparse vectors in ball trees.

A document is the vector of its saturated term weights, an item the vector of its terms' repeats; the score is their
inner product. Documents are read in blocks. For a few items at a time a block's vectors over their terms form a
ball tree: a node has a centroid c and a radius r, and no document below it scores above q.c + |q| r. That bound is
computed in doubles and rounded up by more than all its rounding errors. Subtrees are visited best bound first and
dropped once the bound is under the k-th score so far, which carries over from block to block; leaves are scored in
64-bit integers, so results are exact.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.common import text_batches, text_of, written

#: Documents of a block, documents of a leaf, items of a tree, and the distinct terms from which a tree takes no more items.
BLOCK = 8192
LEAF = 64
ITEMS = 4
TERMS = 512
#: Characters of items whose terms are held at once, by the driver and by every task.
ASKED = 1 << 22
#: Bounds are raised by this share and by one; a sum of a million products of doubles errs by less than a quarter of it.
SLACK = 1e-9
#: Bytes of terms are kept (A-Z lowered), all others part them.
PARTED = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalnum() else 0x20 for b in range(256))


def terms(text: str) -> list[bytes]:
    """Runs of letters and digits of ASCII and of all characters beyond it, A-Z lowered."""
    return text.encode().translate(PARTED).split()


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def term_counts(docs: DataFrame, vocabulary: dict[bytes, int], key: str, text: str) -> DataFrame:
    """Per row ``id``, ``n`` (terms with repeats) and the numbers and counts of its terms in ``vocabulary``, rising."""
    spark = docs.sparkSession
    text_batches(spark)
    shared = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for batch in batches:
            lists = [terms(t) for t in batch.column(1).to_pylist()]
            found = [[v for v in map(get, words) if v is not None] for words in lists]
            doc = np.repeat(np.arange(len(found)), [len(f) for f in found])
            flat = np.array([v for f in found for v in f], np.int64)
            pair, count = np.unique(doc << 32 | flat, return_counts=True)
            offsets = pa.array(np.searchsorted(pair >> 32, np.arange(len(found) + 1)).astype(np.int32))
            columns = [pa.array((pair & 0xFFFFFFFF).astype(np.int32)), pa.array(count.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in lists], pa.int64()), *[pa.ListArray.from_arrays(offsets, c) for c in columns]], ["id", "n", "terms", "counts"])

    return docs.select(F.col(key).cast("long").alias("id"), text_of(text).alias("t")).mapInArrow(run, "id long, n long, terms array<int>, counts array<int>")


class Tree:
    """A ball tree over the rows of ``x`` (integers); children of node i are 2 i + 1 and 2 i + 2."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x, n = x, len(x)
        self.depth = max(0, math.ceil(math.log2(n / leaf))) if n > leaf else 0
        size = (2 << self.depth) - 1
        self.first, self.end = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.centre, self.radius = np.zeros((size, x.shape[1])), np.zeros(size)
        self.order, at = np.arange(n), x.astype(float)
        self.end[0] = n
        for i in range(size):
            a, e = self.first[i], self.end[i]
            part = at[self.order[a:e]]
            self.centre[i] = part.mean(0)
            away = np.sqrt(((part - self.centre[i]) ** 2).sum(1))
            self.radius[i] = away.max() * (1 + SLACK)
            if 2 * i + 2 < size:
                one = part[away.argmax()]
                other = part[((part - one) ** 2).sum(1).argmax()]
                half = (e - a) // 2
                self.order[a:e] = self.order[a:e][np.argpartition(part @ (other - one), half)]
                self.first[2 * i + 1 : 2 * i + 3] = a, a + half
                self.end[2 * i + 1 : 2 * i + 3] = a + half, e

    def bounds(self, asked: np.ndarray) -> np.ndarray:
        """A row per query of upper bounds of what lies under each node."""
        size = np.sqrt((asked.astype(float) ** 2).sum(1)) * (1 + SLACK)
        return (asked.astype(float) @ self.centre.T + size[:, None] * self.radius) * (1 + SLACK) + 1


class Best:
    """The ``k`` best of what was seen: scores falling, ids rising among equals."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def least(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        fit = scores >= self.least()
        if fit.any():
            scores, ids = np.r_[self.scores, scores[fit]], np.r_[self.ids, ids[fit]]
            order = np.lexsort((ids, -scores))[: self.k]
            self.scores, self.ids = scores[order], ids[order]


def search(tree: Tree, ids: np.ndarray, asked: np.ndarray, best: list[Best]) -> int:
    """Put the tree's documents into ``best``, one for each query; returns the number of leaves scored."""
    scored, inner = 0, (len(tree.radius) - 1) // 2
    for bounds, query, top in zip(tree.bounds(asked).tolist(), asked, best):
        used = np.flatnonzero(query)
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < top.least():
                break
            if node >= inner:
                rows = tree.order[tree.first[node] : tree.end[node]]
                top.add(tree.x[np.ix_(rows, used)] @ query[used], ids[rows])
                scored += 1
                continue
            for child in (2 * node + 1, 2 * node + 2):
                heapq.heappush(heap, (max(bound, -bounds[child]), child))
    return scored


def trees_of(items: list[dict[int, int]], most: int = ITEMS, enough: int = TERMS) -> list[tuple[list[int], np.ndarray, np.ndarray]]:
    """Items put together for a tree: their numbers, the rising term numbers of all, and a matrix of repeats."""
    out, now, known = [], [], set()
    for i, item in enumerate(items):
        if now and (len(now) == most or len(known | item.keys()) > enough):
            out.append((now, known))
            now, known = [], set()
        now, known = [*now, i], known | item.keys()
    out.append((now, known))
    made = []
    for numbers, known in out:
        columns = np.array(sorted(known), np.int64)
        asked = np.zeros((len(numbers), len(columns)), np.int64)
        for r, i in enumerate(numbers):
            asked[r, np.searchsorted(columns, list(items[i]))] = list(items[i].values())
        made.append((numbers, columns, asked))
    return made


def rank(docs: DataFrame, items: DataFrame, k: int = 20, key: str = "doc_id", item_key: str = "item_id", text: str = "text", block: int = BLOCK, asked: int = ASKED) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id``, ``score``: each item's ``k`` best documents with a score above 0.

    Texts that are null or without terms have none; such items get no rows. Rows without a document id count in the
    statistics but are not returned; repeated rows are documents each. Of rows that share an item id the smallest
    text asks. Equal scores go by rising document id. Empty tables give no rows; other columns are not read.
    Items are asked in turns of about ``asked`` characters, each a pass over the documents.
    """
    spark = docs.sparkSession
    queries = items.groupBy(F.col(item_key).cast("long").alias("item")).agg(F.min(F.col(text).cast("string")).alias("t")).where("t IS NOT NULL")
    turns = max(1, -(-(queries.agg(F.sum(F.length("t"))).first()[0] or 0) // asked))
    found = [_turn(docs, [(r.item, r.t) for r in queries.where(F.pmod(F.xxhash64("item"), F.lit(turns)) == turn).orderBy("item").collect()], k, key, text, block) for turn in range(turns)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    order = Window.partitionBy("item").orderBy(F.desc("score"), "id")
    out = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select(F.col("item").alias(item_key), "rank", F.col("id").alias(key), "score")


def _turn(docs: DataFrame, queries: list[tuple], k: int, key: str, text: str, block: int) -> DataFrame:
    """The best ``k`` of every task for each of a bounded number of items."""
    spark = docs.sparkSession
    number: dict[bytes, int] = {}
    asked, names = [], []
    for item, t in queries:
        own: dict[int, int] = {}
        for word in terms(t):
            i = number.setdefault(word, len(number))
            own[i] = own.get(i, 0) + 1
        if own:
            asked.append(own)
            names.append(item)
    schema = "item long, id long, score long"
    if not asked:
        return spark.createDataFrame([], schema)
    counts = written(term_counts(docs, number, key, text))
    n, length = counts.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(len(number), np.int64)
    for r in counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        weights[r.term] = weight(n, r["count"])
    shared = spark.sparkContext.broadcast((trees_of(asked), weights, names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, w, items = shared.value
        best = [Best(k) for _ in items]
        for ids, m, bounds, term, count in blocks(batches):
            x = 1_000_000_000 * count // (1000 * count + 12 * np.repeat(m, np.diff(bounds))) * w[term]
            row = np.repeat(np.arange(len(ids)), np.diff(bounds))
            for numbers, columns, matrix in trees:
                at = np.minimum(np.searchsorted(columns, term), len(columns) - 1)
                use = columns[at] == term
                if not use.any():
                    continue
                rows, own = np.unique(row[use], return_inverse=True)
                dense = np.zeros((len(rows), len(columns)), np.int64)
                dense[own, at[use]] = x[use]
                search(Tree(dense), ids[rows], matrix, [best[i] for i in numbers])
        sizes = [len(b.ids) for b in best]
        if sum(sizes):
            yield pa.RecordBatch.from_arrays([pa.array([i for i, s in zip(items, sizes) for _ in range(s)], pa.int64()), pa.array(np.concatenate([b.ids for b in best])), pa.array(np.concatenate([b.scores for b in best]))], ["item", "id", "score"])

    def blocks(batches: Iterator[pa.RecordBatch]):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= block:
                yield columns_of(held)
                held, size = [], 0
        if held:
            yield columns_of(held)

    def columns_of(held: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(held).combine_chunks()
        lists = rows.column("terms").chunk(0)
        size = rows.column("n").to_numpy().astype(object)
        m = (75 + 25 * size * n // length).astype(np.int64)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        return rows.column("id").to_numpy(), m, offsets - offsets[0], lists.flatten().to_numpy().astype(np.int64), rows.column("counts").chunk(0).flatten().to_numpy().astype(np.int64)

    return counts.where("id IS NOT NULL AND size(terms) > 0").select("id", "n", "terms", "counts").mapInArrow(run, schema)


#: The same in SQL, from the whole tables.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
q AS (SELECT item_id, min(text) AS text FROM benchmark GROUP BY item_id),
words AS (SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
asked AS (SELECT item_id, term, count(*) AS reps FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM q) GROUP BY item_id, term),
sizes AS (SELECT r, doc_id, count(*) AS n FROM words GROUP BY r, doc_id),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM sizes),
tfs AS (SELECT r, term, count(*) AS tf FROM words GROUP BY r, term),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, total GROUP BY term, docs),
scores AS (SELECT item_id, doc_id, CAST(sum(reps * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // length)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN sizes USING (r), total GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 AND doc_id IS NOT NULL QUALIFY rank <= 20
"""
