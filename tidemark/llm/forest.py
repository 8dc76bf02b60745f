"""MinHash near-duplicates by an LSH forest of sorted signature orders.

A document's set is its distinct 2-word shingles. TREES orders of DEPTH minimum hashes each are kept sorted: rows with
a long common prefix stand together, and a tree's region is the run of rows that share a prefix. First every row is
paired with the longest-common-prefix neighbour in every order, which joins large groups of copies by chains. Then
rows of different components that share a region are paired; a region's prefix is as short as LEAST where few rows
share it and one longer, up to DEPTH, where many do. Pairs whose signatures are far too unlike are left out; every
other pair is confirmed on full sets unless its ends are joined already. A pair at the least similarity misses all
regions with probability 3e-6 (prefixes of 4) to 7e-4 (of 6, in crowded regions only), and less the more alike it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import row_groups, text_batches, text_of, written
from tidemark.llm.components import components

TREES, LEAST, DEPTH = 24, 4, 6
#: Rows up to which a region keeps its prefix; rows of a region, and sets, that one task compares.
SMALL, CHUNK, SETS = 64, 1024, 512
#: Links need 100 * intersection >= PERCENT * union. A signature of 144 values errs by .033 there; four of that are left.
PERCENT = 80
LEAST_ALIKE = 0.67
#: Rows of a table that may be broadcast.
SENT = 1 << 18
SEED = 42
_HASHES = TREES * DEPTH
_ODD = np.array([xxhash.xxh64_intdigest(str(i).encode(), 1) | 1 for i in range(_HASHES)], np.uint64)
_ADD = np.array([xxhash.xxh64_intdigest(str(i).encode(), 2) for i in range(_HASHES)], np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: bytes) -> np.ndarray:
    """64-bit values of the distinct 2-word shingles of UTF-8 text, rising; a single word stands alone."""
    digest = xxhash.xxh64_intdigest
    words = np.array([digest(w, SEED) for w in text.lower().split()], np.uint64)
    if len(words) < 2:
        return mixed(words + _STEP)
    return np.unique(mixed(mixed(words[:-1]) * _STEP + words[1:]))


def signature(values: np.ndarray) -> np.ndarray:
    """Minimum of each hash over a set, as 32-bit numbers."""
    least = np.full(_HASHES, ~np.uint64(0))
    for at in range(0, len(values), 1024):
        least = np.minimum(least, (values[at : at + 1024, None] * _ODD + _ADD).min(0))
    return (least >> np.uint64(32)).astype(">u4")


def sketches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Per row its set's size, two sums that name the set, its signature (4 bytes a value, and 1), and a hash of the text."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, names, wide, small = [], ([], []), [], []
            for t in batch.column(1).cast(pa.binary()).to_pylist():
                values = shingles(t)
                n.append(len(values))
                names[0].append(int(values.sum(dtype=np.uint64).view(np.int64)))
                names[1].append(int(mixed(values ^ _STEP).sum(dtype=np.uint64).view(np.int64)))
                own = signature(values) if len(values) else np.zeros(0, ">u4")
                wide.append(own.tobytes())
                small.append(own.astype(np.uint8).tobytes())
            columns = [pa.array(n, pa.int64()), pa.array(names[0], pa.int64()), pa.array(names[1], pa.int64()), pa.array(wide, pa.binary()), pa.array(small, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, batch.column(2)], ["key", "n", "h1", "h2", "wide", "small", "th"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), text_of(text).alias("t"))
    return rows.select("key", "t", F.xxhash64("t").alias("th")).mapInArrow(run, f"key {kind}, n long, h1 long, h2 long, wide binary, small binary, th long")


def prefix(depth: int, column: str = "path") -> Column:
    return F.xxhash64("t", F.substring(column, 1, 4 * depth))


def crowded(classes: DataFrame) -> DataFrame:
    """Paths of the classes through the trees, where another class shares a prefix of LEAST values: ``t``, ``p``, ``path``, ``cls``, ``small``."""
    paths = [F.struct(F.lit(t).alias("t"), F.substring("wide", 4 * DEPTH * t + 1, 4 * DEPTH).alias("path")) for t in range(TREES)]
    each = classes.select("cls", F.explode(F.array(*paths)).alias("e")).select("cls", "e.*").withColumn("p", prefix(LEAST))
    shared = each.groupBy("p").agg(F.count("*").alias("c")).where("c > 1").select("p")
    return each.join(shared, "p").join(classes.select("cls", "small"), "cls").select("t", "p", "path", "cls", "small")


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal values of one signature and each of several."""
    return np.count_nonzero(a == b, axis=1) / _HASHES


def _pairs(small: np.ndarray, cls: np.ndarray, a: np.ndarray, b: np.ndarray, share: np.ndarray) -> pa.RecordBatch:
    """Pairs of row numbers with the place where they are confirmed: the prefix of the first tree that they share."""
    first = (small[a] == small[b]).reshape(-1, TREES, DEPTH)[:, :, :LEAST].all(2).argmax(1)
    values = small.reshape(-1, TREES, DEPTH)[a, first, :LEAST].astype(np.int64)
    place = (first.astype(np.int64) << 32) | (values << np.array([24, 16, 8, 0])[-LEAST:]).sum(1)
    low, high = np.minimum(cls[a], cls[b]), np.maximum(cls[a], cls[b])
    return pa.RecordBatch.from_arrays([pa.array(low), pa.array(high), pa.array(place), pa.array(share)], ["a", "b", "place", "share"])


_PAIR = "a long, b long, place long, share double"


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, _HASHES)


def neighbours(near: DataFrame) -> DataFrame:
    """Pairs of neighbours in each sorted order that share LEAST values and are alike."""
    ordered = near.select("t", "path", "cls", "p", "small").repartitionByRange("t", "path", "cls").sortWithinPartitions("t", "path", "cls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch] if last is None else [last, batch])
            last = batch.slice(batch.num_rows - 1)
            p, cls, small = rows.column("p").to_numpy(), rows.column("cls").to_numpy(), _matrix(rows.column("small"))
            share = alike(small[1:], small[:-1])
            at = np.flatnonzero((p[1:] == p[:-1]) & (share >= LEAST_ALIKE))
            if len(at):
                yield _pairs(small, cls, at, at + 1, share[at])

    return ordered.mapInArrow(run, _PAIR)


def across(near: DataFrame, of: DataFrame, small: int = SMALL, chunk: int = CHUNK) -> DataFrame:
    """Regions that hold several components, dealt out in blocks ``p``, ``i``, ``j`` of bounded size.

    ``of`` has ``cls`` and ``comp`` of classes that are joined. A block of side -1 compares all its rows, others
    their side 0 with their side 1. ``depth`` is the length of the region's prefix.
    """
    rows = near.join(of, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    rows = _mixed(rows, "p").withColumn("depth", F.lit(LEAST))
    regions = None
    for depth in range(LEAST + 1, DEPTH + 1):
        settled, open_ = rows.where(F.col("c") <= small), rows.where(F.col("c") > small)
        regions = settled if regions is None else regions.unionByName(settled)
        rows = _mixed(open_.drop("c").withColumn("p", prefix(depth)), "p").withColumn("depth", F.lit(depth))
    regions = regions.unionByName(rows)
    # the largest component of a region that is dealt out meets the others only
    large = regions.where(F.col("c") > chunk)
    per = large.groupBy("p", "comp").agg(F.count("*").alias("m"))
    per = per.groupBy("p").agg(F.max(F.struct("m", "comp")).alias("most"), F.sum("m").alias("c"))
    per = per.select("p", F.col("most.comp").alias("main"), F.ceil(F.col("most.m") / chunk).cast("int").alias("mains"), F.ceil((F.col("c") - F.col("most.m")) / chunk).cast("int").alias("others"))
    dealt = large.drop("c").join(per, "p")
    own = F.pmod(F.xxhash64("cls"), F.when(F.col("comp") == F.col("main"), F.col("mains")).otherwise(F.col("others"))).cast("int")
    dealt = dealt.withColumn("own", own)
    as_main = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda i: F.struct(i.alias("i"), F.col("own").alias("j"), F.lit(1).alias("side")))
    to_main = F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda j: F.struct(F.col("own").alias("i"), j.alias("j"), F.lit(0).alias("side")))
    to_others = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda o: F.struct(F.least("own", o).alias("i"), (F.col("mains") + F.greatest("own", o)).alias("j"), F.when(F.col("own") == o, -1).otherwise((F.col("own") > o).cast("int")).alias("side")))
    columns = ["t", "depth", "comp", "cls", "small"]
    dealt = dealt.select("p", F.explode(F.when(F.col("comp") == F.col("main"), as_main).otherwise(F.concat(to_main, to_others))).alias("e"), *columns).select("p", "e.*", *columns)
    alone = regions.where(F.col("c") <= chunk).select("p", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(-1).alias("side"), *columns)
    return alone.unionByName(dealt)


def _others(side: np.ndarray, comp: np.ndarray) -> Iterator[tuple[int, int]]:
    """For each row of a block that has any, itself and the first row of those it is compared with, to the block's end."""
    left = len(side) if side[0] < 0 else int(np.searchsorted(side, 1))
    for r in range(left):
        # sorted by component, so those beyond the own one are others
        begin = int(np.searchsorted(comp, comp[r], "right")) if side[0] < 0 else left
        if begin < len(side):
            yield r, begin


def _blocks(table: pa.Table, keys: list[str]) -> Iterator[tuple[int, int]]:
    column = [table.column(c).to_numpy() for c in keys]
    cut = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in column], axis=0), True])
    yield from zip(cut[:-1].tolist(), cut[1:].tolist())


def partnered(met: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows of ``across`` that are alike to a row of another component in their block."""
    keys, names = ["p", "i", "j"], ["p", "i", "j", "side", "t", "comp", "cls"]
    ordered = met.select(*names, "small").repartition(*keys).sortWithinPartitions(*keys, "side", "comp", "cls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in row_groups(batches, keys, 2 * chunk):
            sides, comps, sig = table.column("side").to_numpy(), table.column("comp").to_numpy(), _matrix(table.column("small"))
            hit = np.zeros(table.num_rows, bool)
            for x, e in _blocks(table, keys):
                for r, begin in _others(sides[x:e], comps[x:e]):
                    near = (alike(sig[x + r], sig[x + begin : e]) >= LEAST_ALIKE) & (comps[x + begin : e] != comps[x + r])
                    if near.any():
                        hit[x + r] = True
                        hit[x + begin : e] |= near
            yield from table.select(names).filter(pa.array(hit)).to_batches()

    return ordered.mapInArrow(run, "p long, i int, j int, side int, t int, comp long, cls long")


def confirmed_across(met: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str, percent: int = PERCENT, chunk: int = CHUNK) -> DataFrame:
    """Links ``a``, ``b`` whose closure with the components is that of all alike pairs that hold on full sets.

    A pair is tried in the first tree whose region holds both, and only if no link of its block joined them before.
    """
    found = written(partnered(met, chunk))
    codes = met.select("cls", "t", "depth").distinct().groupBy("cls").agg(F.sum(F.expr(f"shiftleft(CAST(depth - {LEAST - 1} AS BIGINT), 2 * t)")).alias("code"))
    texts = texts_of(found.select("cls").distinct(), classes, docs, key, text)
    keys = ["p", "i", "j"]
    rows = found.join(codes, "cls").join(classes.select("cls", "wide"), "cls").join(texts, "cls")
    rows = rows.select(*keys, "side", "t", "comp", "cls", "code", "wide", "text").repartition(*keys).sortWithinPartitions(*keys, "side", "comp", "cls")
    trees = np.arange(TREES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in row_groups(batches, keys, SETS):
            side, t, comp, cls, code = (table.column(c).to_numpy() for c in ("side", "t", "comp", "cls", "code"))
            depth = (code[:, None] >> (2 * trees)) & 3
            wide = np.frombuffer(b"".join(table.column("wide").to_pylist()), ">u4").reshape(-1, TREES, DEPTH)
            low = wide.reshape(-1, _HASHES).astype(np.uint8)
            sets = {}

            def set_of(r):
                if r not in sets:
                    sets[r] = shingles(table.column("text")[r].as_py().encode())
                return sets[r]

            links = []
            for x, e in _blocks(table, keys):
                join = Joined()
                sets.clear()
                for r, begin in _others(side[x:e], comp[x:e]):
                    at = np.arange(x + begin, e)
                    share = alike(low[x + r], low[at])
                    fit = (share >= LEAST_ALIKE) & (comp[at] != comp[x + r])
                    at, share = at[fit], share[fit]
                    if not len(at):
                        continue
                    same = np.logical_and.accumulate(wide[x + r] == wide[at], axis=2)[:, :, LEAST - 1 :]
                    same = np.take_along_axis(same, np.maximum(depth[at] - 1, 0)[:, :, None], 2)[:, :, 0]
                    here = (same & (depth[at] == depth[x + r]) & (depth[at] > 0)).argmax(1) == t[x + r]
                    at, share = at[here], share[here]
                    for other in at[np.argsort(-share, kind="stable")].tolist():
                        if join.apart(comp[x + r], comp[other]) and linked(set_of(x + r), set_of(other), percent):
                            join.put(comp[x + r], comp[other])
                            links.append((cls[x + r], cls[other]))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


class Joined:
    """Which components the links of a block have joined so far."""

    def __init__(self):
        self.root: dict[int, int] = {}

    def find(self, x: int) -> int:
        while self.root.get(x, x) != x:
            self.root[x] = self.root.get(self.root[x], self.root[x])
            x = self.root[x]
        return x

    def apart(self, x: int, y: int) -> bool:
        return self.find(x) != self.find(y)

    def put(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self.root[max(x, y)] = min(x, y)


def linked(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    """Whether two sets, as rising values, are at least as alike."""
    if len(one) > len(other):
        one, other = other, one
    place = np.minimum(np.searchsorted(other, one), len(other) - 1)
    both = int(np.count_nonzero(other[place] == one))
    return 100 * both >= percent * (len(one) + len(other) - both)


def _mixed(rows: DataFrame, region: str) -> DataFrame:
    """Rows of regions that hold several components, with the region's size ``c``."""
    sizes = rows.groupBy(region).agg(F.count("*").alias("c"), F.min("comp").alias("x"), F.max("comp").alias("y"))
    return rows.join(sizes.where("x <> y").select(region, "c"), region)


def _sent(df: DataFrame) -> DataFrame:
    """``df`` (a written table), broadcast if it has no more than SENT rows."""
    return F.broadcast(df) if df.count() <= SENT else df


def texts_of(wanted: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """``cls`` and the text of one row of each class in ``wanted.cls``."""
    reps = written(classes.join(_sent(written(wanted)), "cls").select("cls", F.col("rep.key").alias("k"), F.col("rep.th").alias("h")))
    rows = docs.select(F.col(key).alias("key"), text_of(text).alias("text")).withColumn("th", F.xxhash64("text"))
    found = rows.join(_sent(reps), (F.col("th") == F.col("h")) & F.col("key").eqNullSafe(F.col("k")))
    return written(found.select("cls", "text").dropDuplicates(["cls"]))


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str, percent: int = PERCENT, sets: int = SETS) -> DataFrame:
    """Links ``a``, ``b`` whose closure is that of all ``pairs`` that hold on full sets.

    Pairs are tried where they are placed, the most alike first; a place of many sets is dealt out as pairs of chunks.
    """
    pairs = written(pairs.dropDuplicates(["a", "b"]))
    texts = texts_of(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "cls"), classes, docs, key, text)
    ends = pairs.select("place", F.explode(F.array("a", "b")).alias("cls")).distinct()
    parts = ends.groupBy("place").agg(F.ceil(F.count("*") / sets).cast("int").alias("c"))
    deal = lambda x: F.pmod(F.xxhash64(x), F.col("c")).cast("int")
    split = pairs.join(parts, "place")
    split = written(split.select("place", F.least(deal("a"), deal("b")).alias("i"), F.greatest(deal("a"), deal("b")).alias("j"), "a", "b", "share"))
    keys = ["place", "i", "j"]
    held = split.select(*keys, F.explode(F.array("a", "b")).alias("cls")).distinct().join(texts, "cls")
    held = held.select(*keys, F.lit(0.0).alias("order"), F.col("cls").alias("a"), F.col("cls").alias("b"), "text")
    asked = split.select(*keys, (F.lit(2.0) - F.col("share")).alias("order"), "a", "b", F.lit(None).cast("string").alias("text"))
    met = held.unionByName(asked).repartition(*keys).sortWithinPartitions(*keys, "order", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known, join = None, {}, Joined()
        for batch in batches:
            links = []
            columns = [batch.column(c).to_pylist() for c in keys] + [batch.column(c).to_pylist() for c in ("a", "b")]
            for place, i, j, a, b, own in zip(*columns, batch.column("text").cast(pa.binary()).to_pylist()):
                if now != (place, i, j):
                    now, known, join = (place, i, j), {}, Joined()
                if own is not None:
                    known[a] = shingles(own)
                elif join.apart(a, b) and linked(known[a], known[b], percent):
                    join.put(a, b)
                    links.append((a, b))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], ["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, small: int = SMALL, chunk: int = CHUNK, sets: int = SETS) -> DataFrame:
    """``key``, ``n_shingles``, ``component_id`` (the smallest key reachable over links, the own one included), ``kept`` for every row.

    Rows of equal sets belong together. Rows whose text is null or has no words have no set, no links and their own key.
    Repeated rows and keys keep their rows, each with the component of its own text. A null key is
    never chosen and never kept; a component without keys has a null id. An empty table gives no rows; other columns
    are not read. ``percent`` may be 80 or more; below, prefixes and the likeness asked of signatures would miss links.
    """
    if percent < PERCENT:
        raise ValueError(f"the forest finds links of {PERCENT} percent or more")
    rows = written(sketches(docs, key, text))
    classes = rows.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("key").alias("least"), F.min(F.struct("key", "th")).alias("rep"), F.first("wide").alias("wide"), F.first("small").alias("small"))
    classes = written(classes.withColumn("cls", F.monotonically_increasing_id()))
    near = written(crowded(classes))
    links = written(confirmed(neighbours(near), classes, docs, key, text, percent, sets))
    of = written(components(links).select(F.col("node").alias("cls"), F.col("root").alias("comp")))
    met = written(across(near, of, small, chunk))
    more = written(confirmed_across(met, classes, docs, key, text, percent, chunk))
    joined = more
    for end in ("a", "b"):
        joined = joined.join(of.select(F.col("cls").alias(end), F.col("comp").alias("c")), end, "left").withColumn(end, F.coalesce("c", end)).drop("c")
    last = components(joined).select(F.col("node").alias("comp"), "root")
    named = classes.select("n", "h1", "h2", "cls", "least").join(of, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    named = written(named.join(last, "comp", "left").select("n", "h1", "h2", "least", F.coalesce("root", "comp").alias("root")))
    smallest = named.groupBy("root").agg(F.min("least").alias("component"))
    named = named.join(smallest, "root").select("n", "h1", "h2", "component")
    out = rows.select("key", "n", "h1", "h2").join(named, ["n", "h1", "h2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("key"))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(False)).alias("kept"))
