"""Byte-level BPE over whole texts: overlapping chunks, stitched where their pre-token boundaries meet again.

A text up to ``chunk`` characters is one chunk and is encoded as it stands. A longer one is cut into chunks that
overlap by ``overlap`` characters. Every chunk is pre-tokenised on its own, in parallel. A match of the pattern
depends on nothing before it, so once a chunk and its successor share a boundary they agree from there on; the
first shared one (after a character that is no white space, so that a piece ending there splits the same way) is
the cut. Where two chunks share none, as in one very long word, they form one piece. The pieces are then encoded
apart and their ids concatenated. Decoding concatenates the raw bytes of the tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from tidemark.llm.common import shared_file, text_batches, text_of, written

CHUNK = 1 << 16
OVERLAP = 2048
#: Characters before a chunk's end where a match might still change with what follows.
MARGIN = 4


def ranks_of(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


def encoder(data: bytes, pattern: str, special: dict[str, int] | None = None) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks_of(data), special_tokens=special or {})


def token_bytes(data: bytes) -> list[bytes]:
    """The bytes of each id; ids that the file leaves free are empty."""
    ranks = ranks_of(data)
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def id_lists(encoding: tiktoken.Encoding, texts: list[str]) -> pa.Array:
    """Token ids of each text, as a list column."""
    arrays = [encoding.encode_to_numpy(t, disallowed_special=()) for t in texts]
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    values = np.concatenate(arrays).astype(np.int32) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``docs`` without ``text`` but with ``ids`` (array of int), the tokens of each match of ``pattern`` in turn.

    Null and empty texts give no ids. A column already called ``ids`` is replaced; all other columns, repeated rows
    and null keys are kept. An empty table stays empty.
    """
    if not 2 * MARGIN < overlap < chunk:
        raise ValueError("the overlap must be shorter than a chunk and longer than twice the margin")
    text_batches(docs.sparkSession)
    file = shared_file(docs.sparkSession, ranks_path)
    kept = [c for c in docs.columns if c not in (text, ids)]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept] or [F.lit(0).alias("_")]).alias("row"), text_of(text).alias("t"))
    short = _encoded(packed.where(F.length("t") <= chunk), file, pattern)
    out = short.unionByName(_long(packed.where(F.length("t") > chunk), file, pattern, chunk, overlap))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], F.col("ids").alias(ids))


def _encoded(df: DataFrame, file, pattern: str) -> DataFrame:
    """Replace the text ``t`` by its ``ids``."""
    others = [c for c in df.columns if c != "t"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(file.value, pattern)
        for batch in batches:
            lists = id_lists(encoding, batch.column("t").to_pylist())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], lists], [*others, "ids"])

    return df.select(*others, "t").mapInArrow(run, _schema(df, others, "ids", "array<int>"))


def _schema(df: DataFrame, others: list[str], name: str, kind: str):
    return StructType([*[df.schema[c] for c in others], *StructType.fromDDL(f"{name} {kind}").fields])


def _long(df: DataFrame, file, pattern: str, chunk: int, overlap: int) -> DataFrame:
    step = chunk - overlap

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                t = batch.column("t")[r].as_py()
                for k, at in enumerate(range(0, len(t) - overlap, step)):
                    yield pa.RecordBatch.from_arrays([batch.column("key").slice(r, 1), batch.column("row").slice(r, 1), pa.array([k], pa.int32()), pa.array([t[at : at + chunk]])], ["key", "row", "k", "t"])

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).finditer
        for batch in batches:
            head, tail = [], []
            for k, t in zip(batch.column("k").to_pylist(), batch.column("t").to_pylist()):
                ends = [e for e in (m.end() for m in find(t)) if not t[e - 1].isspace()]
                head.append([k * step + e for e in ends if e <= overlap - MARGIN])
                tail.append([k * step + e for e in ends if step <= e <= len(t) - MARGIN])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(head, pa.list_(pa.int64())), pa.array(tail, pa.list_(pa.int64()))], [*batch.schema.names, "head", "tail"])

    keyed = df.select(F.monotonically_increasing_id().alias("key"), "row", "t")
    chunks = keyed.mapInArrow(cut, _schema(keyed, ["key", "row"], "k int, t", "string")).repartition("key", "k")
    chunks = written(chunks.mapInArrow(bounds, _schema(chunks, chunks.columns, "head array<long>, tail", "array<long>")))
    before = chunks.select("key", (F.col("k") + 1).alias("k"), F.col("tail").alias("before"))
    cuts = chunks.select("key", "k", "head").join(before, ["key", "k"], "left").select("key", "k", F.array_min(F.array_intersect("head", "before")).alias("cut"))
    # a chunk without a shared boundary continues the piece of the one before it
    order = Window.partitionBy("key").orderBy("k")
    cuts = cuts.withColumn("start", F.coalesce("cut", F.col("k").cast("long") * step))
    cuts = cuts.withColumn("end", F.lead("start").over(order)).withColumn("piece", F.count("cut").over(order))
    begin = F.col("start") - F.col("k").cast("long") * step
    size = F.coalesce(F.col("end") - F.col("start"), F.lit(chunk))
    parts = chunks.drop("head", "tail").join(cuts, ["key", "k"]).select("key", "row", "k", "piece", F.substring("t", (begin + 1).cast("int"), size.cast("int")).alias("t"))
    pieces = parts.groupBy("key", "piece").agg(F.first("row").alias("row"), F.array_sort(F.collect_list(F.struct("k", "t"))).alias("parts"))
    pieces = pieces.select("key", "piece", "row", F.concat_ws("", F.col("parts.t")).alias("t"))
    done = _encoded(pieces, file, pattern).groupBy("key").agg(F.first("row").alias("row"), F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("ids"))
    return done.select("row", F.flatten("ids.ids").alias("ids"))


def decode(tokens: DataFrame, ranks_path: str, ids: str = "ids", output: str = "decoded") -> DataFrame:
    """``tokens`` with ``output`` (binary): the concatenated bytes of ``ids``; null ids give no bytes.

    A column already called ``output`` is replaced. An id outside the vocabulary raises.
    """
    text_batches(tokens.sparkSession)
    file = shared_file(tokens.sparkSession, ranks_path)
    tokens = tokens.drop(output)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = token_bytes(file.value)
        for batch in batches:
            joined = [b"".join(map(piece.__getitem__, x or ())) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(joined, pa.binary())], [*batch.schema.names, output])

    return tokens.mapInArrow(run, _schema(tokens, tokens.columns, output, "binary"))


def digests(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """Per document: token count, SHA-256 of the ids joined by commas, SHA-256 of the bytes decoded from them."""
    both = decode(encode(docs.select(key, "text"), ranks_path, pattern), ranks_path)
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return both.select(key, F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
