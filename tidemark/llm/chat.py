"""Chat formatting with a loss mask aligned by offsets.

A conversation is rendered whole, each turn as ``<|im_start|>role<|im_sep|>text<|im_end|>`` and a newline, and
encoded once. Spans of the assistants' texts and spans of tokens are sorted, so a binary search finds the tokens
under the loss. The marks are single tokens that split the text around them, so no token crosses a span's end.
Inside roles and texts a backslash is doubled and ``<|`` becomes ``<\\|``, which removes every control string and
can be undone. A conversation longer than PART characters, or turn numbers further apart than BLOCK, is rendered
in parts that end between turns, which changes neither text nor tokens and keeps memory bounded; parts of one
conversation can lie on different machines.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.bpe import encoder, token_bytes
from tidemark.llm.common import shared_file, text_batches
from tidemark.llm.token_counts import token_spans

#: The marks of the template, and ids that the vocabulary leaves free for them.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
MARKS = {START: 50257, SEP: 50258, END: 50259}

PART = 1 << 20
BLOCK = 1024


def escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def restored(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def rendered(turns: list[tuple[str, str]], under_loss: frozenset) -> tuple[str, list[tuple[int, int]]]:
    """Template text of (role, text) turns and the sorted spans of the texts whose role is ``under_loss``."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"{START}{escaped(role)}{SEP}", escaped(text)
        if role in under_loss and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        out.append(f"{head}{body}{END}\n")
        at += len(out[-1])
    return "".join(out), spans


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Whether each token meets one of the sorted ``spans``."""
    if not spans:
        return np.zeros(len(starts), bool)
    begin, stop = np.array(spans).T
    at = np.searchsorted(begin, ends - 1, "right") - 1
    return (at >= 0) & (starts < stop[np.maximum(at, 0)])


def parsed(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a rendered text."""
    found = re.findall(f"{re.escape(START)}(.*?){re.escape(SEP)}(.*?){re.escape(END)}\n", text, flags=re.S)
    return [(restored(role), restored(body)) for role, body in found]


def formatted(conversations: DataFrame, ranks_path: str, pattern: str, assistant: tuple[str, ...] = ("assistant",), part: int = PART) -> DataFrame:
    """Rendered conversations: ``conv_id``, ``block``, ``part``, ``text``, ``ids``, ``starts``, ``ends``, ``loss``.

    Rows ``(conv_id, turn, role, text)`` are ordered by turn, null first, ties by role and text. Null roles and texts
    are empty; null conversations form one; repeated turns are kept; an empty table gives no rows; other columns are
    not read. Token spans are code points of ``text``.
    """
    text_batches(conversations.sparkSession, 1000)
    file = shared_file(conversations.sparkSession, ranks_path)
    under_loss = frozenset(assistant)
    names = ["conv_id", "block", "turn", "role", "text"]
    rows = conversations.select("conv_id", F.floor(F.coalesce(F.col("turn"), F.lit(0)) / BLOCK).cast("long").alias("block"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartition("conv_id", "block").sortWithinPartitions(*names)
    kind = conversations.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(file.value, pattern, MARKS)
        lengths = np.zeros(max(MARKS.values()) + 1, np.int64)
        pieces = token_bytes(file.value)
        lengths[: len(pieces)] = [len(p) for p in pieces]
        for mark, i in MARKS.items():
            lengths[i] = len(mark)

        def done(key, number, turns):
            text, spans = rendered(turns, under_loss)
            ids = encoding.encode_to_numpy(text, allowed_special="all")
            starts, ends = token_spans(ids, lengths, text)
            lists = [pa.array([x], pa.list_(k)) for x, k in ((ids.astype(np.int32), pa.int32()), (starts.astype(np.int32), pa.int32()), (ends.astype(np.int32), pa.int32()), (loss_mask(starts, ends, spans), pa.bool_()))]
            keys = [pa.array([key[0]], key_kind), pa.array([key[1]], pa.int64()), pa.array([number], pa.int32())]
            return pa.RecordBatch.from_arrays([*keys, pa.array([text]), *lists], ["conv_id", "block", "part", "text", "ids", "starts", "ends", "loss"])

        key, number, turns, size = None, 0, [], 0
        for batch in batches:
            key_kind = batch.column(0).type
            for conv, block, _, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if turns and ((conv, block) != key or size >= part):
                    yield done(key, number, turns)
                    number, turns, size = (number + 1 if (conv, block) == key else 0), [], 0
                key = (conv, block)
                turns.append((role, text))
                size += len(role) + len(text)
        if turns:
            yield done(key, number, turns)

    schema = f"conv_id {kind.simpleString()}, block long, part int, text string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>"
    return rows.mapInArrow(run, schema)


def read_back(parts: DataFrame) -> DataFrame:
    """Digests of what ``formatted`` holds, per conversation, its parts taken in order and hashed as they stream by."""
    text_batches(parts.sparkSession)
    ordered = parts.select("conv_id", "block", "part", "text", "starts", "ends", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "block", "part")
    kind = parts.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            key_kind = batch.column(0).type
            for r in range(batch.num_rows):
                key, text = batch.column(0)[r].as_py(), batch.column(3)[r].as_py()
                if now is None or now["key"] != key:
                    if now is not None:
                        yield closed(now, key_kind)
                    now = {"key": key, "turns": 0, "sha": hashlib.sha256(), "loss": 0, "loss_sha": hashlib.sha256(), "chars": 0}
                now["chars"] += len(text)
                for role, body in parsed(text):
                    now["turns"] += 1
                    now["sha"].update(f"{role}\n{body}\n".encode())
                starts, ends, loss = (batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in (4, 5, 6))
                for a, b in ranges(starts[loss], ends[loss]):
                    body = restored(text[a:b])
                    now["loss"] += len(body)
                    now["loss_sha"].update(body.encode())
        if now is not None:
            yield closed(now, key_kind)

    def closed(c, key_kind):
        columns = [pa.array([c["key"]], key_kind), pa.array([c["turns"]]), pa.array([c["sha"].hexdigest()]), pa.array([c["loss"]]), pa.array([c["loss_sha"].hexdigest()]), pa.array([c["chars"]])]
        return pa.RecordBatch.from_arrays(columns, ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def ranges(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Union of sorted spans that touch or overlap, as maximal ranges."""
    if not len(starts):
        return []
    cut = np.flatnonzero(starts[1:] > ends[:-1]) + 1
    return list(zip(starts[np.r_[0, cut]].tolist(), ends[np.r_[cut - 1, len(ends) - 1]].tolist()))
