"""Token counts per section: a document is encoded once, and its tokens' character spans are joined to sections.

Byte-level tokens tile the UTF-8 bytes of a text, so a running sum of their lengths gives byte spans, and the
number of character starts before a byte gives character spans. Both tokens and sections are sorted, so the
interval join is one binary search per token. A token that crosses a boundary is allocated by an explicit rule:
``first`` gives it to the section of its first character, ``last`` to that of its last, ``share`` divides it by the
characters it has in each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.bpe import encoder, token_bytes
from tidemark.llm.common import shared_file, text_batches, text_of

RULES = ("first", "last", "share")


def token_spans(ids: np.ndarray, lengths: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of the tokens of ``text``: the characters that each touches, end exclusive."""
    data = np.frombuffer(text.encode(), np.uint8)
    char = np.cumsum((data & 0xC0) != 0x80) - 1
    ends = np.cumsum(lengths[ids])
    starts = ends - lengths[ids]
    return char[starts], char[ends - 1] + 1


def allocated(starts: np.ndarray, ends: np.ndarray, begin: np.ndarray, stop: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens per section and how many of them cross a boundary, for sections ``[begin, stop)`` that tile the text."""
    first = np.searchsorted(begin, starts, "right") - 1
    last = np.searchsorted(begin, ends - 1, "right") - 1
    crossing = first != last
    own = last if rule == "last" else first
    over = np.bincount(own[crossing], minlength=len(begin))
    if rule != "share":
        return np.bincount(own, minlength=len(begin)), over
    counts = np.bincount(own[~crossing], minlength=len(begin)).astype(float)
    for t in np.flatnonzero(crossing):
        s = np.arange(first[t], last[t] + 1)
        counts[s] += (np.minimum(stop[s], ends[t]) - np.maximum(begin[s], starts[t])) / (ends[t] - starts[t])
    return counts, over


def section_counts(docs: DataFrame, ranks_path: str, pattern: str, boundary: str = "\n", rule: str = "first", key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per section of every whole text: ``key``, ``section`` (from 0), ``start``, ``end``, ``n_tokens``, ``n_crossing``.

    Sections end after each match of the regular expression ``boundary``; starts and ends are code points. ``n_tokens``
    is a double under the rule ``share``. Null and empty texts have one empty section without tokens. Null keys and
    repeated rows keep their rows, an empty table gives none, other columns are not read.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    text_batches(docs.sparkSession)
    file = shared_file(docs.sparkSession, ranks_path)
    whole = rule != "share"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, cut = encoder(file.value, pattern), re.compile(boundary)
        lengths = np.array([len(t) for t in token_bytes(file.value)])
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            for r, t in enumerate(batch.column(1).to_pylist()):
                ends = [m.end() for m in cut.finditer(t) if m.end() > m.start()]
                stop = np.array([*ends, len(t)] if not ends or ends[-1] < len(t) else ends)
                begin = np.r_[0, stop[:-1]]
                ids = encoding.encode_to_numpy(t, disallowed_special=())
                counts, over = allocated(*token_spans(ids, lengths, t), begin, stop, rule) if len(ids) else (np.zeros(len(stop), int), np.zeros(len(stop), int))
                for column, values in zip(rows, (np.full(len(stop), r), np.arange(len(stop)), begin, stop, counts, over)):
                    column.append(values)
            row, *values = [np.concatenate(c) for c in rows]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64() if whole else pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *[pa.array(v, k) for v, k in zip(values, kinds)]], [key, "section", "start", "end", "n_tokens", "n_crossing"])

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, section int, start int, `end` int, n_tokens {'long' if whole else 'double'}, n_crossing long"
    return docs.select(key, text_of(text).alias("_text")).mapInArrow(run, schema)
