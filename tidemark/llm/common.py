"""Helpers shared by the operators: written intermediates, bounded Arrow batches, text columns, resource files."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.session import checkpoint_folder

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
TEXT_ROWS = 200

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder: computed once, its lineage cut, read by column."""
    path = f"{checkpoint_folder(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """Arrow batches of whole texts stay small: at most ``rows`` rows each, unless the session asks for fewer."""
    spark.conf.set(BATCH, str(min(rows, int(spark.conf.get(BATCH, "10000")))))


def text_of(name: str = "text") -> Column:
    """A text column; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def shared_file(spark: SparkSession, path: str) -> Broadcast:
    """The bytes of a fixed resource file (a vocabulary, about a megabyte), read once by the driver."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def row_groups(batches: Iterable, keys: list[str], enough: int) -> Iterator:
    """Concatenate sorted Arrow batches into tables of at least ``enough`` rows that never cut rows of one key apart."""
    import numpy as np
    import pyarrow as pa

    kept: list = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        rows += batch.num_rows
        if rows < enough:
            continue
        whole = pa.Table.from_batches(kept)
        change = np.zeros(rows - 1, bool)
        for k in keys:
            column = whole.column(k).to_numpy()
            change |= column[1:] != column[:-1]
        if change.any():
            cut = int(np.flatnonzero(change)[-1]) + 1
            yield whole.slice(0, cut)
            kept = whole.slice(cut).to_batches()
            rows -= cut
    if rows:
        yield pa.Table.from_batches(kept)
