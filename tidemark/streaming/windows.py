"""Event-time windows, interval joins and late rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def watermarked(df: DataFrame, delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def windowed_totals(df: DataFrame, key: str, value: str, width: str, slide: str | None = None, ts: str = "ts") -> DataFrame:
    """Count and sum per key and tumbling (or sliding) window."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    d = df.groupBy(w.alias("_w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return d.select(key, F.col("_w.start").alias("window_start"), "n", "total")


def session_totals(df: DataFrame, key: str, gap: str, ts: str = "ts") -> DataFrame:
    d = df.groupBy(F.session_window(ts, gap).alias("_w"), key).agg(F.count(F.lit(1)).alias("n"))
    return d.select(key, F.col("_w.start").alias("session_start"), F.col("_w.end").alias("session_end"), "n")


def interval_stream_join(left: DataFrame, right: DataFrame, key: str, age: str, ts: str = "ts") -> DataFrame:
    """Rows of ``right`` within ``age`` after a row of ``left`` of the same key. Both sides need a watermark,
    which bounds the state; columns come back with l_ and r_ prefixes."""
    a = left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns])
    b = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    cond = (F.col(f"l_{key}") == F.col(f"r_{key}")) & (F.col(f"r_{ts}") >= F.col(f"l_{ts}")) & (F.col(f"r_{ts}") <= F.col(f"l_{ts}") + F.expr(f"interval {age}"))
    return a.join(b, cond)


def is_late(ts: Column, newest: str | None, delay: str) -> Column:
    """Whether a row is older than the newest time of the batches before it minus the delay."""
    if newest is None:
        return F.lit(False)
    return ts < F.lit(newest).cast("timestamp") - F.expr(f"interval {delay}")


def split_late(stream: DataFrame, on_time: str, late: str, checkpoint: str, delay: str = "10 minutes", ts: str = "ts") -> None:
    """Write rows on time and late rows to two tables, one folder per micro-batch. Each batch leaves the newest
    time so far, one row, beside the checkpoint; the next one reads that row only, and a restart decides the same way."""
    spark = stream.sparkSession
    newest_of = lambda number: f"{checkpoint}-newest/batch={number}"

    def save(batch: DataFrame, number: int) -> None:
        newest = spark.read.parquet(newest_of(number - 1)).first()[0] if number > 0 else None
        flagged = batch.withColumn("_late", is_late(F.col(ts), newest, delay))
        flagged.filter(~F.col("_late")).drop("_late").write.mode("overwrite").parquet(f"{on_time}/batch={number}")
        flagged.filter("_late").drop("_late").write.mode("overwrite").parquet(f"{late}/batch={number}")
        own = spark.read.schema(batch.schema).parquet(f"{on_time}/batch={number}").agg(F.max(ts).alias("m"))
        own.select(F.greatest(F.col("m"), F.lit(newest).cast("timestamp")).cast("string").alias("newest")).write.mode("overwrite").parquet(newest_of(number))

    query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start()
    query.awaitTermination()
