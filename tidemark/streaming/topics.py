"""Reading and writing topics, and running queries into tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


# JSON text keeps milliseconds unless told otherwise
MICROS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def read_topic(spark: SparkSession, topic: str, schema: str, servers: str | None = None, starting: str = "latest", files_per_trigger: int | None = None) -> DataFrame:
    """A JSON topic as typed rows. With ``servers`` it is a Kafka topic (the connector jar must be on the
    classpath); otherwise ``topic`` is a folder of ``key``/``value`` JSON lines, one message per row."""
    if servers is not None:
        raw = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
               .option("startingOffsets", starting).load().select(F.col("key").cast("string"), F.col("value").cast("string")))
    else:
        reader = spark.readStream.schema("key string, value string").option("recursiveFileLookup", True)
        if files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", files_per_trigger)
        raw = reader.json(topic)
    return raw.withColumn("_m", F.from_json("value", schema)).select("key", "_m.*")


def keyed_json(df: DataFrame, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows as (key, value) messages with the columns as one JSON text."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*(columns or df.columns)), MICROS).alias("value"))


def write_topic(df: DataFrame, topic: str, key: str, checkpoint: str, servers: str | None = None):
    """Publish a stream as keyed JSON and wait until the input at hand is done."""
    writer = keyed_json(df, key).writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).outputMode("append")
    if servers is not None:
        query = writer.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).start()
    else:
        query = writer.format("json").option("path", topic).start()
    query.awaitTermination()


def land_messages(df: DataFrame, topic: str, key: str) -> None:
    """Append a batch of rows to a file topic."""
    keyed_json(df, key).write.mode("append").json(topic)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run over the input at hand into ``path``, one folder per micro-batch. A replayed batch overwrites its
    own folder, so a restart from the checkpoint leaves no duplicates."""
    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start()
    query.awaitTermination()


def latest_rows(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The newest version of each key of an update-mode table."""
    row = F.struct(*[F.col(c) for c in table.columns if c not in keys and c != "batch"])
    return table.groupBy(*keys).agg(F.max_by(row, "batch").alias("_r")).select(*keys, "_r.*")
