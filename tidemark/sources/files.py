"""File sources and sinks: CSV and Parquet market data, recordings, metric payloads, logs, results."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.session import checkpoint_folder

BOOK_CSV = "timestamp timestamp, bids string, asks string, sequence_id bigint"
TRADE_CSV = "timestamp timestamp, price double, quantity double, side string, trade_id bigint"
RECORDING = (
    "timestamp timestamp, type string, bids array<array<string>>, asks array<array<string>>, final_update_id bigint, "
    "price string, quantity string"
)
LEVELS = "array<array<double>>"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder of the cluster (a temporary one in tests)."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def file_symbol(suffix: str) -> Column:
    """Symbol of a row: the ``symbol=`` folder of its file, else the upper-case stem of the file name."""
    path = F.col("_metadata.file_path")
    folder = F.regexp_extract(path, "/symbol=([^/]+)/", 1)
    return F.upper(F.when(folder != "", folder).otherwise(F.regexp_extract(path, rf"([^/]+?)\.{suffix}(\.gz)?$", 1)))


def levels_of(text: str | Column) -> Column:
    """``[[price, quantity], ...]`` as level structs; unreadable text gives no levels."""
    raw = F.coalesce(F.from_json(text, LEVELS), F.array().cast(LEVELS))
    good = F.filter(raw, lambda p: F.size(p) >= 2)
    return F.transform(good, lambda p: F.struct(p[0].alias("price"), p[1].alias("quantity")))


def _in_range(df: DataFrame, start, end, ts: str = "ts") -> DataFrame:
    if start is not None:
        df = df.filter(F.col(ts) >= F.lit(start).cast("timestamp"))
    return df if end is None else df.filter(F.col(ts) <= F.lit(end).cast("timestamp"))


def read_market_csv(spark: SparkSession, path: str, kind: str = "trades", symbol: str | None = None, start=None, end=None) -> DataFrame:
    """CSV files per symbol: ``trades`` (price, quantity, side) or ``books`` (level lists as JSON). The schema
    is declared; rows without time, or trades without price or quantity, are dropped."""
    schema = BOOK_CSV if kind == "books" else TRADE_CSV
    raw = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).csv(path)
    d = raw.withColumn("symbol", file_symbol("csv")).withColumnRenamed("timestamp", "ts").filter("ts is not null")
    if symbol is not None:
        d = d.filter(F.col("symbol") == symbol.upper())
    d = _in_range(d, start, end)
    if kind == "books":
        return d.select("symbol", "ts", levels_of("bids").alias("bids"), levels_of("asks").alias("asks"), F.coalesce("sequence_id", F.lit(0)).alias("sequence_id"))
    side = F.when(F.lower(F.coalesce("side", F.lit("buy"))) == "buy", "buy").otherwise("sell")
    return d.filter("price is not null and quantity is not null").select("symbol", "ts", "price", "quantity", side.alias("side"), "trade_id")


def read_market_parquet(spark: SparkSession, path: str, ts: str = "ts", symbol: str | None = None, start=None, end=None) -> DataFrame:
    """Parquet market data; symbol and time range reach the scan as pushed filters."""
    d = spark.read.parquet(path)
    if symbol is not None:
        d = d.filter(F.col("symbol") == symbol)
    return _in_range(d, start, end, ts)


def read_recordings(spark: SparkSession, path: str, start=None, end=None) -> DataFrame:
    """Gzipped JSON lines in files named ``SYMBOL_start_end``: files outside the range are skipped by name,
    then rows by time. Order-book updates and trade ticks come back in one frame."""
    raw = spark.read.schema(RECORDING).option("recursiveFileLookup", True).json(path)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([A-Za-z0-9]+_\d{4}-?\d{2}-?\d{2}_\d{4}-?\d{2}-?\d{2})[^/]*(?:/[^/]*)?$", 1)
    parts = F.split(name, "_")
    d = raw.withColumns({"symbol": F.upper(parts[0]), "_from": F.try_to_timestamp(parts[1]), "_to": F.try_to_timestamp(parts[2])})
    if end is not None:
        d = d.filter(F.col("_from") <= F.lit(end).cast("timestamp"))
    if start is not None:
        d = d.filter(F.col("_to") >= F.lit(start).cast("timestamp"))
    d = _in_range(d.withColumnRenamed("timestamp", "ts"), start, end).filter(F.col("type").isin("order_book_update", "trade_tick"))

    def levels(c: str) -> Column:
        return F.transform(c, lambda p: F.struct(p[0].cast("double").alias("price"), p[1].cast("double").alias("quantity")))

    return d.select("symbol", "ts", F.col("type").alias("kind"), levels("bids").alias("bids"), levels("asks").alias("asks"),
                    F.coalesce("final_update_id", F.lit(0)).alias("sequence_id"), F.col("price").cast("double").alias("price"), F.col("quantity").cast("double").alias("quantity"))


def symbol_catalog(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.groupBy("symbol").agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("rows"))


def merge_symbols(*frames: DataFrame, order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """All symbols in one frame in time order (a range-partitioned sort)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.orderBy(*order)


def parse_metric_payload(df: DataFrame, payload: str = "payload") -> DataFrame:
    """API payloads to long points: a list ``[{t, v}]`` or ``{"result": [{timestamp, inflow, outflow}]}``.

    Points without a value are dropped; epoch seconds become timestamps. Input: symbol, metric, source, payload.
    """
    points = F.from_json(payload, "array<struct<t: bigint, v: double>>")
    result = F.from_json(payload, "result array<struct<timestamp: bigint, inflow: double, outflow: double>>")["result"]
    plain = F.transform(points, lambda p: F.struct(p["t"].alias("t"), F.lit("value").alias("field"), p["v"].alias("value")))
    zero = F.lit(0.0)

    def flows(p: Column) -> Column:
        inflow, outflow = F.coalesce(p["inflow"], zero), F.coalesce(p["outflow"], zero)
        fields = (("inflow", inflow), ("outflow", outflow), ("net_flow", outflow - inflow))
        return F.array(*[F.struct(p["timestamp"].alias("t"), F.lit(n).alias("field"), v.alias("value")) for n, v in fields])

    rows = F.when(F.ltrim(payload).startswith("["), plain).otherwise(F.flatten(F.transform(result, flows)))
    d = df.withColumn("_p", F.explode(rows)).filter("_p.t is not null and _p.value is not null")
    return d.select(F.upper("symbol").alias("symbol"), "metric", "source", F.timestamp_seconds("_p.t").alias("ts"), F.col("_p.field").alias("field"),
                    F.col("_p.value").alias("value"), F.create_map(F.lit("source"), F.col("source")).alias("metadata"))


def scan_logs(spark: SparkSession, path: str, level: str) -> DataFrame:
    """Lines that contain a level name in any case, with their file."""
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    return filter_log_lines(lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")), level)


def filter_log_lines(lines: DataFrame, level: str) -> DataFrame:
    return lines.filter(F.upper("line").contains(level.upper()))


def write_results(df: DataFrame, path: str, by: str = "split_id") -> None:
    """Results as JSON files, one folder per split."""
    df.write.mode("overwrite").partitionBy(by).json(path)
