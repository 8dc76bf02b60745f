"""Payloads of a key that holds all rows of one day stay bounded, and no point is lost."""

from pyspark.sql import functions as F

from tidemark.catalog import store


def test_payloads_of_a_hot_key_are_bounded(spark, monkeypatch):
    landed, parse = [], store.S.parse_metric_payload
    channel = F.when(F.col("id") % 2 == 0, "view").otherwise("error")
    ticks = spark.range(50_000).select(F.lit("S1").alias("symbol"), (F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id"))).alias("ts"), F.col("id").alias("seq"), F.col("id").cast("double").alias("price"), channel.alias("channel"))
    monkeypatch.setattr(store.V, "ticks", lambda spark, sf: ticks)
    monkeypatch.setattr(store.S, "parse_metric_payload", lambda d: landed.append(d) or parse(d))
    got = {r["field"]: r["n"] for r in store.parse_metric_payload(spark, "").groupBy("field").agg(F.count("*").alias("n")).collect()}
    assert got == {"value": 25_000 - 5_000, "inflow": 25_000, "outflow": 25_000, "net_flow": 25_000}
    sizes = [r["n"] for r in landed[0].select((F.size(F.split("payload", '[{]"t')) - 1).alias("n")).collect()]
    assert sum(sizes) == 50_000 and max(sizes) <= 10_000, sizes
