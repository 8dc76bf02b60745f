"""Plans: what reaches the scan, how many shuffles a call costs, what is broadcast."""

import io
import re
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from tidemark.operators import rolling as R
from tidemark.plans.sizing import broadcast_if_small, is_small
from tidemark.plans.series import BARS, TICKS
from tidemark.sources import views as V
from tidemark.sources.files import read_market_parquet


def text(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_time_range_is_pushed_and_columns_are_pruned(spark, sf):
    d = read_market_parquet(spark, f"{sf}/events.parquet", "ts", None, "2024-01-05", "2024-01-06").select("ts", "value")
    plan = text(d)
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(ts", plan)
    schema = re.search(r"ReadSchema: struct<(.*)>", plan).group(1)
    assert "props" not in schema and "user_id" not in schema


def test_all_columns_of_a_window_share_one_exchange(spark, sf):
    plan = text(R.moving_average(V.ticks(spark, sf), "price", (3, 7, 14), TICKS))
    assert len(re.findall(r"^\(\d+\) Exchange", plan, re.M)) == 1


def test_bars_aggregate_before_the_shuffle(spark, sf):
    plan = text(R.horizon_returns(V.bars_1h(spark, sf), s=BARS))
    assert "partial_max_by" in plan or "partial_max" in plan


def test_size_checks(spark, sf):
    small = V.table(spark, sf, "nation")
    assert is_small(small)
    assert "broadcast" in broadcast_if_small(small)._jdf.queryExecution().analyzed().toString().lower()
    huge = spark.range(10**12).withColumn("x", F.col("id") * 2)
    assert not is_small(huge)
    assert "broadcast" not in broadcast_if_small(huge)._jdf.queryExecution().analyzed().toString().lower()
