"""Queries against their SQL on the same tables. ALL_QUERIES=1 runs every one."""

import os

import duckdb
import pytest

from check import TABLES, TYPES, rows_of
from tidemark.catalog import load

QUERIES, ORACLES = load()
CHOSEN = """w03_momentum w07_trend_slope w22_zscore_anomaly w30_adaptive_thresholds e16_regime_alerts e19_adapt_parameters j01_pair_prices
j03_nearest_join j04_asof_join j13_period_membership a01_performance_metrics a09_regime_durations a10_alert_counts a16_kelly_fraction
b02_apply_increments b04_validate_books b07_book_checksum b15_market_fills b16_limit_fills w25_excursions s01_read_market_csv s03_read_recordings
s09_upsert_orders s14_parse_metric_payload d01_check_constraints o03_top_edges u04_merge_intervals v06_cv_validate t05_promotion_decision
st01_kalman_hedge_ratio st06_average_cost_positions st08_threshold_signals w09_macd m10_adjusted_rand m14_anomaly_rules g02_graph_edges
x02_tumbling_windows x05_stream_stream_join x08_kalman_stream""".split()
NAMES = sorted(ORACLES) if os.environ.get("ALL_QUERIES") else CHOSEN


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(name, spark, sf, con):
    df = QUERIES[name](spark, sf)
    cur = con.execute(ORACLES[name])
    names, want = [d[0] for d in cur.description], cur.fetchall()
    types = {d[0]: str(d[1]) for d in con.execute(f"DESCRIBE {ORACLES[name]}").fetchall()}
    assert sorted(df.columns) == sorted(names)
    assert {c: TYPES.get(types[c]) for c in types} == dict(df.dtypes)
    assert rows_of(df.columns, df.collect()) == rows_of(names, want)


def test_every_query_has_a_unique_name_and_reads_tables():
    assert len(QUERIES) > 180 and set(ORACLES) <= set(QUERIES)
