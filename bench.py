"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.catalog import load  # noqa: E402
from tidemark.session import local_session  # noqa: E402

HEADLINE = """a01_performance_metrics a02_trade_statistics a09_regime_durations a16_kelly_fraction a20_daily_pnl a25_latency_quantiles
b02_apply_increments b07_book_checksum b12_trade_intensity b15_market_fills b16_limit_fills e19_adapt_parameters e22_order_risk_checks
g02_graph_edges j01_pair_prices j03_nearest_join j04_asof_join m14_anomaly_rules o01_dedupe_rank_anomalies s09_upsert_orders
st01_kalman_hedge_ratio st02_bocd st06_average_cost_positions st08_threshold_signals t01_jobson_korkie u04_merge_intervals v06_cv_validate
w04_rolling_zscore w05_percentile_rank w06_mad_score w22_zscore_anomaly w25_excursions w30_adaptive_thresholds""".split()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, max(8, cpus), os.environ.get("BENCH_MEMORY", "12g"))
    spark.sparkContext.setLogLevel("OFF")
    queries, _ = load()
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
