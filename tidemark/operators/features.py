"""Feature scaling, the on-chain feature pipeline and rule-driven anomaly detection."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.maths import clip, ratio
from tidemark.functions.rules import severity
from tidemark.operators import rolling as R
from tidemark.plans.quantiles import exact_percentiles
from tidemark.plans.series import BARS, TICKS, Series
from tidemark.session import checkpointed


Fitted = dict[str, tuple[float, float]]


def column_quartiles(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float, float]]:
    """q1, median and q3 of every column from one pass over the stacked columns; columns without a value
    are left out. Three numbers per column are what a fitted scaler holds."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "column", "value")
    rows = exact_percentiles(long, ["column"], "value", {"q1": 0.25, "q2": 0.5, "q3": 0.75}).collect()
    return {r["column"]: (r["q1"], r["q2"], r["q3"]) for r in rows}


def clip_iqr(df: DataFrame, columns: Sequence[str], k: float = 1.5, quartiles: dict | None = None) -> DataFrame:
    """Clip each column to its quartiles widened by k interquartile ranges."""
    q = quartiles if quartiles is not None else column_quartiles(df, columns)
    bounds = {c: (v[0] - k * (v[2] - v[0]), v[2] + k * (v[2] - v[0])) for c, v in q.items() if c in columns}
    return df.withColumns({c: F.when(F.col(c).isNotNull(), clip(c, *b)) for c, b in bounds.items()})


def fit_scale(df: DataFrame, columns: Sequence[str], method: str = "robust") -> Fitted:
    """Centre and width of each column, nulls counted as 0; a zero width reads 1."""
    filled = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    if method == "robust":
        return {c: (q2, (q3 - q1) or 1.0) for c, (q1, q2, q3) in column_quartiles(filled, columns).items()}
    row = filled.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"] or 1.0) for c in columns}


def apply_scale(df: DataFrame, fitted: Fitted) -> DataFrame:
    return df.withColumns({c: (F.coalesce(F.col(c), F.lit(0.0)) - F.lit(mid)) / F.lit(width) for c, (mid, width) in fitted.items()})


def feature_pipeline(metrics: DataFrame, s: Series = BARS, normalize: bool = True, base: Sequence[str] = ("net_flow", "addresses", "whales")) -> DataFrame:
    """Gap filling, rolling, statistical, technical, cross and composite features, clipping, robust scaling,
    null to 0; named features plus every number in a map. All windows share one key and order."""
    d = metrics
    for c in base:
        d = R.fill_gaps(d, c, c, s)
    made: list[str] = []
    for c in base:
        before = set(d.columns)
        for step, arg in ((R.moving_average, (3, 7, 14, 30)), (R.volatility, (7, 14)), (R.momentum, (7, 14, 30)), (R.rolling_zscore, (30, 60)),
                          (R.rolling_percentile_rank, (30,)), (R.mad_score, (14,)), (R.trend_slope, (7, 14))):
            d = step(d, c, arg, s=s)
        d = R.bollinger(R.rsi_simple(d, c, s=s), c, s=s)
        fresh = [x for x in d.columns if x not in before]
        d = d.withColumnsRenamed({x: f"{c}_{x}" for x in fresh})
        made += [f"{c}_{x}" for x in fresh]
    d = R.composite_scores(R.cross_features(d), s)
    made += ["flow_ratio", "flow_pressure", "tx_per_address", "whale_dominance", "hodl_ratio", "valuation", "bullish", "bearish", "momentum"]
    if normalize:
        numeric = [*base, *made]
        d = clip_iqr(checkpointed(d), numeric)  # read three times: two fits and the result
        d = apply_scale(d, fit_scale(d, numeric))
    d = d.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in (*base, *made)})
    raw = F.map_from_arrays(F.array(*[F.lit(c) for c in (*base, *made)]), F.array(*[F.col(c) for c in (*base, *made)]))
    return d.select(
        *s.keys, *s.order, F.col("net_flow_ma_7").alias("flow_ma_7"), F.col("net_flow_ma_30").alias("flow_ma_30"),
        F.col("net_flow_momentum_7").alias("flow_momentum"), F.col("whales_ma_7").alias("whale_ma_7"),
        F.col("whales_volatility_7").alias("whale_volatility"), "bullish", "bearish", "momentum", raw.alias("raw_metrics"),
    )


# Detection rules as (rule, anomaly type, metric, method, threshold, window).
DETECTION_RULES = [
    ("pnl_sudden_drop", "performance_drop", "pnl", "zscore", 2.0, 24),
    ("pnl_large_loss", "sudden_loss", "pnl", "threshold", -1000.0, 1),
    ("volume_spike", "volume_spike", "volume", "zscore", 3.0, 24),
    ("execution_delay", "execution_delay", "response_time", "zscore", 2.5, 12),
    ("error_rate_spike", "system_error", "error_rate", "zscore", 2.0, 6),
    ("correlation_breakdown", "correlation_break", "correlation", "changepoint", 0.3, 48),
    ("funding_rate_anomaly", "funding_rate_anomaly", "funding_rate", "zscore", 2.5, 24),
]


FRAME_ROWS = 20_000  # rows of a block: the frames of a row cost far more than its way to the block


def anomaly_rules(series: DataFrame, rules=DETECTION_RULES, s: Series = Series(("metric",), ("ts", "seq"))) -> DataFrame:
    """Findings of every rule on its metric's series (metric, ts, seq, value), however many rules there are.

    Rules are grouped by method and window: one scan over the series computes the frames of all z-score, IQR and
    threshold rules and each row lists the rules it breaks; one segmentation serves all change-point rules, and one
    set of forests, one per metric, all isolation-forest rules.
    """
    from tidemark.operators.models import changepoint_anomalies, isolation_scores, window_features

    unknown = {r[3] for r in rules} - {"zscore", "iqr", "threshold", "changepoint", "isolation_forest"}
    if unknown:
        raise ValueError(f"unknown methods {sorted(unknown)}")
    (name,) = s.keys
    of = lambda *methods: [r for r in rules if r[3] in methods]
    among = lambda some: F.col(name).isin(sorted({r[2] for r in some}))
    x = F.col("value")

    def listed(d: DataFrame, hits) -> DataFrame:
        """One row per rule of ``hits`` (rule, condition, magnitude, confidence, what severity goes by) that holds."""
        found = [F.when((F.col(name) == r[2]) & holds, F.struct(F.lit(r[0]).alias("rule"), F.lit(r[1]).alias("anomaly_type"), severity(by, r[4]).alias("severity"),
                                                               confidence.cast("double").alias("confidence"), magnitude.cast("double").alias("magnitude"))) for r, holds, magnitude, confidence, by in hits]
        d = d.withColumn("_hit", F.explode(F.filter(F.array(*found), lambda h: h.isNotNull())))
        return d.select("_hit.rule", "_hit.anomaly_type", name, *s.order, "_hit.severity", "_hit.confidence", "_hit.magnitude")

    parts = []
    framed = of("zscore", "iqr", "threshold")
    if framed:
        def build(d: DataFrame, w) -> DataFrame:
            out = {}
            for n in sorted({r[5] for r in of("zscore")}):
                past = w.rowsBetween(-(n - 1), -1)
                out[f"_z{n}"] = F.when(F.count(x).over(past) >= n - 1, ratio(x - F.avg(x).over(past), F.stddev_pop(x).over(past)))
            for n in sorted({r[5] for r in of("iqr")}):
                out[f"_s{n}"] = F.sort_array(F.collect_list(f"_v{n}").over(w.rowsBetween(-(n - 1), 0)))  # one list for both quartiles
            return d.withColumns(out)

        def quartile(n: int, p: float) -> Column:
            """As ``percentile`` has it, on full frames."""
            seen, at = F.col(f"_s{n}"), (n - 1) * p
            below, above = F.get(seen, F.lit(math.floor(at))), F.get(seen, F.lit(math.ceil(at)))
            between = below if at == int(at) else F.when(below == above, below).otherwise((math.ceil(at) - at) * below + (at - math.floor(at)) * above)
            return F.when(F.size(seen) >= n, between)

        hits = []
        for r in framed:
            _, _, _, method, threshold, n = r
            if method == "zscore":
                z = F.abs(f"_z{n}")
                hits.append((r, z >= threshold, z, F.least(F.lit(0.99), z / 5.0), f"_z{n}"))
            elif method == "iqr":
                lo, hi = quartile(n, 0.25), quartile(n, 0.75)
                width = hi - lo
                beyond = F.when(x < lo - threshold * width, ratio(lo - threshold * width - x, width)).when(x > hi + threshold * width, ratio(x - hi - threshold * width, width))
                hits.append((r, beyond.isNotNull(), beyond, F.least(F.lit(0.99), beyond / 3.0), beyond))
            else:
                hits.append((r, x <= threshold, F.abs(x), F.lit(0.95), x))
        asked = {n: among([r for r in of("iqr") if r[5] == n]) for n in sorted({r[5] for r in of("iqr")})}
        data = series.filter(among(framed)).select(name, *s.order, "value", *[F.when(v, x).alias(f"_v{n}") for n, v in asked.items()])  # no quartiles where no rule asks for them
        halo = max([r[5] - 1 for r in of("zscore", "iqr")], default=0)
        parts.append(listed(R.over_rows(data, s, build, halo, most=FRAME_ROWS) if halo else data, hits))
    if of("changepoint"):
        moved = changepoint_anomalies(series.filter(among(of("changepoint"))), "value", s, 0.0).select(name, *s.order, F.col("magnitude").alias("_m"))
        parts.append(listed(moved, [(r, F.col("_m") >= r[4], F.col("_m"), F.lit(0.8), F.col("_m")) for r in of("changepoint")]))
    if of("isolation_forest"):
        data = window_features(series.filter(among(of("isolation_forest"))).select(name, *s.order, "value"), "value", s)
        scored = isolation_scores(data, ["value", "f_mean", "f_std", "f_min", "f_max"], [name, *s.order], group=name)
        far = scored.filter("anomaly").select(name, *s.order, F.abs(F.col("score") - F.col("cut")).alias("_m"))
        parts.append(listed(far, [(r, F.lit(True), F.col("_m"), F.least(F.lit(0.95), F.col("_m")), F.col("_m")) for r in of("isolation_forest")]))
    return reduce(DataFrame.unionByName, parts)
