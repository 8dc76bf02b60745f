"""Model, clustering and graph queries."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tidemark.catalog.aggregates import CORR
from tidemark.catalog.base import query, r, rs, shaped, sql
from tidemark.catalog.rolling import ONCHAIN_SQL, _bar_returns, onchain, wb
from tidemark.functions import rules as X
from tidemark.operators import features as FE
from tidemark.operators import graph as G
from tidemark.operators import models as M
from tidemark.operators import rolling as R
from tidemark.operators.aggregates import correlation_matrix
from tidemark.operators.pairs import correlated_pairs
from tidemark.plans.series import BARS, TICKS, Series
from tidemark.plans.sizing import settled
from tidemark.session import checkpointed
from tidemark.sources import views as V

COLS = ["open", "high", "low", "close", "volume"]


def _q(c, k):
    return f"quantile_cont({c}, {k})"


_CLIP = ", ".join(f"least(greatest({c}, q1_{c} - 1.5 * (q3_{c} - q1_{c})), q3_{c} + 1.5 * (q3_{c} - q1_{c})) AS {c}" for c in COLS)
_QS = ", ".join(f"{_q(c, 0.25)} AS q1_{c}, {_q(c, 0.5)} AS q2_{c}, {_q(c, 0.75)} AS q3_{c}" for c in COLS)


@query("m01_clip_iqr", sql("bars", f"WITH q AS (SELECT {_QS} FROM bars), c AS (SELECT symbol, ts, {_CLIP} FROM bars, q) SELECT symbol, ts, {rs(' '.join(COLS))} FROM c"))
def clip_iqr(spark, sf):
    return shaped(FE.clip_iqr(V.bars_1h(spark, sf), COLS), columns="symbol ts " + " ".join(COLS))


@query("m02_scale_robust", sql("bars", f"WITH q AS (SELECT {_QS} FROM bars) SELECT symbol, ts, {', '.join(r(f'({c} - q2_{c}) / (q3_{c} - q1_{c})') + f' AS {c}' for c in COLS)} FROM bars, q"))
def scale_robust(spark, sf):
    b = V.bars_1h(spark, sf)
    return shaped(FE.apply_scale(b, FE.fit_scale(b, COLS)), columns="symbol ts " + " ".join(COLS))


@query("m02b_scale_standard", sql("bars", f"WITH q AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in COLS)} FROM bars) SELECT symbol, ts, {', '.join(r(f'({c} - m_{c}) / s_{c}') + f' AS {c}' for c in COLS)} FROM bars, q"))
def scale_standard(spark, sf):
    b = V.bars_1h(spark, sf)
    return shaped(FE.apply_scale(b, FE.fit_scale(b, COLS, "standard")), columns="symbol ts " + " ".join(COLS))


@query("m03_feature_pipeline", sql("ticks", f"""WITH {ONCHAIN_SQL},
f AS (SELECT * REPLACE (coalesce(last_value(net_flow IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), first_value(net_flow IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS net_flow) FROM onchain),
x AS (SELECT symbol, ts, avg(net_flow) OVER {wb(7)} AS flow_ma_7, avg(net_flow) OVER {wb(30)} AS flow_ma_30, coalesce(net_flow / nullif(lag(net_flow, 7) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1, 0) AS flow_momentum,
 avg(whales) OVER {wb(7)} AS whale_ma_7, coalesce(stddev_samp(whales) OVER {wb(7)}, 0) AS whale_volatility FROM f)
SELECT symbol, ts, {r('coalesce(flow_ma_7, 0)')} AS flow_ma_7, {r('coalesce(flow_ma_30, 0)')} AS flow_ma_30, {rs('whale_ma_7 whale_volatility')}, {r('flow_momentum', 4)} AS flow_momentum FROM x"""))
def feature_pipeline(spark, sf):
    d = FE.feature_pipeline(onchain(spark, sf), normalize=False)
    return shaped(d, columns="symbol ts flow_ma_7 flow_ma_30 whale_ma_7 whale_volatility flow_momentum", per={"flow_momentum": 4})


@query("m03b_feature_pipeline_scaled")
def feature_pipeline_scaled(spark, sf):
    d = FE.feature_pipeline(onchain(spark, sf))
    return shaped(d.withColumn("n_features", F.size("raw_metrics")).drop("raw_metrics"))


def _labelled(spark, sf):
    from tidemark.operators.joins import return_labels

    b = R.bar_features(settled(V.bars_1h(spark, sf))).na.fill(0.0)  # the bars are read again for labels, training and scores
    return b.join(return_labels(b, b, 1).select("symbol", "ts", "label"), ["symbol", "ts"])


FEATURES = ["ret", "volatility_5", "volatility_24", "momentum_5", "momentum_24"]


def _signals(spark, sf, boosted):
    d = _labelled(spark, sf).withColumn("late", F.col("ts") >= F.lit("2024-01-24").cast("timestamp"))
    model = M.train_signals(d.filter("not late"), FEATURES, boosted=boosted, trees=100, depth=6)
    out = M.score_signals(model, d.filter("late"))
    return shaped(out, 4, "symbol ts label predicted confidence score")


@query("m04_score_signals")
def score_signals(spark, sf):
    return _signals(spark, sf, False)


@query("m04b_score_signals_boosted")
def score_signals_boosted(spark, sf):
    return _signals(spark, sf, True)


@query("m05_predict_regimes")
def predict_regimes(spark, sf):
    d = R.horizon_volatility(_bar_returns(spark, sf), "close", (24,)).select("symbol", "ts", "ret", "volatility_24").na.drop()
    d = d.withColumn("level", F.ln(F.col("volatility_24") + 1))
    model = M.fit_regimes(d, ["level", "ret"], rounds=100)
    return shaped(M.predict_regimes(d, model), 4, "symbol ts state posterior")


def _vectors(spark, sf):
    """Per-symbol features as vectors: mean, deviation and activity of each user's ticks."""
    d = V.ticks(spark, sf).groupBy("symbol").agg((F.avg("price") / 10).alias("x"), (F.stddev_pop("price") / 10).alias("y"), F.count(F.lit(1)).cast("double").alias("n"))
    return VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(d)


@query("m06_kmeans_best_k")
def kmeans_best_k(spark, sf):
    out, k, score = M.kmeans_best_k(_vectors(spark, sf), max_k=8)
    return out.select("symbol", F.col("label").cast("long").alias("label"), F.lit(k).cast("long").alias("k"), F.round(F.lit(score), 4).alias("silhouette"))


@query("m07_spectral_clusters")
def spectral_clusters(spark, sf):
    c = correlation_matrix(V.nation_bars(spark, sf)).filter("corr > 0")
    num = lambda x: F.substring(x, 2, 10).cast("long")
    edges = c.select(num("a").alias("src"), num("b").alias("dst"), F.col("corr").alias("weight"))
    return M.spectral_clusters(edges, 3)


@query("m08_dbscan")
def dbscan(spark, sf):
    d = _vectors(spark, sf).withColumn("id", F.substring("symbol", 2, 12).cast("long"))
    return M.dbscan(d, ["x", "y"], "id", eps=0.15, least=4)


@query("m07b_spectral_points")
def spectral_points(spark, sf):
    return M.spectral_points(_vectors(spark, sf).withColumn("id", F.substring("symbol", 2, 12).cast("long")), ["x", "y"], "id", 3)


@query("m09_consensus_clusters")
def consensus_clusters(spark, sf):
    """K-means, spectral and density labels of the same points; k is that of the best silhouette throughout."""
    v = checkpointed(_vectors(spark, sf).withColumn("id", F.substring("symbol", 2, 12).cast("long")))
    km, k, _ = M.kmeans_best_k(v, max_k=8)
    db = M.dbscan(v, ["x", "y"], "id", eps=0.3, least=3)
    sp = M.spectral_points(v, ["x", "y"], "id", k)
    labels = km.select("id", F.col("label").cast("long").alias("km")).join(db.withColumnRenamed("label", "db"), "id").join(sp.withColumnRenamed("label", "sp"), "id")
    return M.consensus_clusters(checkpointed(labels), ["km", "db", "sp"], "id", k)


LAB = "(CASE WHEN close > 250000 THEN 2 WHEN close > 200000 THEN 1 ELSE 0 END)"


def _labels(spark, sf):
    lab = F.when(F.col("close") > 250000, 2).when(F.col("close") > 200000, 1).otherwise(0)
    month = (F.year("ts") * 12 + F.month("ts")).cast("long")
    return V.nation_bars(spark, sf).select("symbol", month.alias("window_id"), lab.alias("label"), (F.col("volume") > 1200000).cast("int").alias("other"))


ARI = """SELECT {g}, CASE WHEN n < 2 THEN 1.0 WHEN (ai + bj) / 2 = ai * bj / (n * (n - 1) / 2) THEN 1.0 ELSE (ij - ai * bj / (n * (n - 1) / 2)) / ((ai + bj) / 2 - ai * bj / (n * (n - 1) / 2)) END AS ari FROM
(SELECT {g}, sum(n * (n - 1) / 2) AS ij, sum(n) AS n FROM cells GROUP BY {g}) JOIN (SELECT {g}, sum(n * (n - 1) / 2) AS ai FROM (SELECT {g}, l, sum(n) AS n FROM cells GROUP BY {g}, l) GROUP BY {g}) USING ({g})
JOIN (SELECT {g}, sum(n * (n - 1) / 2) AS bj FROM (SELECT {g}, o, sum(n) AS n FROM cells GROUP BY {g}, o) GROUP BY {g}) USING ({g})"""


@query("m10_adjusted_rand", sql("nation_bars", f"""WITH cells AS (SELECT (year(ts) * 12 + month(ts))::BIGINT AS window_id, {LAB} AS l, (volume > 1200000)::INTEGER AS o, count(*)::DOUBLE AS n FROM nation_bars GROUP BY 1, 2, 3),
a AS ({ARI.format(g='window_id')}) SELECT window_id, {r('ari')} AS ari FROM a"""))
def adjusted_rand(spark, sf):
    return shaped(M.adjusted_rand(_labels(spark, sf), "label", "other", ["window_id"]))


@query("m10b_temporal_stability", sql("nation_bars", f"""WITH lab AS (SELECT symbol, (year(ts) * 12 + month(ts))::BIGINT AS w, {LAB} AS l FROM nation_bars),
cells AS (SELECT {{'w': a.w, 'p': b.w}} AS g, a.l AS l, b.l AS o, count(*)::DOUBLE AS n FROM lab a JOIN lab b ON a.symbol = b.symbol AND b.w BETWEEN a.w - 5 AND a.w - 1 GROUP BY 1, 2, 3),
a AS ({ARI.format(g='g')}) SELECT g.w AS window_id, {r('avg(ari)')} AS stability FROM a GROUP BY 1"""))
def temporal_stability(spark, sf):
    return shaped(M.temporal_stability(_labels(spark, sf), "symbol", "window_id", "label"))


@query("m10c_consensus_score", sql("nation_bars", f"""WITH lab AS (SELECT (year(ts) * 12 + month(ts))::BIGINT AS w, {LAB} AS a, (volume > 1200000)::INTEGER AS b, symbol[2:]::INTEGER % 4 AS c FROM nation_bars),
cells AS (SELECT {{'w': w, 'p': p}} AS g, l, o, count(*)::DOUBLE AS n FROM (SELECT w, 1 AS p, a AS l, b AS o FROM lab UNION ALL SELECT w, 2, a, c FROM lab UNION ALL SELECT w, 3, b, c FROM lab) GROUP BY 1, 2, 3),
a AS ({ARI.format(g='g')}) SELECT g.w AS window_id, {r('avg(ari)')} AS consensus_score FROM a GROUP BY 1"""))
def consensus_score(spark, sf):
    d = _labels(spark, sf).withColumn("third", F.substring("symbol", 2, 4).cast("int") % 4)
    return shaped(M.consensus_score(d, ["label", "other", "third"], ["window_id"]))


NATION_LABEL = "lab AS (SELECT DISTINCT symbol, symbol[2:]::INTEGER % 4 AS label FROM nation_bars)"


def _nation_labels(spark, sf):
    return V.nation_bars(spark, sf).select("symbol", (F.substring("symbol", 2, 4).cast("int") % 4).alias("label")).distinct()


@query("m11_cluster_coherence", sql("nation_bars", f"""WITH {CORR}, {NATION_LABEL}, s AS (SELECT label, count(*) AS size FROM lab GROUP BY 1),
m AS (SELECT x.label, avg(abs(corr)) AS c FROM corrs JOIN lab x ON a = x.symbol JOIN lab y ON b = y.symbol WHERE x.label = y.label GROUP BY 1)
SELECT label::BIGINT AS label, size, {r('coalesce(c, CASE WHEN size = 1 THEN 1.0 ELSE 0.0 END)')} AS coherence FROM s LEFT JOIN m USING (label)"""))
def cluster_coherence(spark, sf):
    return shaped(M.cluster_coherence(correlation_matrix(V.nation_bars(spark, sf)), _nation_labels(spark, sf)))


@query("m12_isolation_scores")
def isolation_scores(spark, sf):
    d = M.window_features(V.ticks(spark, sf), "price")
    return shaped(M.isolation_scores(d, ["price", "f_mean", "f_std", "f_min", "f_max"], "seq", trees=100), 4)


@query("m12b_multivariate_isolation")
def multivariate_isolation(spark, sf):
    b = V.bars_1h(spark, sf).withColumn("row_id", F.concat_ws("|", "symbol", F.col("ts").cast("string")))
    d = M.principal_components(b, COLS, 3)
    return shaped(M.isolation_scores(d, ["pc_1", "pc_2", "pc_3"], "row_id", trees=100), 4)


@query("m13_changepoints", sql("bars", f"""WITH s AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS p, count(*) OVER (PARTITION BY symbol) AS n, sum(close) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS c, sum(close) OVER (PARTITION BY symbol) AS t FROM bars),
g AS (SELECT symbol, p, c * c / p + (t - c) * (t - c) / (n - p) - t * t / n AS gain FROM s WHERE p % 5 = 0 AND p >= 2 AND n - p >= 2)
SELECT symbol, arg_max(p, gain) AS position, {r('max(gain)', 3)} AS gain, 1::BIGINT AS round FROM g GROUP BY 1"""))
def changepoints(spark, sf):
    return shaped(M.changepoints(V.bars_1h(spark, sf), "close", BARS, breaks=1), 3)


@query("m13b_changepoints_five")
def changepoints_five(spark, sf):
    return shaped(M.changepoints(V.bars_1h(spark, sf), "close", BARS), 3)


RULES = [("pnl_sudden_drop", "performance_drop", "view", "zscore", 2.0, 24), ("volume_spike", "volume_spike", "click", "zscore", 3.0, 24),
         ("large_loss", "sudden_loss", "purchase", "threshold", 1.0, 1), ("delay", "execution_delay", "signup", "iqr", 1.5, 48)]


def _z(rule, kind, metric, thr, n):
    past = f"(ORDER BY ts, seq ROWS BETWEEN {n - 1} PRECEDING AND 1 PRECEDING)"
    return f"""SELECT '{rule}' AS rule, '{kind}' AS anomaly_type, metric, seq, abs(z) AS magnitude, least(0.99, abs(z) / 5) AS confidence,
 CASE WHEN abs(z) >= {3 * thr} THEN 'critical' WHEN abs(z) >= {2 * thr} THEN 'high' WHEN abs(z) >= {1.5 * thr} THEN 'medium' ELSE 'low' END AS severity FROM
 (SELECT symbol AS metric, seq, CASE WHEN count(price) OVER {past} >= {n - 1} THEN (price - avg(price) OVER {past}) / nullif(stddev_pop(price) OVER {past}, 0) END AS z FROM channel_ticks WHERE symbol = '{metric}') WHERE abs(z) >= {thr}"""


@query("m14_anomaly_rules", sql("channel_ticks", f"""WITH a AS ({_z('pnl_sudden_drop', 'performance_drop', 'view', 2.0, 24)} UNION ALL {_z('volume_spike', 'volume_spike', 'click', 3.0, 24)}
UNION ALL SELECT 'large_loss', 'sudden_loss', symbol, seq, abs(price), 0.95, CASE WHEN abs(price) >= 3 THEN 'critical' WHEN abs(price) >= 2 THEN 'high' WHEN abs(price) >= 1.5 THEN 'medium' ELSE 'low' END FROM channel_ticks WHERE symbol = 'purchase' AND price <= 1.0
UNION ALL SELECT 'delay', 'execution_delay', symbol, seq, dist, least(0.99, dist / 3), CASE WHEN dist >= 4.5 THEN 'critical' WHEN dist >= 3 THEN 'high' WHEN dist >= 2.25 THEN 'medium' ELSE 'low' END FROM (
 SELECT symbol, seq, CASE WHEN price < q1 - 1.5 * (q3 - q1) THEN (q1 - 1.5 * (q3 - q1) - price) / (q3 - q1) WHEN price > q3 + 1.5 * (q3 - q1) THEN (price - q3 - 1.5 * (q3 - q1)) / (q3 - q1) END AS dist FROM (
 SELECT symbol, seq, price, count(*) OVER w AS c, quantile_cont(price, 0.25) OVER w AS q1, quantile_cont(price, 0.75) OVER w AS q3 FROM channel_ticks WHERE symbol = 'signup' WINDOW w AS (ORDER BY ts, seq ROWS BETWEEN 47 PRECEDING AND CURRENT ROW)) WHERE c >= 48) WHERE dist IS NOT NULL)
SELECT rule, anomaly_type, metric, seq, severity, {rs('confidence magnitude', 5)} FROM a"""))
def anomaly_rules(spark, sf):
    d = V.channel_ticks(spark, sf).select(F.col("symbol").alias("metric"), "ts", "seq", F.col("price").alias("value"))
    return shaped(FE.anomaly_rules(d, RULES), 5, "rule anomaly_type metric seq severity confidence magnitude")


ENGINE_RULES = [*RULES, ("late_volume", "volume_spike", "view", "zscore", 2.5, 12), ("odd_signup", "performance_drop", "signup", "isolation_forest", 0.05, 1),
                ("error_shift", "correlation_break", "error", "changepoint", 0.05, 48), ("error_range", "system_error", "error", "iqr", 1.0, 24), ("odd_click", "volume_spike", "click", "isolation_forest", 0.1, 1)]


@query("m14b_all_methods")
def anomaly_rules_all_methods(spark, sf):
    d = V.channel_ticks(spark, sf).select(F.col("symbol").alias("metric"), "ts", "seq", F.col("price").alias("value"))
    return shaped(FE.anomaly_rules(d, ENGINE_RULES), 5, "rule anomaly_type metric seq severity confidence magnitude")


def _windows(spark, sf, size=36, stride=12):
    return R.stride_windows(G.prepared_bars(V.nation_bars(spark, sf)), size, stride)


PREP = f"""p0 AS (SELECT symbol, ts, close, volume, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM nation_bars), p1 AS (SELECT *, close / nullif(p, 0) - 1 AS ret, close - p AS d FROM p0),
prep AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS total, CASE WHEN count(ret) OVER {wb(5)} >= 5 THEN stddev_samp(ret) OVER {wb(5)} END AS v5, CASE WHEN count(ret) OVER {wb(24)} >= 24 THEN stddev_samp(ret) OVER {wb(24)} END AS v24,
 CASE WHEN count(d) OVER {wb(13)} < 13 THEN 0.5 WHEN avg(greatest(-d, 0)) OVER {wb(13)} = 0 THEN 0.5 ELSE 1 - 1 / (1 + avg(greatest(d, 0)) OVER {wb(13)} / avg(greatest(-d, 0)) OVER {wb(13)}) END AS rsi,
 CASE WHEN count(close) OVER {wb(20)} >= 20 THEN coalesce((close - min(close) OVER {wb(20)}) / nullif(max(close) OVER {wb(20)} - min(close) OVER {wb(20)}, 0), 0.5) ELSE 0.5 END AS rp FROM p1),
win AS (SELECT prep.*, g.w AS window_id, i - g.w * 12 AS k FROM prep, (SELECT range AS w FROM range(100)) g WHERE i >= g.w * 12 AND i < g.w * 12 + 36 AND g.w * 12 + 36 <= total)"""
MOM = "avg(ret) AS m1, avg(ret ** 2) AS m2, avg(ret ** 3) AS m3, avg(ret ** 4) AS m4, stddev_pop(ret) AS sd"
NODES = f"""n0 AS (SELECT window_id, symbol, max(close) FILTER (k = 35) AS c35, max(close) FILTER (k = 0) AS c0, max(close) FILTER (k = 31) AS c31, max(close) FILTER (k = 12) AS c12, arg_max(v5, k) AS volatility_5, arg_max(v24, k) AS volatility_24,
 ln(arg_max(volume, k) / avg(volume) + 1) AS volume_log, arg_max(ret, k) AS recent_return, {MOM}, arg_max(rsi, k) AS rsi, arg_max(rp, k) AS range_position FROM win GROUP BY 1, 2),
nodes AS (SELECT window_id, symbol, c35 / c0 AS price_norm, c35 / c31 - 1 AS momentum_5, c35 / c12 - 1 AS momentum_24, coalesce(volatility_5, 0) AS volatility_5, coalesce(volatility_24, 0) AS volatility_24, volume_log, recent_return, sd AS return_std,
 (m3 - 3 * m1 * m2 + 2 * m1 ** 3) / sd ** 3 AS skewness, (m4 - 4 * m1 * m3 + 6 * m1 ** 2 * m2 - 3 * m1 ** 4) / sd ** 4 - 3 AS kurtosis, rsi, range_position FROM n0)"""


@query("w37_window_moments", sql("nation_bars", f"WITH {PREP}, {NODES} SELECT window_id, symbol, {rs(' '.join(G.NODE_FEATURES), 5)} FROM nodes"))
def window_moments(spark, sf):
    return shaped(G.graph_nodes(_windows(spark, sf), scaled=False), 5)


_NQ = ", ".join(f"quantile_cont({c}, 0.5) AS q2_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS w_{c}" for c in G.NODE_FEATURES)


@query("g01_graph_nodes", sql("nation_bars", f"WITH {PREP}, {NODES}, q AS (SELECT {_NQ} FROM nodes WHERE window_id = 0) SELECT window_id, symbol, {', '.join(r(f'({c} - q2_{c}) / CASE WHEN w_{c} = 0 THEN 1 ELSE w_{c} END', 4) + f' AS {c}' for c in G.NODE_FEATURES)} FROM nodes, q"))
def graph_nodes(spark, sf):
    return shaped(G.graph_nodes(_windows(spark, sf)), 4)


EDGES = """pr AS (SELECT a.window_id, a.symbol AS a, b.symbol AS b, coalesce(corr(a.ret, b.ret), 0) AS weight FROM win a JOIN win b ON a.window_id = b.window_id AND a.ts = b.ts AND a.symbol < b.symbol WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 5),
st AS (SELECT * FROM pr WHERE abs(weight) >= 0.3), no AS (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY abs(weight) DESC, a, b) AS k FROM pr WHERE window_id NOT IN (SELECT window_id FROM st)),
ke AS (SELECT window_id, a, b, weight FROM st UNION ALL SELECT window_id, a, b, weight FROM no WHERE k <= 50), bo AS (SELECT * FROM ke UNION ALL SELECT window_id, b, a, weight FROM ke),
edges AS (SELECT window_id, a, b, weight FROM (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY abs(weight) DESC, a, b) AS k FROM bo) WHERE k <= 100)"""


@query("g02_graph_edges", sql("nation_bars", f"WITH {PREP}, {EDGES} SELECT window_id, a, b, {r('weight')} AS weight FROM edges"))
def graph_edges(spark, sf):
    return shaped(G.graph_edges(_windows(spark, sf), max_edges=100))


@query("g03_liquid_symbols", sql("nation_bars", f"""WITH k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM nation_bars), a AS (SELECT symbol, avg(volume) AS avg_volume FROM k WHERE k <= 30 GROUP BY 1)
SELECT symbol, {r('avg_volume', 2)} AS avg_volume FROM a WHERE avg_volume >= 1000000"""))
def liquid_symbols(spark, sf):
    return shaped(G.liquid_symbols(V.nation_bars(spark, sf)), 2)


@query("g04_intra_cluster_pairs", sql("nation_bars", f"""WITH {CORR}, {NATION_LABEL}, f AS (SELECT symbol, arg_min(close, ts) AS c0 FROM nation_bars GROUP BY 1), n AS (SELECT symbol, ts, close / c0 AS p FROM nation_bars JOIN f USING (symbol)),
p AS (SELECT c.a, c.b, c.corr, x.label FROM corrs c JOIN lab x ON a = x.symbol JOIN lab y ON b = y.symbol WHERE x.label = y.label AND corr >= 0),
g AS (SELECT p.a, p.b, label, corr, arg_max(abs(u.p - v.p), u.ts) AS spread, avg(abs(u.p - v.p)) AS mean, stddev_pop(abs(u.p - v.p)) AS std FROM p JOIN n u ON u.symbol = p.a JOIN n v ON v.symbol = p.b AND v.ts = u.ts GROUP BY 1, 2, 3, 4),
z AS (SELECT *, (spread - mean) / std AS z FROM g) SELECT a, b, label::BIGINT AS label, {rs('corr spread z', 5)}, {r('abs(z) * std', 5)} AS expected_return FROM z WHERE abs(z) >= 0.5"""))
def intra_cluster_pairs(spark, sf):
    b = V.nation_bars(spark, sf)
    d = G.intra_cluster_pairs(b, _nation_labels(spark, sf), correlated_pairs(b, at_least=0.0), 0.0, 0.5)
    return shaped(d, 5, "a b label corr spread z expected_return")


@query("g05_cross_cluster_pairs", sql("nation_bars", f"""WITH {CORR}, {NATION_LABEL}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM nation_bars), v AS (SELECT symbol, avg(volume) AS v FROM k WHERE k <= 30 GROUP BY 1),
sz AS (SELECT label FROM lab GROUP BY 1 HAVING count(*) BETWEEN 2 AND 20), rep AS (SELECT label, arg_max(symbol, (v, symbol)) AS symbol FROM v JOIN lab USING (symbol) JOIN sz USING (label) GROUP BY 1),
m AS (SELECT symbol, max(close) FILTER (k = 1) / max(close) FILTER (k = 10) - 1 AS m FROM k GROUP BY 1), r AS (SELECT rep.symbol, label, m FROM rep JOIN m USING (symbol))
SELECT a, b, {r('corr', 5)} AS corr, {r('abs(x.m - y.m)', 5)} AS divergence, {r('abs(x.m - y.m) * 0.5', 5)} AS expected_return FROM corrs JOIN r x ON a = x.symbol JOIN r y ON b = y.symbol WHERE x.label <> y.label AND corr <= 0.1 AND abs(x.m - y.m) >= 0.01"""))
def cross_cluster_pairs(spark, sf):
    b = V.nation_bars(spark, sf)
    d = G.cross_cluster_pairs(b, _nation_labels(spark, sf), correlated_pairs(b, at_most=0.1), 0.1, 0.01)
    return shaped(d, 5, "a b corr divergence expected_return")


def _mix(src: str) -> str:
    near = f"SELECT e.window_id, e.a AS symbol, sum(n.price_norm * abs(weight)) / sum(abs(weight)) AS pn, sum(n.rsi * abs(weight)) / sum(abs(weight)) AS rs FROM edges e JOIN {src} n ON n.window_id = e.window_id AND n.symbol = e.b GROUP BY 1, 2"
    return f"SELECT n.window_id, n.symbol, 0.5 * price_norm + 0.5 * coalesce(pn, price_norm) AS price_norm, 0.5 * rsi + 0.5 * coalesce(rs, rsi) AS rsi FROM {src} n LEFT JOIN ({near}) m ON m.window_id = n.window_id AND m.symbol = n.symbol"


@query("g06_neighbour_embeddings", sql("nation_bars", f"WITH {PREP}, {NODES}, {EDGES}, r1 AS ({_mix('nodes')}), r2 AS ({_mix('r1')}) SELECT window_id, symbol, {rs('price_norm rsi', 5)} FROM r2"))
def neighbour_embeddings(spark, sf):
    w = _windows(spark, sf)
    d = G.neighbour_embeddings(G.graph_nodes(w, scaled=False), G.graph_edges(w, max_edges=100), ["price_norm", "rsi"])
    return shaped(d, 5)
