"""Trained and iterative models: classifiers, regimes, clustering, isolation scores, change points."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.clustering import KMeans, PowerIterationClustering
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from tidemark.functions.maths import clip, ratio
from tidemark.functions.rules import LABEL_SCORES, label_score, severity
from tidemark.operators.ranking import top_per_key
from tidemark.operators.rolling import _windowed
from tidemark.plans.quantiles import exact_percentiles
from tidemark.plans.series import BARS, TICKS, Series, rows_before, running, with_position
from tidemark.plans.sizing import broadcast_if_small
from tidemark.plans.sums import summed
from tidemark.session import checkpointed

SEED = 42


# ---- signal models -------------------------------------------------------------------------------

def train_signals(df: DataFrame, features: Sequence[str], label: str = "label", boosted: bool = False, trees: int = 20, depth: int = 5) -> dict:
    """Fit a label classifier and a score regressor on the same rows. Boosting is one-against-rest, with
    one binary booster per label seen (at most the five labels)."""
    assemble = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    d = checkpointed(assemble.transform(df.withColumn("label_score", label_score(label))).select("features", label, "label_score"))
    unknown = d.where(F.col(label).isNull() | ~F.col(label).isin(list(LABEL_SCORES))).select(label).first()
    if unknown is not None:
        raise ValueError(f"unknown label {unknown[0]!r}; labels are {sorted(LABEL_SCORES)}")
    labels = sorted(r[0] for r in d.select(label).distinct().collect())
    if boosted:
        binary = lambda x: d.withColumn("_y", (F.col(label) == x).cast("double"))
        classifiers = [GBTClassifier(labelCol="_y", maxIter=trees, maxDepth=depth, seed=SEED).fit(binary(x)) for x in labels]
        regressor = GBTRegressor(labelCol="label_score", predictionCol="score_prediction", maxIter=trees, maxDepth=depth, seed=SEED).fit(d)
    else:
        index = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(d)
        classifiers = [RandomForestClassifier(labelCol="_y", numTrees=trees, maxDepth=depth, seed=SEED).fit(index.transform(d))]
        regressor = RandomForestRegressor(labelCol="label_score", predictionCol="score_prediction", numTrees=trees, maxDepth=depth, seed=SEED).fit(d)
    return {"assemble": assemble, "labels": labels, "classifiers": classifiers, "regressor": regressor, "features": list(features)}


def feature_importance(model: dict) -> list[tuple[str, float]]:
    """Mean importance of each feature over the classifiers."""
    mean = np.mean([c.featureImportances.toArray() for c in model["classifiers"]], axis=0)
    return [(n, float(v)) for n, v in zip(model["features"], mean)]


def score_signals(model: dict, df: DataFrame, least: float = 0.5) -> DataFrame:
    """Predicted label, confidence (largest class share) and score in -1..1; weak rows dropped."""
    d = model["assemble"].transform(df)
    if len(model["classifiers"]) == 1:
        d = model["classifiers"][0].transform(d).withColumn("_share", vector_to_array("probability"))
        d = d.drop("rawPrediction", "probability", "prediction")
    else:
        for i, c in enumerate(model["classifiers"]):
            d = c.transform(d).withColumn(f"_p{i}", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
        parts = [F.col(f"_p{i}") for i in range(len(model["classifiers"]))]
        total = sum(parts[1:], parts[0])
        d = d.withColumn("_share", F.array(*[ratio(p, total) for p in parts])).drop(*[f"_p{i}" for i in range(len(parts))])
    names = F.array(*[F.lit(x) for x in model["labels"]])
    d = model["regressor"].transform(d).withColumn("confidence", F.array_max("_share"))
    d = d.withColumns({
        "predicted": F.try_element_at(names, F.array_position("_share", F.col("confidence")).cast("int")),
        "score": clip("score_prediction", -1.0, 1.0),
    })
    return d.filter(F.col("confidence") >= least).drop("_share", "features", "score_prediction")


# ---- Gaussian hidden Markov regimes -----------------------------------------------------------------

def fit_regimes(df: DataFrame, features: Sequence[str], s: Series = BARS, k: int = 6, rounds: int = 10):
    """Gaussian HMM with full covariances by Baum-Welch. Each round is one Spark job: forward-backward per key over its
    (calendar-bounded) series, expected counts summed over keys; only k-sized sums reach the driver."""
    cols = list(features)
    order = list(s.order)
    data = checkpointed(df.select(*s.keys, *order, *cols).na.drop())  # every round reads it
    n_rows = data.count()
    probs = {f"q{i}": (i + 0.5) / k for i in range(k)}
    row = exact_percentiles(data, [], cols[0], probs).first()
    means_all = data.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)], *[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(cols)]).first()
    d = len(cols)
    mu = np.array([[row[f"q{i}"]] + [means_all[f"m{j}"] for j in range(1, d)] for i in range(k)], float)
    var = np.tile(np.diag([max(means_all[f"v{j}"], 1e-9) for j in range(d)]).astype(float), (k, 1, 1))
    start, trans = np.full(k, 1 / k), np.full((k, k), 0.1 / max(1, k - 1)) + np.eye(k) * (0.9 - 0.1 / max(1, k - 1))
    loglik = -math.inf
    for _ in range(rounds):
        params = (start, trans, mu, var)

        got = data.groupBy(*s.keys).applyInPandas(_expected_counts(cols, order, params), "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
        v = np.array([r["v"] for r in got])
        g0, xi, g = v[:k], v[k:k + k * k].reshape(k, k), v[k + k * k:2 * k + k * k]
        at = 2 * k + k * k
        sx, sxx, ll = v[at:at + k * d].reshape(k, d), v[at + k * d:-1].reshape(k, d, d), v[-1]
        w = np.maximum(g, 1e-12)[:, None]
        start, trans = g0 / g0.sum(), (xi + 1e-12) / (xi + 1e-12).sum(1, keepdims=True)
        mu = sx / w
        var = _positive(sxx / w[:, :, None] - mu[:, :, None] * mu[:, None, :])
        if ll - loglik < 1e-4 * abs(ll):
            loglik = ll
            break
        loglik = ll
    free = k * k - 1 + k * d + k * d * (d + 1) // 2
    return {"start": start, "trans": trans, "mean": mu, "var": var, "features": cols, "log_likelihood": loglik,
            "aic": 2 * free - 2 * loglik, "bic": free * math.log(max(n_rows, 1)) - 2 * loglik}


def _expected_counts(cols: list[str], order: list[str], params: tuple):
    """One key's share of the expected counts, flattened: first states, transitions, weights, moments."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order, kind="stable")[cols].to_numpy(float)
        gamma, xi, ll = _forward_backward(x, *params)
        sums = np.concatenate([gamma[0], xi.ravel(), gamma.sum(0), (gamma.T @ x).ravel(), np.einsum("nk,ni,nj->kij", gamma, x, x).ravel(), [ll]])
        return pd.DataFrame({"i": np.arange(len(sums)), "v": sums})

    return run


def _positive(var: np.ndarray, least: float = 1e-9) -> np.ndarray:
    """Symmetric matrices with no eigenvalue below ``least``."""
    values, vectors = np.linalg.eigh((var + var.transpose(0, 2, 1)) / 2)
    return np.einsum("kij,kj,klj->kil", vectors, np.maximum(values, least), vectors)


def _emission(x: np.ndarray, mu: np.ndarray, var: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh(var)
    apart = np.einsum("nki,kij->nkj", x[:, None, :] - mu, vectors)
    return -0.5 * ((apart**2 / values).sum(2) + np.log(2 * np.pi * values).sum(1))


def _forward_backward(x, start, trans, mu, var):
    logb = _emission(x, mu, var)
    top = logb.max(1, keepdims=True)
    b = np.exp(logb - top)
    n, k = b.shape
    alpha, beta, scale = np.empty((n, k)), np.ones((n, k)), np.empty(n)
    a = start * b[0]
    for t in range(n):
        if t:
            a = (alpha[t - 1] @ trans) * b[t]
        scale[t] = max(a.sum(), 1e-300)
        alpha[t] = a / scale[t]
    xi = np.zeros((k, k))
    for t in range(n - 2, -1, -1):
        w = b[t + 1] * beta[t + 1]
        beta[t] = trans @ w / scale[t + 1]
        xi += np.outer(alpha[t], w) * trans / scale[t + 1]
    gamma = alpha * beta
    gamma /= np.maximum(gamma.sum(1, keepdims=True), 1e-300)
    return gamma, xi, float((np.log(scale) + top[:, 0]).sum())


def predict_regimes(df: DataFrame, model: dict, s: Series = BARS) -> DataFrame:
    """Posterior state of every row with its probability; states are numbered by their first mean."""
    rank = np.argsort(np.argsort(model["mean"][:, 0]))
    cols, order = model["features"], list(s.order)
    params = (model["start"], model["trans"], model["mean"], model["var"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable", ignore_index=True)
        gamma, _, _ = _forward_backward(pdf[cols].to_numpy(float), *params)
        pdf["state"], pdf["posterior"] = rank[gamma.argmax(1)], gamma.max(1)
        return pdf

    data = df.select(*s.keys, *order, *cols).na.drop()
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in data.schema) + ", state long, posterior double"
    return data.groupBy(*s.keys).applyInPandas(run, ddl)


# ---- clustering -------------------------------------------------------------------------------------

def kmeans_best_k(df: DataFrame, features: str = "features", max_k: int = 8) -> tuple[DataFrame, int, float]:
    """K-means labels for the k in 2..max_k with the best silhouette."""
    cached = checkpointed(df)
    judge = ClusteringEvaluator(featuresCol=features, predictionCol="label")
    best = None
    for k in range(2, max_k + 1):
        out = KMeans(k=k, seed=SEED, featuresCol=features, predictionCol="label").fit(cached).transform(cached)
        if out.select("label").distinct().limit(2).count() < 2:
            continue
        score = judge.evaluate(out)
        if best is None or score > best[2]:
            best = (out, k, score)
    return best


def spectral_clusters(edges: DataFrame, k: int, rounds: int = 20) -> DataFrame:
    """Clusters of a similarity graph (src, dst, weight >= 0) by power iteration: id, label."""
    pic = PowerIterationClustering(k=k, maxIter=rounds, initMode="degree", srcCol="src", dstCol="dst", weightCol="weight")
    return pic.assignClusters(edges).select("id", F.col("cluster").cast("long").alias("label"))


def spectral_points(df: DataFrame, coords: Sequence[str], key: str, k: int, gamma: float = 1.0, landmarks: int = 256) -> DataFrame:
    """Spectral clusters of points under the affinity exp(-gamma * distance^2): key, label; -1 for points with a null
    or non-finite coordinate.

    Nystroem form: the affinities to at most ``landmarks`` distinct points, those of the lowest hash, span the graph,
    so no pairs of points are formed. One pass sums the degrees, one the matrix whose leading eigenvectors embed
    every point, and k-means runs on the embedding. With no more distinct points than landmarks the graph is exact.
    """
    cols = list(coords)
    usable = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)) for c in cols]
    numbers = df.select(key, *[F.col(c).cast("double").alias(c) for c in cols])
    data = checkpointed(numbers.filter(reduce(and_, usable)))
    marks = data.select(*cols).distinct().orderBy(F.xxhash64(*cols), *cols).limit(landmarks).collect()
    if len(marks) <= 1 or k <= 1:
        found = data.select(key).distinct().withColumn("label", F.lit(0).cast("long"))
    else:
        at = np.array([list(m) for m in marks], float)
        values, vectors = np.linalg.eigh(_affinity(at, at, gamma))
        kept = values > 1e-10 * values[-1]
        spread = vectors[:, kept] / np.sqrt(values[kept])
        rank = spread.shape[1]

        def phi(pdf: pd.DataFrame) -> np.ndarray:
            return _affinity(pdf[cols].to_numpy(float), at, gamma) @ spread

        whole = summed(data, lambda pdf: phi(pdf).sum(0), rank)

        def scaled(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
            f = phi(pdf)
            root = np.sqrt(np.maximum(f @ whole, 1e-9))[:, None]  # far from every landmark: hardly any degree
            return f / root, root

        def products(pdf: pd.DataFrame) -> np.ndarray:
            f = scaled(pdf)[0]
            return (f.T @ f).ravel()

        values, vectors = np.linalg.eigh(summed(data, products, rank * rank).reshape(rank, rank))
        top = min(k, rank)
        leading = vectors[:, -top:] / np.sqrt(np.maximum(values[-top:], 1e-12)) * math.sqrt(max(whole @ whole, 1e-12))

        def embed(batches):
            for pdf in batches:
                f, root = scaled(pdf)
                out = pdf[[key]].copy()
                out["_e"] = list(f @ leading / root)
                yield out

        kind = dict(df.dtypes)[key]
        embedded = checkpointed(data.mapInPandas(embed, f"`{key}` {kind}, _e array<double>")).withColumn("_v", array_to_vector("_e"))
        fit = KMeans(k=k, seed=SEED, initSteps=5, featuresCol="_v", predictionCol="label").fit(embedded)
        found = fit.transform(embedded).groupBy(key).agg(F.min("label").cast("long").alias("label"))
    rest = df.select(key).join(found.withColumnRenamed(key, "_k"), F.col(key).eqNullSafe(F.col("_k")), "left")
    return rest.select(key, F.coalesce("label", F.lit(-1).cast("long")).alias("label"))


def _affinity(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    d2 = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T
    return np.exp(-gamma * np.maximum(d2, 0))


def _components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Connected components by repeated minimum labels with pointer jumping; (node, label)."""
    both = checkpointed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(nodes.select("node", F.col("node").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("_l"))
        step = labels.join(near, "node", "left").select("node", F.least("label", F.coalesce("_l", "label")).alias("label"))
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("_j"))
        new = checkpointed(step.join(jump, "label", "left").select("node", F.least("label", F.coalesce("_j", "label")).alias("label")))
        changed = new.join(labels.withColumnRenamed("label", "_old"), "node").filter("label <> _old").isEmpty()
        labels = new
        if changed:
            return labels


def dbscan(df: DataFrame, coords: Sequence[str], key: str, eps: float = 0.3, least: int = 3, sub: int = 8) -> DataFrame:
    """Exact DBSCAN in a few dimensions: key, label (smallest core cell id of the cluster), -1 for noise.

    Space is cut into cells of diameter eps. A cell with ``least`` points is all core and one cluster, so
    no pairs inside it are formed. Only sparse cells count neighbours (fewer than ``least`` points each),
    and two dense cells are tied by representatives, with an exact check of the few sub-cells left open.
    """
    d = len(coords)
    side = eps / math.sqrt(d)
    cell = F.array(*[F.floor(F.col(c) / side).cast("long") for c in coords])
    xs = F.array(*[F.col(c).cast("double") for c in coords])
    sizes_of = df.select(F.col(key).alias("id"), xs.alias("x"), cell.alias("cell"))
    sizes = sizes_of.groupBy("cell").agg(F.count(F.lit(1)).alias("size"))
    pts = checkpointed(sizes_of.join(sizes, "cell"))
    reach = math.ceil(math.sqrt(d))
    offsets = np.stack(np.meshgrid(*[np.arange(-reach, reach + 1)] * d), -1).reshape(-1, d)
    gap = (np.maximum(np.abs(offsets) - 1, 0) ** 2).sum(1) * side * side
    offsets = [o.tolist() for o, g in zip(offsets, gap) if g <= eps * eps * (1 + 1e-9)]
    shifts = F.array(*[F.array(*[F.lit(int(v)).cast("long") for v in o]) for o in offsets])

    def spread(frame: DataFrame) -> DataFrame:
        return frame.withColumn("_o", F.explode(shifts)).withColumn("near", F.zip_with("cell", "_o", lambda a, b: a + b)).drop("_o")

    def close(a: str, b: str):
        dist2 = F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
        return dist2 <= eps * eps

    sparse = pts.filter(F.col("size") < least)
    others = pts.select(F.col("cell").alias("near"), F.col("id").alias("id2"), F.col("x").alias("x2"))
    pairs = spread(sparse.select("id", "x", "cell")).join(others, "near").filter(close("x", "x2"))
    counts = pairs.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    core_sparse = sparse.join(counts, "id").filter(F.col("n") >= least).select("id", "x", "cell")
    core = checkpointed(pts.filter(F.col("size") >= least).select("id", "x", "cell").unionByName(core_sparse))
    # core points meet through sub-cell representatives first
    fine = F.transform("x", lambda v: F.floor(v / (side / sub)).cast("long"))
    subs = checkpointed(core.withColumn("sub", fine).groupBy("cell", "sub").agg(F.min(F.struct("id", "x")).alias("rep"), F.count(F.lit(1)).alias("m")))
    left = spread(subs.select("cell", F.col("sub").alias("s1"), F.col("rep.x").alias("x1"))).filter(F.col("cell") < F.col("near"))
    right = subs.select(F.col("cell").alias("near"), F.col("sub").alias("s2"), F.col("rep.x").alias("x2"))
    box2 = F.aggregate(F.zip_with("s1", "s2", lambda p, q: F.pow(F.greatest(F.abs(p - q) - 1, F.lit(0)) * (side / sub), F.lit(2))), F.lit(0.0), lambda s, v: s + v)
    met = left.join(right, "near").filter(box2 <= eps * eps).withColumn("hit", close("x1", "x2"))
    proven = checkpointed(met.filter("hit").select(F.col("cell").alias("a"), F.col("near").alias("b")).distinct())
    open_ = met.select(F.col("cell").alias("a"), F.col("near").alias("b"), "s1", "s2").join(proven, ["a", "b"], "left_anti")
    core_sub = core.withColumn("sub", fine)
    one = core_sub.select(F.col("cell").alias("a"), F.col("sub").alias("s1"), F.col("x").alias("x1"))
    two = core_sub.select(F.col("cell").alias("b"), F.col("sub").alias("s2"), F.col("x").alias("x2"))
    exact = open_.join(one, ["a", "s1"]).join(two, ["b", "s2"]).filter(close("x1", "x2")).select("a", "b").distinct()
    nodes = core.select(F.col("cell").alias("node")).distinct()
    comp = _components(nodes, proven.unionByName(exact))
    labelled = core.join(comp.withColumnRenamed("node", "cell"), "cell").select("id", F.col("label").alias("cluster"), "x", "cell")
    # border points take the cluster of a core point within reach; smallest cluster first
    loose = pts.join(core.select("id"), "id", "left_anti").select("id", "x", "cell")
    around = labelled.select(F.col("cell").alias("near"), "cluster", F.col("x").alias("x2"))
    border = spread(loose).join(around, "near").filter(close("x", "x2")).groupBy("id").agg(F.min("cluster").alias("cluster"))
    found = labelled.select("id", "cluster").unionByName(border)
    names = found.groupBy("cluster").agg(F.min("id").alias("label"))
    out = df.select(F.col(key).alias("id")).join(found.join(names, "cluster").select("id", "label"), "id", "left")
    return out.select(F.col("id").alias(key), F.coalesce(F.col("label").cast("long"), F.lit(-1)).alias("label"))


def consensus_clusters(labels: DataFrame, methods: Sequence[str], key: str, k: int) -> DataFrame:
    """Spectral clusters of the co-occurrence share over methods. Points with equal labels everywhere are
    interchangeable, so the graph is built over distinct label combinations, weighted by their sizes. A combination
    that agrees with no other in any method is a cluster of its own, numbered from k on."""
    combos = labels.groupBy(*methods).agg(F.count(F.lit(1)).alias("_size"), F.min(key).alias("_first"))
    combos = checkpointed(with_position(combos.withColumn("_all", F.lit(0)), Series(("_all",), ("_first",), True), "_c").drop("_all"))
    a = combos.select(F.col("_c").alias("src"), F.col("_size").alias("n1"), *[F.col(m).alias(f"{m}1") for m in methods])
    b = combos.select(F.col("_c").alias("dst"), F.col("_size").alias("n2"), *[F.col(m).alias(f"{m}2") for m in methods])
    out = None
    for m in methods:  # combinations that agree in a method; never all pairs of points
        e = a.join(b, (a[f"{m}1"] == b[f"{m}2"]) & (a["src"] < b["dst"])).filter(F.col(f"{m}1") >= 0)
        e = e.select("src", "dst", (F.col("n1") * F.col("n2") / float(len(methods))).alias("weight"))
        out = e if out is None else out.unionByName(e)
    edges = out.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    edges = checkpointed(edges)
    placed = labels.join(combos.select("_c", *methods), [*methods])
    if edges.isEmpty():
        return placed.select(key, (F.col("_c") + k).cast("long").alias("label"))
    clusters = spectral_clusters(edges, k).withColumnRenamed("id", "_c")
    return placed.join(clusters, "_c", "left").select(key, F.coalesce("label", F.col("_c") + k).cast("long").alias("label"))


def adjusted_rand(df: DataFrame, a: str, b: str, group: Sequence[str] = ()) -> DataFrame:
    """Adjusted Rand index of two labelings, from the contingency counts; 1 for equal partitions."""
    pairs = lambda c: c * (c - 1) / 2
    cells = df.groupBy(*group, a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    inner = cells.groupBy(*group).agg(F.sum(pairs(F.col("n"))).alias("ij"), F.sum("n").alias("n"))
    keys = list(group) or [F.lit(0).alias("_g")]

    def side(c: str, name: str) -> DataFrame:
        per = cells.groupBy(*group, c).agg(F.sum("n").alias("n"))
        return per.groupBy(*group).agg(F.sum(pairs(F.col("n"))).alias(name))

    d = inner.select(*keys, "ij", "n")
    names = list(group) or ["_g"]
    for c, name in ((a, "ai"), (b, "bj")):
        d = d.join(side(c, name).select(*keys, name), names)
    expected = F.col("ai") * F.col("bj") / F.when(F.col("n") > 1, pairs(F.col("n")))
    top = (F.col("ai") + F.col("bj")) / 2
    # one row alone is the same partition under any labels
    score = F.when((F.col("n") < 2) | (top == expected), 1.0).otherwise((F.col("ij") - expected) / F.when(top != expected, top - expected))
    return d.select(*group, score.alias("ari"))


def consensus_score(df: DataFrame, methods: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Agreement of several labelings: the mean adjusted Rand index of all pairs of ``methods``, 1 for one method."""
    chosen = [(a, b) for i, a in enumerate(methods) for b in methods[i + 1 :]]
    if not chosen:
        return df.groupBy(*group).agg(F.lit(1.0).alias("consensus_score"))
    sides = [F.struct(F.lit(k).alias("_pair"), F.col(a).cast("string").alias("_a"), F.col(b).cast("string").alias("_b")) for k, (a, b) in enumerate(chosen)]
    both = df.select(*group, F.explode(F.array(*sides)).alias("_s")).select(*group, "_s.*")
    return adjusted_rand(both, "_a", "_b", [*group, "_pair"]).groupBy(*group).agg(F.avg("ari").alias("consensus_score"))


def temporal_stability(labels: DataFrame, key: str, window: str, label: str, back: int = 5) -> DataFrame:
    """Mean adjusted Rand index of each window's labels with those of up to ``back`` windows before."""
    past = labels.select(F.col(window).alias("_past"), key, F.col(label).alias("_pl"))
    both = labels.withColumn("_past", F.explode(F.sequence(F.col(window) - back, F.col(window) - 1))).join(past, ["_past", key])
    per = adjusted_rand(both, label, "_pl", [window, "_past"])
    return per.groupBy(window).agg(F.avg("ari").alias("stability"))


def cluster_coherence(corr: DataFrame, clusters: DataFrame) -> DataFrame:
    """Mean absolute correlation inside each cluster, 1 for singletons. corr: a, b, corr."""
    left, right = (clusters.select(F.col("symbol").alias(s), F.col("label").alias(f"_{s}")) for s in ("a", "b"))
    inside = corr.join(broadcast_if_small(left), "a").join(broadcast_if_small(right), "b").filter("_a = _b")
    mean = inside.groupBy(F.col("_a").alias("label")).agg(F.avg(F.abs("corr")).alias("coherence"))
    sizes = clusters.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    return sizes.join(mean, "label", "left").withColumn("coherence", F.coalesce("coherence", F.when(F.col("size") == 1, 1.0).otherwise(0.0)))


# ---- isolation forest ---------------------------------------------------------------------------------

def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[list[float]]:
    """Isolation tree as rows (feature, split, left, right, size); leaves have feature -1."""
    nodes: list[list[float]] = []

    def build(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, -1, -1, len(rows)])
        span = rows.max(0) - rows.min(0) if len(rows) else np.zeros(x.shape[1])
        live = np.flatnonzero(span > 0)
        if depth >= limit or len(rows) <= 1 or not len(live):
            return at
        f = int(rng.choice(live))
        cut = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
        mask = rows[:, f] < cut
        nodes[at][:4] = [f, cut, build(rows[mask], depth + 1), build(rows[~mask], depth + 1)]
        return at

    build(x, 0)
    return nodes


def _packed(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """An isolation tree as feature, split, children (two per node) and path length per node, and its depth. Leaves
    lead to themselves, so rows walk all levels without a test for leaves."""
    leaf, own = nodes[:, 0] < 0, np.arange(len(nodes))
    kids = np.where(leaf[:, None], own[:, None], nodes[:, 2:4]).astype(np.intp)
    depth = np.zeros(len(nodes))
    for i in own[~leaf]:  # parents come before their children
        depth[kids[i]] = depth[i] + 1
    return np.where(leaf, 0, nodes[:, 0]).astype(np.intp), nodes[:, 1].copy(), kids.ravel(), depth + _expected_depth(nodes[:, 4]), int(depth.max())


def _path_lengths(x: np.ndarray, forest: Sequence[tuple]) -> np.ndarray:
    """Mean path length of every row over the packed trees."""
    flat, first = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
    total = np.zeros(len(x))
    for feature, cut, kids, path, levels in forest:
        at = np.zeros(len(x), dtype=np.intp)
        for _ in range(levels):
            left = flat[first + feature[at]] < cut[at]
            at = kids[2 * at + ~left]
        total += path[at]
    return total / len(forest)


def _expected_depth(n: np.ndarray) -> np.ndarray:
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def isolation_scores(df: DataFrame, features: Sequence[str], key: str | Sequence[str], trees: int = 100, sample: int = 256, contamination: float = 0.1, group: str | None = None) -> DataFrame:
    """Isolation-forest scores of every row and whether they lie in the top ``contamination`` share.

    A hash of row and tree draws each tree's sample; trees grow in parallel from at most ``sample`` rows
    and come to the driver as at most ``trees * 2 * sample`` nodes. Scoring is a scan, dealt by the keys, so that it
    does not run in as many tasks as there are series. With ``group`` every value of
    that column, one of the keys, has a forest and a ``cut`` of its own; meant for a few named series.
    """
    cols, keys = list(features), [key] if isinstance(key, str) else list(key)
    data = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols]).na.drop(subset=cols + ([group] if group else keys))
    data = checkpointed(data.repartition(*keys))  # read to count, to draw and to score
    sizes = {r[0]: r["count"] for r in data.groupBy(group or F.lit("")).count().collect()}
    share = {g: min(1.0, 2.0 * sample / n) for g, n in sizes.items()}
    drawn_share = F.create_map(*[F.lit(v) for pair in share.items() for v in pair])[F.col(group)] if group and share else F.lit(share.get("", 1.0))
    every = data.withColumn("_share", drawn_share).withColumn("_tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    drawn = every.filter(F.pmod(F.xxhash64(*keys, "_tree", F.lit(SEED)), F.lit(1_000_003)) / 1_000_003.0 < F.col("_share")).drop("_share")
    drawn = drawn.withColumn("_h", F.xxhash64(*keys, F.col("_tree"), F.lit(SEED + 1)))
    per = ["_tree", group] if group else ["_tree"]
    picked = top_per_key(drawn, per, [F.col("_h").asc(), *[F.col(k).asc() for k in keys]], sample)
    limits = {g: math.ceil(math.log2(max(2, min(sample, n)))) for g, n in sizes.items()}

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        t, g = int(pdf["_tree"].iloc[0]), pdf[group].iloc[0] if group else ""
        x = pdf.sort_values("_h")[cols].to_numpy(float)
        nodes = _grow(x, np.random.default_rng([SEED, t]), limits[g])
        return pd.DataFrame({"grp": [g], "tree": [t], "size": [len(x)], "nodes": [[v for row in nodes for v in row]]})

    types = dict(df.dtypes)
    rows = picked.groupBy(*per).applyInPandas(grow, f"grp {types[group] if group else 'string'}, tree int, size int, nodes array<double>").collect()
    forests: dict = {}
    for r in sorted(rows, key=lambda r: r["tree"]):
        forests.setdefault(r["grp"], []).append((np.array(r["nodes"]).reshape(-1, 5), r["size"]))
    norms = {g: float(np.mean([_expected_depth(np.array([size]))[0] for _, size in forest])) or 1.0 for g, forest in forests.items()}
    packed = {g: [_packed(nodes) for nodes, _ in forest] for g, forest in forests.items()}

    def score(batches):
        for pdf in batches:
            out = pdf[keys].copy()
            out["score"] = np.nan
            for g in pdf[group].unique() if group else [""]:
                rows = (pdf[group] == g).to_numpy() if group else np.ones(len(pdf), bool)
                if rows.any():
                    out.loc[rows, "score"] = 2.0 ** (-_path_lengths(pdf.loc[rows, cols].to_numpy(float), packed[g]) / norms[g])
            yield out

    scored = checkpointed(data.mapInPandas(score, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", score double"))
    if not group:
        cut = exact_percentiles(scored, [], "score", {"_cut": 1.0 - contamination})
        return scored.crossJoin(F.broadcast(cut)).withColumn("anomaly", F.col("score") > F.col("_cut")).drop("_cut")
    cut = exact_percentiles(scored, [group], "score", {"cut": 1.0 - contamination})
    return scored.join(broadcast_if_small(cut), group).withColumn("anomaly", F.col("score") > F.col("cut"))


def window_features(df: DataFrame, value: str, s: Series = TICKS) -> DataFrame:
    """Value and mean, deviation, minimum and maximum of the last six rows, from the sixth row on."""
    x = F.col(value)
    cols = {n: (lambda w, f=f: f(x).over(rows_before(w, 6))) for n, f in
            (("f_mean", F.avg), ("f_std", F.stddev_pop), ("f_min", F.min), ("f_max", F.max), ("_have", F.count))}
    return _windowed(df, s, cols, 5).filter("_have >= 6").drop("_have")


def principal_components(df: DataFrame, columns: Sequence[str], k: int = 3) -> DataFrame:
    """Adds pc_1..pc_k; the means are removed so that the components are those of the covariance."""
    means = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
    d = df.crossJoin(F.broadcast(means)).withColumns({f"_z_{c}": F.col(c) - F.col(f"_m_{c}") for c in columns})
    d = VectorAssembler(inputCols=[f"_z_{c}" for c in columns], outputCol="_v").transform(d)
    d = PCA(k=min(k, len(columns)), inputCol="_v", outputCol="_p").fit(d).transform(d)
    arr = vector_to_array("_p")
    return d.withColumns({f"pc_{i + 1}": arr[i] for i in range(min(k, len(columns)))}).select(*df.columns, *[f"pc_{i + 1}" for i in range(min(k, len(columns)))])


# ---- change points --------------------------------------------------------------------------------------

def changepoints(df: DataFrame, value: str, s: Series, breaks: int = 5, jump: int = 5, least: int = 2) -> DataFrame:
    """Break positions of each series by binary segmentation with the squared-error cost: keys, position
    (rows before the break), gain. Prefix sums are a parallel scan; each round is one partial aggregation.
    """
    keys = list(s.keys)
    d = running(with_position(df.select(*keys, *s.order, F.col(value).cast("double").alias("_x")), s, "_pos"), s, {"_sum": ("sum", F.col("_x"))})
    rows = checkpointed(d.select(*keys, "_pos", "_sum"))
    total = rows.groupBy(*keys).agg(F.max("_pos").alias("b"), F.max_by("_sum", "_pos").alias("sb"))
    segments = total.select(*keys, F.lit(0).cast("long").alias("a"), F.lit(0.0).alias("sa"), "b", "sb")
    found = None
    left_n, right_n = F.col("_pos") - F.col("a"), F.col("b") - F.col("_pos")
    left_s, right_s = F.col("_sum") - F.col("sa"), F.col("sb") - F.col("_sum")
    whole = F.col("sb") - F.col("sa")
    gain = left_s * left_s / left_n + right_s * right_s / right_n - whole * whole / (F.col("b") - F.col("a"))
    for i in range(breaks):
        cand = rows.filter(F.col("_pos") % jump == 0).join(broadcast_if_small(segments), keys)
        cand = cand.filter((left_n >= least) & (right_n >= least))
        best = cand.groupBy(*keys).agg(F.max(F.struct(gain.alias("gain"), (-F.col("_pos")).alias("p"), "_sum", "a", "sa", "b", "sb")).alias("m"))
        best = checkpointed(best.select(*keys, (-F.col("m.p")).alias("position"), F.col("m.gain").alias("gain"), F.col("m._sum").alias("sp"), F.col("m.a").alias("a"), F.col("m.sa").alias("sa"), F.col("m.b").alias("b"), F.col("m.sb").alias("sb")))
        one = best.select(*keys, "position", "gain", F.lit(i + 1).alias("round"))
        found = one if found is None else found.unionByName(one)
        kept = segments.join(best.select(*keys, "a"), [*keys, "a"], "left_anti")
        halves = best.select(*keys, "a", "sa", F.col("position").alias("b"), F.col("sp").alias("sb")).unionByName(
            best.select(*keys, F.col("position").alias("a"), F.col("sp").alias("sa"), "b", "sb"))
        segments = kept.unionByName(halves)
    return found


def changepoint_anomalies(df: DataFrame, value: str, s: Series, threshold: float) -> DataFrame:
    """A series whose last break lies in its last tenth and whose mean moved by the threshold: one row at
    the break."""
    keys = list(s.keys)
    last = changepoints(df, value, s).groupBy(*keys).agg(F.max("position").alias("_cp"))
    placed = with_position(df, s, "_pos").join(broadcast_if_small(last), keys)
    at = F.struct(*[F.col(c) for c in s.order])
    early = F.col("_pos") <= F.col("_cp")
    a = placed.groupBy(*keys).agg(F.max("_pos").alias("_n"), F.max("_cp").alias("_cp"), F.avg(F.when(early, F.col(value))).alias("before"),
                                  F.avg(F.when(~early, F.col(value))).alias("after"), F.min(F.when(~early, at)).alias("_at"))
    move = F.abs(F.col("after") - F.col("before"))
    a = a.withColumn("magnitude", F.when(F.col("before") != 0, move / F.abs("before")).otherwise(move))
    hit = a.filter((F.col("_cp") > F.col("_n") * 0.9) & (F.col("magnitude") >= threshold))
    return hit.select(*keys, *[F.col(f"_at.{c}").alias(c) for c in s.order], "before", "after", "magnitude", F.lit(0.8).alias("confidence"), severity("magnitude", threshold).alias("severity"))
