"""Secret scans: candidates by shape, false positives removed by a random forest.

Every run of 16 or more key characters is a candidate. Its features are its length and entropy, the transitions
between its character classes, the share of its letters that vocabulary words cover, whether it is part of a path,
and the words and signs beside it. A forest learns from labelled findings which candidates are secrets.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.bpe import ranks_of
from tidemark.llm.common import shared_file, text_batches, text_of, written
from tidemark.plans.sizing import broadcast_if_small

LEAST = 16
#: An equals sign only pads the end, so the name in ``name=value`` is no part of the candidate.
RUN = rf"[A-Za-z0-9_+/\-]{{{LEAST},}}={{0,2}}"
BESIDE = 48
#: Bound of the labelled findings that the forest is fitted on, taken by hash.
FINDINGS = 20_000
#: Fewer findings of a label than this teach nothing; the rule that labels them then decides itself.
ENOUGH = 10
TREES = 40
DEPTH = 6

#: Words that name a secret, prefixes that providers give to theirs, and ends of file names.
NAMES = ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "key", "auth", "bearer", "credential", "private")
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "sk-", "AIza", "eyJ")
ENDS = (".html", ".php", ".png", ".jpg", ".js", ".css", ".com", ".org", ".txt", ".pdf")

COLUMNS = ["length", "entropy", "classes", "cover", "digits", "uppers", "path", "address", "file_end", "assigned", "quoted", "named", "prefixed", "even"]
COLUMNS += [f"step_{a}{b}" for a in "ludo" for b in "ludo"]


def vocabulary(data: bytes) -> set[str]:
    """Alphabetic tokens of four letters and more, lower-cased."""
    words = (t.strip().decode("utf-8", "ignore").lower() for t in ranks_of(data))
    return {w for w in words if len(w) > 3 and w.isalpha()}


def covered(value: str, words: set[str]) -> float:
    """Share of the letters of ``value`` inside vocabulary words, longest first from the left."""
    total = hit = 0
    for letters in re.findall(r"[a-z]+", value.lower()):
        at, total = 0, total + len(letters)
        while at < len(letters):
            size = next((n for n in range(min(12, len(letters) - at), 3, -1) if letters[at : at + n] in words), 0)
            hit += size
            at += size or 1
    return hit / total if total else 0.0


def described(text: str, start: int, end: int, words: set[str]) -> list[float]:
    value, before, after = text[start:end], text[max(0, start - BESIDE) : start], text[end : end + BESIDE]
    counts = Counter(value)
    kinds = ["l" if c.islower() else "u" if c.isupper() else "d" if c.isdigit() else "o" for c in value]
    steps = Counter(zip(kinds, kinds[1:]))
    near = re.findall(r"[A-Za-z_]+", before.lower())[-3:]
    values = [
        math.log(len(value)),
        -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values()),
        len(set(kinds)),
        covered(value, words),
        sum(c.isdigit() for c in value) / len(value),
        sum(c.isupper() for c in value) / len(value),
        value.count("/") / len(value) + (before[-1:] in ("/", "\\")),
        bool(re.search(r"(://|www\.)\S*$", before)),
        after.lower().startswith(ENDS),
        bool(re.search(r"[=:]\s*[\"'`]?$", before)),
        before[-1:] in "\"'`" and before[-1:] == after[:1] != "",
        any(n in w for w in near for n in NAMES),
        value.startswith(PREFIXES),
        len(value) % 4 == 0,
    ]
    return [float(v) for v in values] + [steps[a, b] / len(kinds) for a in "ludo" for b in "ludo"]


def candidates(docs: DataFrame, ranks_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every candidate of every whole text: ``key``, ``start``, ``end`` (code points), ``value``, features ``x``."""
    text_batches(docs.sparkSession)
    file = shared_file(docs.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shape = vocabulary(file.value), re.compile(RUN)
        for batch in batches:
            row, start, end, value, x = [], [], [], [], []
            for r, t in enumerate(batch.column(1).to_pylist()):
                for m in shape.finditer(t):
                    row.append(r)
                    start.append(m.start())
                    end.append(m.end())
                    value.append(m.group())
                    x.append(described(t, m.start(), m.end(), words))
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(value, pa.string()), pa.array(x, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, [key, "start", "end", "value", "x"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text_of(text).alias("_text")).mapInArrow(run, f"`{key}` {kind}, start int, `end` int, value string, x array<double>")


def feature(name: str):
    return F.get("x", F.lit(COLUMNS.index(name)))


def sure():
    """Certain to be a secret: assigned to a name of one, or with a provider's prefix, and of high entropy."""
    strong = (feature("entropy") > 3.0) & (feature("digits") > 0) & (feature("digits") < 1)
    return strong & (((feature("named") > 0) & (feature("assigned") > 0)) | (feature("prefixed") > 0))


def labelled(found: DataFrame) -> DataFrame:
    """Candidates with ``label`` from what is certain: those of ``sure`` (1); words, parts of paths and addresses,
    numbers (0). Others are left out."""
    idle = (feature("digits") == 1) | ((feature("digits") == 0) & (feature("classes") <= 2)) | (feature("address") > 0) | (feature("cover") > 0.8)
    return found.withColumn("label", F.when(sure(), 1.0).when(idle, 0.0)).where("label is not null")


def train(findings: DataFrame, most: int = FINDINGS, seed: int = 7) -> RandomForestClassificationModel | None:
    """A forest over ``x`` for ``label``; each class weighs the same. None without ENOUGH of both labels.

    Fitted on at most ``most`` findings of each label, those of the lowest hash of their features.
    """
    rows = [findings.where(F.col("label") == v).select("x", "label").orderBy(F.xxhash64("x"), "x").limit(most) for v in (0.0, 1.0)]
    sample = written(rows[0].union(rows[1]))
    sizes = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    if min(sizes.get(0.0, 0), sizes.get(1.0, 0)) < ENOUGH:
        return None
    weight = F.when(F.col("label") == 1, F.lit(0.5 / sizes[1.0])).otherwise(F.lit(0.5 / sizes[0.0])) * sum(sizes.values())
    vectors = assembled(sample).withColumn("weight", weight).repartition(8, F.xxhash64("x")).sortWithinPartitions("x")
    forest = RandomForestClassifier(featuresCol="vector", labelCol="label", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, seed=seed, minInstancesPerNode=2)
    return forest.fit(vectors)


def assembled(found: DataFrame) -> DataFrame:
    wide = found.withColumns({f"_x{k}": F.get("x", F.lit(k)) for k in range(len(COLUMNS))})
    names = [f"_x{k}" for k in range(len(COLUMNS))]
    return VectorAssembler(inputCols=names, outputCol="vector").transform(wide).drop(*names)


def judged(found: DataFrame, model: RandomForestClassificationModel | None) -> DataFrame:
    """``found`` with ``score`` and ``secret``; without a model the candidates of ``sure`` are secrets."""
    if model is None:
        return found.withColumn("score", sure().cast("double")).withColumn("secret", sure())
    out = model.setProbabilityCol("p").setRawPredictionCol("raw").setPredictionCol("best").transform(assembled(found))
    return out.withColumn("score", F.get(vector_to_array("p"), F.lit(1))).withColumn("secret", F.col("score") >= 0.5).drop("p", "raw", "best", "vector")


def scan(docs: DataFrame, ranks_path: str, findings: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every candidate with the forest's decision: ``key``, ``start``, ``end``, ``value``, ``score``, ``secret``.

    ``findings(key, start, label)`` are labelled candidates; without them those of ``labelled`` are learnt from. Null
    and empty texts have none, null keys and repeated rows keep theirs, an empty table gives no rows. Other columns
    are not read.
    """
    found = written(candidates(docs, ranks_path, key, text))
    marked = labelled(found) if findings is None else found.join(findings.select(key, "start", "label"), [key, "start"])
    return judged(found, train(marked)).drop("x")


def redacted(docs: DataFrame, ranks_path: str, key: str = "doc_id", text: str = "text", mark: str = "<secret>", size: str | None = "n_chars") -> DataFrame:
    """``docs`` with the span of every secret replaced by ``mark`` in every text; all else stays as it is.

    Only the spans that the scan calls secrets go: the same characters elsewhere, in an address for instance, are
    judged by their own place. Rows are told apart by the digests of key and text, so rows without a key and rows that
    repeat one are mended too. The column ``size`` follows where there is one.
    """
    digest = F.concat(F.sha2(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"), 256), F.sha2(text_of(text).cast("binary"), 256))
    found = scan(docs.select(digest.alias("_row"), F.col(text).alias("_text")), ranks_path, None, "_row", "_text")
    spans = found.where("secret").groupBy("_row").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("_spans"))
    spans = broadcast_if_small(written(spans))
    own = [F.col(c) for c in docs.columns]
    joined = docs.withColumn("_at", digest).join(spans, F.col("_at") == F.col("_row"), "left")
    ends = F.concat(F.array(F.lit(0)), F.col("_spans.end"))
    between = F.zip_with(ends, F.concat(F.col("_spans.start"), F.array(F.length(text))), lambda a, b: F.col(text).substr(a + 1, b - a))
    out = joined.withColumn(text, F.when(F.col("_spans").isNull(), F.col(text)).otherwise(F.array_join(between, mark)))
    if size in docs.columns:
        out = out.withColumn(size, F.when(F.col("_spans").isNull(), F.col(size)).otherwise(F.length(text).cast(docs.schema[size].dataType)))
    return out.select(*own)
