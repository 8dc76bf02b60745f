"""Personal data by candidate gradient boosting, in DataFrame and SQL functions only.

High-recall generators propose spans that may overlap: the four base formats and looser relatives of them. Each
candidate gets format features (lengths, digits, groups, separators, brackets) and context features (neighbouring
characters and words), all in few classes. Labels come from what is certain: a base match that passes its check,
and anything a passing match of the same kind covers, is personal data; a base match that fails, and anything a
match of another kind covers, is none. Boosted trees are fitted on the table of distinct feature patterns, whose
size the classes bound. On a fold they have not seen, each kind's threshold is the least one that keeps the
precision asked for; looser candidates at or above it are added. Passing base matches always stay.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import text_of, written
from tidemark.plans.sizing import broadcast_if_small

KINDS = ("email", "ip", "card", "phone")

#: Generators: name, kind, expression, what a text must hold to be searched. Runs are possessive and start at the
#: head of a run or where the last match ended, which gives the same leftmost matches in time linear in the text.
BASE = (
    ("email", "email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", "ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    ("card", "card", r"[0-9](?:[\x20-]?[0-9])++", None),
    ("phone", "phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
)
LOOSE = (
    ("phone_plain", "phone", r"(?<![0-9+.-])(?:\([0-9]{3}\)[ ]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])", None),
    ("card_other", "card", r"(?<![0-9])[0-9]{4}(?:[._/][0-9]{4}){3}(?![0-9])", None),
    ("email_spelt", "email", r"[A-Za-z0-9._%+-]{1,64}[ ]?[(\[{][ ]?at[ ]?[)\]}][ ]?[A-Za-z0-9-]{1,63}(?:[ ]?(?:\.|[(\[{][ ]?dot[ ]?[)\]}])[ ]?[A-Za-z0-9-]{1,63})+", "at"),
)
GENERATORS = BASE + LOOSE

#: Words that often stand beside personal data.
CUES = r"(?i)(mail|contact|tel|phone|call|mobile|fax|card|visa|pay|host|server|addr)\W*\w*\W*$"
BESIDE = 24
FEATURES = ("kind_", "length_", "digits_", "groups_", "separator_", "bracket_", "before_", "after_", "cue_", "same_")
PRECISION = 0.95
ROUNDS = 15
FOLDS = 4


def _found(text: str, expression: str, holds: str | None) -> Column:
    """Matches of a generator with the length of the gap before each, and what stands beside it."""
    t = F.col(text)
    can = F.contains(t, F.lit(holds)) if holds else F.lit(True)
    return F.when(can, F.regexp_extract_all(t, F.lit(expression), F.lit(0)))


def proposed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Per row of ``docs``: ``row``, ``key`` and ``x``, the matches of each generator that has any (empty if none)."""
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), text_of(text).alias("t"))
    texts = texts.withColumn("t", F.when(F.col("t").rlike("[0-9@]|[(\\[{] ?at ?[)\\]}]"), F.col("t")))
    all_of = texts.select("row", "key", "t", *[_found("t", e, holds).alias(f"m{g}") for g, (_, _, e, holds) in enumerate(GENERATORS)])
    per = []
    for g, (_, _, expression, _) in enumerate(GENERATORS):
        gaps = f"split(t, r'{expression}', -1)"
        item = f"transform(m{g}, (v, i) -> named_struct('n', i, 'value', v, 'gap', length(g[i]), 'before', right(g[i], {BESIDE}), 'after', left(g[i + 1], 4)))"
        zipped = F.expr(f"flatten(transform(array({gaps}), g -> {item}))")
        per.append(F.when(F.size(f"m{g}") > 0, F.struct(F.lit(g).alias("gen"), zipped.alias("items"))))
    return all_of.select("row", "key", F.array_compact(F.array(*per)).alias("x"))


def matches(listed: DataFrame) -> DataFrame:
    """Every match of every generator: ``row``, ``gen`` (its number), ``start``, ``end``, ``value``, ``before``, ``after``."""
    listed = listed.select("row", F.explode("x").alias("x")).select("row", "x.gen", F.explode("x.items").alias("i")).select("row", "gen", "i.*")
    order = Window.partitionBy("row", "gen").orderBy("n")
    end = F.sum(F.col("gap") + F.length("value")).over(order)
    placed = listed.withColumn("end", end.cast("int"))
    return placed.select("row", "gen", (F.col("end") - F.length("value")).cast("int").alias("start"), "end", "value", "before", "after")


def checked(found: DataFrame) -> DataFrame:
    """``found`` with ``kind`` and ``good``: whether a base match passes its check (null for looser generators)."""
    digits = F.regexp_replace("value", "[^0-9]", "")
    n = F.length(digits)
    octets = F.expr(r"forall(split(value, '\\.'), p -> length(ltrim('0', p)) <= 3 and coalesce(try_cast(ltrim('0', p) as int), 0) <= 255)")
    good = F.when(F.col("gen") == 0, F.lit(True)).when(F.col("gen") == 1, octets)
    good = good.when(F.col("gen") == 2, n.between(14, 19) & F.when(n.between(14, 19), F.call_function("luhn_check", digits)).otherwise(False)).when(F.col("gen") == 3, n.between(10, 15))
    kind = F.array(*[F.lit(KINDS.index(k)) for _, k, _, _ in GENERATORS])
    return found.withColumn("kind", F.get(kind, F.col("gen"))).withColumn("good", good)


def described(found: DataFrame) -> DataFrame:
    """``found`` with the features, each in few classes. A leading plus and country code say nothing here."""
    shape = F.regexp_replace("value", r"^\+[0-9]{1,3}[ ]", "")
    digits = F.length(F.regexp_replace(shape, "[^0-9]", ""))
    groups = F.size(F.split(shape, "[^A-Za-z0-9]+"))
    separators = F.array_distinct(F.split(F.regexp_replace(shape, "[A-Za-z0-9()@\\[\\]{}]", ""), ""))
    separator = F.when(F.size(separators) > 1, 5).otherwise(F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in ((" ", 1), (".", 2), ("-", 3), ("_", 4), ("/", 4)) for x in p]), F.try_element_at(separators, F.lit(1))), F.lit(0)))

    def class_of(c: Column) -> Column:
        return F.when(F.length(c) == 0, 0).when(c.rlike("[0-9]"), 1).when(c.rlike("[A-Za-z]"), 2).when(c.rlike("\\s"), 3).when(c.rlike("[.,;:!?]"), 4).otherwise(5)

    return found.withColumns({
        "kind_": F.col("kind"), "length_": F.least(F.floor(F.length(shape) / 5), F.lit(5)).cast("int"), "digits_": F.least(F.floor(digits / 3), F.lit(6)).cast("int"),
        "groups_": F.least(groups, F.lit(5)), "separator_": separator, "bracket_": F.col("value").rlike("[(\\[{]").cast("int"),
        "before_": class_of(F.right("before", F.lit(1))), "after_": class_of(F.left("after", F.lit(1))), "cue_": F.col("before").rlike(CUES).cast("int"),
        "same_": F.least(F.length(F.array_join(F.array_distinct(F.split(F.regexp_replace(shape, "[^0-9]", ""), "")), "")), F.lit(3)).cast("int"),
    })


def labelled(found: DataFrame) -> DataFrame:
    """``found`` with ``label`` (1, 0, null where nothing is certain) and ``covered``, by spans that pass."""
    # both frames only grow, so a window costs its rows once
    upto = Window.partitionBy("row").orderBy("start", "end", "gen").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("end"), F.desc("gen")).rowsBetween(Window.unboundedPreceding, -1)
    out = found
    for k in range(len(KINDS)):
        own = F.col("good") & (F.col("kind") == k)
        meets = (F.coalesce(F.max(F.when(own, F.col("end"))).over(upto), F.lit(-1)) > F.col("start")) | (F.coalesce(F.min(F.when(own, F.col("start"))).over(after), F.lit(2**31 - 1)) < F.col("end"))
        out = out.withColumn(f"meets{k}", meets)
    covered = F.greatest(*[F.col(f"meets{k}") for k in range(len(KINDS))])
    same = F.get(F.array(*[F.col(f"meets{k}") for k in range(len(KINDS))]), F.col("kind"))
    label = F.when(F.col("good").isNotNull(), F.col("good").cast("double")).when(same, 1.0).when(covered, 0.0)
    return out.withColumn("label", label).withColumn("covered", covered).drop(*[f"meets{k}" for k in range(len(KINDS))])


def selected(found: DataFrame, precision: float = PRECISION) -> DataFrame | None:
    """Feature patterns whose looser candidates are taken, or None where nothing can be learnt."""
    fold = F.pmod(F.xxhash64("row", "start"), F.lit(FOLDS))
    cells = written(found.groupBy(*FEATURES, (fold == 0).alias("kept_out"), "label").agg(F.count("*").alias("weight")).orderBy(*FEATURES, "kept_out", "label"))
    train = cells.where("not kept_out and label is not null")
    if train.select("label").distinct().count() < 2:
        return None
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="x")
    trees = GBTClassifier(featuresCol="x", labelCol="label", weightCol="weight", maxIter=ROUNDS, maxDepth=3, stepSize=0.3, seed=7)
    model = trees.fit(vectors.transform(train.withColumn("weight", F.col("weight").cast("double")).coalesce(1)))
    patterns = vectors.transform(cells.select(*FEATURES).distinct())
    scored = written(model.transform(patterns).select(*FEATURES, F.round(F.get(vector_to_array("probability"), F.lit(1)), 6).alias("p")))
    held = cells.where("kept_out and label is not null").join(broadcast_if_small(scored), list(FEATURES))
    steps = held.groupBy(F.col("kind_").alias("k"), "p").agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("label")).alias("hits"))
    down = Window.partitionBy("k").orderBy(F.desc("p"))
    steps = steps.withColumn("precision", F.sum("hits").over(down) / F.sum("n").over(down))
    limits = steps.where(F.col("precision") >= precision).groupBy("k").agg(F.min("p").alias("limit"))
    return scored.join(F.broadcast(limits), F.col("kind_") == F.col("k")).where("p >= limit").select(*FEATURES)


def personal(docs: DataFrame, key: str = "doc_id", text: str = "text", precision: float = PRECISION) -> DataFrame:
    """Per row: ``key``, ``spans`` and ``base`` (arrays of start, kind number, end, in order), for every row of ``docs``.

    Null text is empty and has none; null keys, repeated and empty rows keep theirs; an empty table gives no rows;
    other columns are not read. Without certain examples of both labels nothing is added to the base matches.
    """
    # a row's number is drawn once and written with its key: another scan could be cut into other partitions
    listed = written(proposed(docs, key, text))
    found = written(labelled(described(checked(matches(listed)))))
    taken = found.where("good").select("row", "start", "kind", "end", F.lit(True).alias("base"))
    patterns = selected(found, precision)
    if patterns is not None:
        loose = found.where("good is null and not covered").join(broadcast_if_small(patterns), list(FEATURES))
        taken = taken.unionByName(loose.select("row", "start", "kind", "end", F.lit(False).alias("base")))
    span = F.struct("start", "kind", "end")
    per = taken.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"), F.array_sort(F.collect_list(F.when(F.col("base"), span))).alias("base"))
    none = F.array().cast(per.schema["spans"].dataType)
    return listed.select("row", "key").join(per, "row", "left").select(F.col("key").alias(key), F.coalesce("spans", none).alias("spans"), F.coalesce("base", none).alias("base"))


def named(spans: str) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.col(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: str, kind: str) -> Column:
    return F.size(F.filter(F.col(spans), lambda s: s["kind"] == KINDS.index(kind))).cast("long")
