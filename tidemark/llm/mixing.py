"""Mixing sources to target weights by entropy balancing.

Each document gets a rate r = min(cap, exp(lambda * size / mean size)): of all rates under the cap whose words meet
the source's target, the ones of least entropy relative to taking every document once. The convex dual is solved by
Newton steps inside a shrinking bracket, all sources at once. A rate depends on source and size only, so the steps
run on the table of (source, size, documents), which is aggregated before anything is shuffled. Rates are rounded
to whole copies: the copy of a document's remaining fraction is taken if its hash falls below the fraction plus a
shift, and the shift of a source is searched on histograms so that the words taken meet the target; what one
document at the threshold leaves over is then given to the documents that fit it best.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.common import WORD, text_of, written
from tidemark.plans.sizing import broadcast_if_small

WEIGHTS = (5, 2, 1)
CAP = 3
ROUNDS = 60
NEAR = 1e-9
BINS = 4096
PASSES = 4
REPAIRS = 4


def word_count(text: str = "text"):
    """Number of runs of anything but ASCII white space; null gives 0."""
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def numbered(sources: DataFrame, column: str) -> DataFrame:
    """``sources`` (distinct) with ``position`` from 0 by code point, null last: numbers inside ranges plus offsets."""
    ranged = written(sources.repartitionByRange(F.col(column).asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    inside = ranged.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy(F.col(column).asc_nulls_last())))
    # one row for each partition
    sizes = ranged.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.withColumn("before", F.sum("size").over(Window.orderBy("part")) - F.col("size"))
    return inside.join(F.broadcast(before), "part").select(column, (F.col("n") + F.col("before") - 1).alias("position"))


def _on_source(left: DataFrame, right: DataFrame, source: str, how: str) -> DataFrame:
    """Null-safe join on the source; ``right`` has one row of it, and is broadcast under the checked size."""
    right = broadcast_if_small(right.withColumnRenamed(source, "_right"))
    return left.join(right, F.col(source).eqNullSafe(F.col("_right")), how).drop("_right")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, cap: float = CAP, source: str = "source") -> DataFrame:
    """``source``, ``source_size`` and ``target`` from ``sizes(source, source_size)``: shares by repeating ``weights``.

    No target exceeds ``cap`` times its source; the excess is shared again by weight until none does.
    """
    w = F.array(*[F.lit(float(x)) for x in weights])
    state = numbered(sizes.select(source), source).withColumn("weight", F.get(w, (F.col("position") % len(weights)).cast("int")))
    state = written(_on_source(sizes, state, source, "inner").select(source, "source_size", "weight", (F.lit(cap) * F.col("source_size")).cast("double").alias("most"), F.lit(False).alias("full")))
    while True:
        total, capped, weight = state.agg(F.sum("source_size"), F.sum(F.when(F.col("full"), F.col("most"))), F.sum(F.when(~F.col("full"), F.col("weight")))).first()
        level = (total or 0) - (capped or 0.0)
        share = F.lit(level) * F.col("weight") / F.lit(weight or 1.0)
        state = written(state.withColumn("target", F.when(F.col("full"), F.col("most")).otherwise(share)))
        if not state.where("not full and target > most").take(1):
            return state.select(source, "source_size", F.col("target").cast("double").alias("target"))
        state = state.withColumn("full", F.col("full") | (F.col("target") > F.col("most")))


def rates(histogram: DataFrame, wanted: DataFrame, cap: float = CAP, source: str = "source") -> DataFrame:
    """``source`` and ``lam`` with sum over documents of size * min(cap, exp(lam * size / mean)) equal to the target.

    ``histogram(source, size, n)``; ``wanted(source, source_size, target)``. A target at the cap gives null (every
    rate is the cap), a target of zero minus infinity in effect (rates of zero).
    """
    live = histogram.where("size > 0").groupBy(source).agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"), F.min("size").alias("small"))
    state = _on_source(wanted, live, source, "inner")
    ratio = F.col("target") / F.col("source_size")
    # at low every rate is under the ratio, at high over it: the smallest document decides
    steep = F.log(F.least(F.greatest(ratio, F.lit(1e-300)), F.lit(float(cap)))) * F.col("mean") / F.col("small")
    state = state.where((F.col("target") > 0) & (F.col("target") < cap * F.col("source_size") * (1 - 1e-12)))
    state = state.select(source, "target", "mean", F.least(steep, F.lit(0.0)).alias("low"), F.greatest(steep, F.lit(0.0)).alias("high"), F.log(ratio).alias("lam"), F.lit(False).alias("done"))
    state = written(state)
    for _ in range(ROUNDS):
        z = F.col("size") / F.col("mean")
        r = F.least(F.lit(float(cap)), F.exp(F.col("lam") * z))
        parts = _on_source(histogram.where("size > 0"), state.where("not done"), source, "inner").select(source, "size", "n", z.alias("z"), r.alias("r"))
        sums = parts.groupBy(source).agg(F.sum(F.col("n") * F.col("size") * F.col("r")).alias("value"), F.sum(F.when(F.col("r") < cap, F.col("n") * F.col("size") * F.col("r") * F.col("z")).otherwise(0.0)).alias("slope"))
        joined = _on_source(state, sums, source, "left")
        over = F.col("value") > F.col("target")
        joined = joined.withColumn("low", F.when(F.col("value").isNull() | over, F.col("low")).otherwise(F.col("lam"))).withColumn("high", F.when(over, F.col("lam")).otherwise(F.col("high")))
        newton = F.col("lam") - (F.col("value") - F.col("target")) / F.when(F.col("slope") > 0, F.col("slope"))
        inside = F.when((newton > F.col("low")) & (newton < F.col("high")), newton).otherwise((F.col("low") + F.col("high")) / 2)
        met = F.col("done") | (F.abs(F.col("value") - F.col("target")) <= NEAR * F.col("target"))
        state = written(joined.select(source, "target", "mean", "low", "high", F.when(F.coalesce(met, F.lit(True)), F.col("lam")).otherwise(inside).alias("lam"), F.coalesce(met, F.lit(True)).alias("done")))
        if not state.where("not done").take(1):
            break
    return state.select(source, "mean", "lam")


def _rows(docs: DataFrame, key: str, source: str, text: str, *more) -> DataFrame:
    """Size and draw (uniform in [0, 1), from key, source and text) beside key and source, under private names."""
    draw = F.shiftrightunsigned(F.xxhash64(F.col(key), F.col(source), text_of(text)), 11) / F.lit(float(1 << 53))
    return docs.select(*more, F.col(key).alias("_key"), F.col(source).alias("_source"), word_count(text).alias("_size"), draw.alias("_draw"))


def _applied(rows: DataFrame, plan: DataFrame, changes: DataFrame | None, cap: int) -> DataFrame:
    """``rows`` with the plan of their source, ``_rate``, ``_need`` and ``_copies``."""
    r = F.when(F.col("_size") == 0, 1.0).when(F.col("target") <= 0, 0.0).when(F.col("lam").isNull(), F.lit(float(cap)))
    r = r.otherwise(F.least(F.lit(float(cap)), F.exp(F.col("lam") * F.col("_size") / F.col("mean"))))
    out = rows.join(broadcast_if_small(plan), F.col("_source").eqNullSafe(F.col("source"))).drop("source")
    out = out.withColumn("_rate", r)
    whole = F.floor("_rate")
    # the least shift at which the next copy is taken; full documents never take another
    out = out.withColumn("_need", F.when((F.col("_size") > 0) & (whole < cap), F.col("_draw") - (F.col("_rate") - whole)))
    more = F.coalesce(F.col("_need") < F.col("shift"), F.lit(False)).cast("int") if "shift" in plan.columns else F.lit(0)
    out = out.withColumn("_copies", whole.cast("int") + more)
    if changes is None:
        return out
    c = changes.select(*[F.col(x).alias(f"c{x}") for x in ("_key", "_source", "_draw")], "by")
    at = [F.col(x).eqNullSafe(F.col(f"c{x}")) for x in ("_key", "_source", "_draw")]
    out = out.join(broadcast_if_small(c), at[0] & at[1] & at[2], "left").drop("c_key", "c_source", "c_draw")
    return out.withColumn("_copies", F.col("_copies") + F.coalesce("by", F.lit(0)).cast("int")).drop("by")


def _planned(rows: DataFrame, weights: tuple, cap: int) -> tuple[DataFrame, DataFrame | None]:
    """One row per source (target, tilt, shift), and the few documents whose copies are mended."""
    histogram = written(rows.groupBy(F.col("_source").alias("source"), F.col("_size").alias("size")).agg(F.count("*").alias("n")))
    wanted = written(targets(histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, cap))
    tilt = rates(histogram, wanted, cap)
    plan = written(_on_source(wanted, tilt, "source", "left"))
    rated = written(_applied(rows, plan, None, cap).select("_key", "_source", "_draw", "_size", "_need", "_copies", "target"))
    plan = _shifts(rated, plan)
    shift = plan.select(F.col("source").alias("s"), "shift")
    more = F.coalesce(F.col("_need") < F.col("shift"), F.lit(False)).cast("int")
    taken = rated.join(broadcast_if_small(shift), F.col("_source").eqNullSafe(F.col("s"))).withColumn("_copies", F.col("_copies") + more)
    return plan, _mended(taken, cap)


def _shifts(rated: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan`` with the shift per source under which the words taken are the most that do not pass the target."""
    base = rated.groupBy("_source").agg(F.sum(F.col("_copies") * F.col("_size")).alias("words"))
    state = plan.join(base, F.col("source").eqNullSafe(F.col("_source"))).select("source", (F.col("target") - F.col("words")).alias("left"), F.lit(-1.0).alias("low"), F.lit(1.0).alias("high"))
    state = written(state)
    needs = rated.where("_need is not null").select("_source", "_size", "_need")
    # each pass narrows the shift to one of BINS parts; four of them tell all draws apart
    for _ in range(PASSES):
        width = (F.col("high") - F.col("low")) / BINS
        bin_of = F.least(F.floor((F.col("_need") - F.col("low")) / width), F.lit(BINS - 1)).cast("int")
        inside = needs.join(broadcast_if_small(state), F.col("_source").eqNullSafe(F.col("source"))).where("_need >= low and _need < high")
        bins = inside.groupBy("_source", bin_of.alias("bin")).agg(F.sum("_size").alias("words"), F.first("left").alias("left"))
        upto = F.sum("words").over(Window.partitionBy("_source").orderBy("bin"))
        bins = bins.withColumn("upto", upto)
        fits = bins.groupBy("_source").agg(F.min(F.when(F.col("upto") > F.col("left"), F.struct("bin", (F.col("upto") - F.col("words")).alias("under")))).alias("at"), F.max("upto").alias("most"))
        joined = state.join(fits, F.col("source").eqNullSafe(F.col("_source")), "left")
        none = F.col("at").isNull()
        low = F.when(none, F.col("high")).otherwise(F.col("low") + F.col("at.bin") * width)
        high = F.when(none, F.col("high")).otherwise(F.col("low") + (F.col("at.bin") + 1) * width)
        used = F.when(none, F.coalesce("most", F.lit(0))).otherwise(F.col("at.under"))
        state = written(joined.select("source", (F.col("left") - used).alias("left"), low.alias("low"), high.alias("high")))
    shift = state.select(F.col("source").alias("s"), F.col("low").alias("shift"))
    return written(plan.join(shift, F.col("source").eqNullSafe(F.col("s"))).drop("s"))


def _mended(taken: DataFrame, cap: int) -> DataFrame | None:
    """Documents that get one copy more or less, the one each time that brings its source nearest to the target."""
    state = written(taken.groupBy("_source").agg((F.first("target") - F.sum(F.col("_copies") * F.col("_size"))).alias("left")))
    taken = taken.where("_size > 0").select("_key", "_source", "_draw", "_size", "_copies")
    changes = None
    for _ in range(REPAIRS):
        s = state.select(F.col("_source").alias("s"), "left")
        rows = taken.join(broadcast_if_small(s), F.col("_source").eqNullSafe(F.col("s")))
        rows = rows.where(((F.col("left") > 0) & (F.col("_copies") < cap)) | ((F.col("left") < 0) & (F.col("_copies") > 0)))
        if changes is not None:
            done = changes.select(*[F.col(x).alias(f"d{x}") for x in ("_key", "_source", "_draw")])
            rows = rows.join(broadcast_if_small(done), F.col("_key").eqNullSafe(F.col("d_key")) & F.col("_source").eqNullSafe(F.col("d_source")) & (F.col("_draw") == F.col("d_draw")), "left_anti")
        sign = F.signum("left")
        miss = F.abs(F.col("left") - sign * F.col("_size"))
        one = F.min_by(F.struct("_key", "_draw", "_size", sign.cast("int").alias("by"), miss.alias("miss"), F.abs("left").alias("was")), F.struct(miss, F.col("_draw"), F.col("_key")))
        best = written(rows.groupBy("_source").agg(one.alias("b")).where("b.miss < b.was").select("_source", "b._key", "b._draw", "b._size", "b.by"))
        if not best.take(1):
            break
        changes = best if changes is None else written(changes.unionByName(best))
        move = best.select(F.col("_source").alias("m"), (F.col("by") * F.col("_size")).alias("move"))
        state = written(state.join(move, F.col("_source").eqNullSafe(F.col("m")), "left").select("_source", (F.col("left") - F.coalesce("move", F.lit(0))).alias("left")))
    return changes


def mix(docs: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Per row: ``key``, ``source``, ``size``, ``source_size``, ``target``, ``rate`` and whole ``copies`` (0 to ``cap``).

    Null text has size 0, null sources form one source, numbered last. Rows without words are taken once. Rows equal
    in key, source and text draw alike, null keys like others; reruns agree. An empty table gives no rows. Other
    columns are not read.
    """
    rows = written(_rows(docs, key, source, text))
    plan, changes = _planned(rows, weights, cap)
    out = _applied(rows, plan, changes, cap)
    return out.select(F.col("_key").alias(key), F.col("_source").alias(source), F.col("_size").alias("size"), "source_size", "target", F.col("_rate").alias("rate"), F.col("_copies").alias("copies"))


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``docs`` with every row as often as ``mix`` takes it."""
    plan, changes = _planned(written(_rows(docs, key, source, text)), weights, cap)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    out = _applied(_rows(docs, key, source, text, whole), plan, changes, cap).where("_copies > 0")
    repeated = out.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return repeated.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
