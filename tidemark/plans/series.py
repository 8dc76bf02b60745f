"""Ordered per-key computations that stay parallel when one key holds most of the rows.

Three primitives, all exact:

* ``with_position``  dense row number per key, from local numbers plus a prefix sum of cell counts
* ``over_rows``      finite row frames: fixed-size blocks of positions with a halo of neighbours
* ``running``        unbounded running sum/max/min/count/last: local scan plus carried cell totals

A *cell* is the part of a key in one of many ranges of the whole order (keys, time, sequence). Ranges hold about as
many rows each, whatever the skew and however many times tie, so a hot key is spread over many tasks and only one
summary row per cell meets in the per-key carry. Null keys form a key of their own; null times sort first.

``by_key_size`` keeps that cost to the keys that need it: one count per key decides which of them fit one window.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.window import WindowSpec

from tidemark.plans.sizing import is_small, settled
from tidemark.session import checkpointed

DAY_US = 86_400_000_000
DEFAULT_CELL_ROWS = 2_000_000
DEFAULT_BLOCK_ROWS = 500_000
DEFAULT_KEY_ROWS = 500_000
HEAVY_SMALL_MB = 8


@dataclass(frozen=True)
class Series:
    """Keys and total order of a long table. ``bounded`` marks tables whose rows per key are limited
    by the calendar (bars, daily aggregates), for which one window per key is the right plan. ``long`` marks keys that
    ``by_key_size`` has found too long for that."""

    keys: tuple[str, ...] = ("symbol",)
    order: tuple[str, ...] = ("ts", "seq")
    bounded: bool = False
    long: bool = False

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def calendar(self) -> "Series":
        return replace(self, bounded=True)


TICKS = Series()
BARS = Series(order=("ts",), bounded=True)


def rows_before(w: WindowSpec, n: int) -> WindowSpec:
    """The last ``n`` rows including the current one."""
    return w.rowsBetween(-(n - 1), 0)


def so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _conf_int(df: DataFrame, name: str, default: int) -> int:
    return int(df.sparkSession.conf.get(name, str(default)))


def _cell(s: Series, width_us: int) -> Column:
    micros = F.unix_micros(F.col(s.order[0]).cast("timestamp"))
    return F.coalesce(F.floor(micros / F.lit(width_us)), F.lit(-(2**62))).cast("long")


def _cell_width(df: DataFrame, s: Series) -> int:
    """Narrow the time slice until no (key, slice) exceeds the row target; one scalar per try."""
    target = _conf_int(df, "tidemark.cell.rows", DEFAULT_CELL_ROWS)
    width = DAY_US
    for _ in range(8):
        counts = df.groupBy(*s.keys, _cell(s, width).alias("_cell")).agg(F.count(F.lit(1)).alias("n"))
        top = counts.agg(F.max("n")).first()[0] or 0
        if top <= target or width <= 1000:
            break
        width = max(1000, min(width // 2, width * target // top))
    return width


def join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where a null key equals a null key, as grouping has it; ``right`` adds its other columns."""
    other = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(other, on, how).drop(*[f"_right_{k}" for k in keys])


def by_key_size(df: DataFrame, s: Series, build: Callable[[DataFrame, Series], DataFrame], beside: DataFrame | None = None) -> DataFrame:
    """``build(rows, series)`` where the keys of at most ``tidemark.key.rows`` rows take one window (or group) each and only
    the longer ones take the split plan.

    The count reads the key columns alone; what comes back of it are the long keys, at most one per that many rows. With
    ``beside``, a second table of the same keys, the rows of both are counted and ``build(rows, beside, series)`` gets both.
    """
    tables = [df] if beside is None else [df, beside]
    if s.bounded or s.long or all(is_small(t) for t in tables):
        return build(*tables, s)
    split = replace(s, long=True)
    if df.sparkSession.conf.get("tidemark.layout", "auto") == "split":
        return build(*tables, split)
    most = _conf_int(df, "tidemark.key.rows", DEFAULT_KEY_ROWS)
    keyed = [t.select(*s.keys) for t in tables]
    counts = (keyed[0] if beside is None else keyed[0].unionByName(keyed[1])).groupBy(*s.keys).agg(F.count(F.lit(1)).alias("_n"))
    found = counts.agg(F.count(F.lit(1)), F.collect_list(F.when(F.col("_n") > most, F.struct(*s.keys)))).first()
    if not found[1]:
        return build(*tables, s.calendar())
    if len(found[1]) == found[0]:
        return build(*tables, split)
    hot = F.broadcast(df.sparkSession.createDataFrame(found[1], keyed[0].schema))
    parts = [[join_on_keys(t, hot, s.keys, how) for t in tables] for how in ("left_anti", "left_semi")]
    return build(*parts[0], s.calendar()).unionByName(build(*parts[1], split))


def _with_cells(df: DataFrame, s: Series) -> tuple[DataFrame, list[str]]:
    """Rows with the range they fall in as ``_cell``, in order along each key; written once, as ranges are sampled."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *s.keys, *s.order).withColumn("_cell", F.spark_partition_id())
    return checkpointed(ranged), [*s.keys, "_cell"]


def with_position(df: DataFrame, s: Series, name: str = "pos") -> DataFrame:
    """1-based dense position of each row within its key."""
    if s.bounded or is_small(df):
        return df.withColumn(name, F.row_number().over(s.window()).cast("long"))
    cells, cols = _with_cells(df, s)
    local = cells.withColumn("_rn", F.row_number().over(Window.partitionBy(*cols).orderBy(*s.order)))
    counts = cells.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    carry = Window.partitionBy(*s.keys).orderBy("_cell")
    offsets = counts.select(*cols, (F.sum("_n").over(so_far(carry)) - F.col("_n")).alias("_off"))
    return (
        join_on_keys(local, offsets, cols)
        .withColumn(name, F.col("_off") + F.col("_rn"))
        .drop("_cell", "_rn", "_off")
    )


def with_blocks(df: DataFrame, s: Series, before: int = 0, after: int = 0, most: int | None = None) -> DataFrame:
    """Add ``pos``, ``_blk`` and ``_halo``: blocks of consecutive positions, each with copies of the
    ``before`` rows ahead of it and the ``after`` rows behind it. Blocks have ``most`` rows at most, where given, for
    work that is heavy per row, but four times the halo at least."""
    rows = _conf_int(df, "tidemark.block.rows", DEFAULT_BLOCK_ROWS)
    rows = max(rows if most is None else min(rows, most), 4 * (before + after), 1)
    placed = with_position(df, s, "_pos").withColumn("_own", F.expr(f"(_pos - 1) div {rows}"))
    offset = F.expr(f"(_pos - 1) % {rows}")
    homes = F.array_compact(
        F.array(
            F.col("_own"),
            F.when(offset >= rows - before, F.col("_own") + 1) if before else F.lit(None).cast("long"),
            F.when((offset < after) & (F.col("_own") > 0), F.col("_own") - 1) if after else F.lit(None).cast("long"),
        )
    )
    return placed.withColumn("_blk", F.explode(homes)).withColumn("_halo", F.col("_blk") != F.col("_own"))


def over_rows(
    df: DataFrame,
    s: Series,
    build: Callable[[DataFrame, WindowSpec], DataFrame],
    before: int = 0,
    after: int = 0,
    most: int | None = None,
) -> DataFrame:
    """Run ``build(df, window)`` where every frame reaches at most ``before``/``after`` rows away.

    All columns of one spec are meant to be built in one call, so they share one exchange and sort. ``most`` bounds the
    blocks of frames that are heavy per row, which are cut from a smaller input on, so that few long keys fill all tasks.
    """
    if s.bounded or is_small(df, None if most is None else HEAVY_SMALL_MB):
        return build(df, s.window())
    blocks = with_blocks(df, s, before, after, most)
    if most is not None:  # rows placed by one window per key would stay in one task per key
        blocks = blocks.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *s.keys, "_blk")
    w = Window.partitionBy(*s.keys, "_blk").orderBy("_pos")
    return build(blocks, w).filter(~F.col("_halo")).drop("_pos", "_own", "_blk", "_halo")


def running(df: DataFrame, s: Series, specs: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """Running totals from the first row of a key to the current one.

    ``specs`` maps a new column to ``(kind, value)`` with kind in sum, max, min, count, last; ``last``
    carries the latest non-null value forward.
    """
    plain = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count, "last": lambda c: F.last(c, ignorenulls=True)}
    values = df.withColumns({f"_v_{name}": value for name, (_, value) in specs.items()})
    drop = [f"_v_{name}" for name in specs]
    if s.bounded or is_small(df):
        w = so_far(s.window())
        return values.withColumns({n: plain[k](F.col(f"_v_{n}")).over(w) for n, (k, _) in specs.items()}).drop(*drop)

    cells, cols = _with_cells(values, s)
    w = so_far(Window.partitionBy(*cols).orderBy(*s.order))
    local = cells.withColumns({f"_l_{n}": plain[k](F.col(f"_v_{n}")).over(w) for n, (k, _) in specs.items()})

    def total(name: str, kind: str) -> Column:
        value = F.col(f"_v_{name}")
        if kind == "last":
            at = F.struct(*[F.col(c) for c in s.order])
            return F.max_by(value, F.when(value.isNotNull(), at)).alias(f"_t_{name}")
        return plain[kind](value).alias(f"_t_{name}")

    totals = cells.groupBy(*cols).agg(*[total(n, k) for n, (k, _) in specs.items()])
    past = Window.partitionBy(*s.keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    merge = {**plain, "count": F.sum}
    carried = totals.select(*cols, *[merge[k](F.col(f"_t_{n}")).over(past).alias(f"_c_{n}") for n, (k, _) in specs.items()])

    def combine(name: str, kind: str) -> Column:
        here, before = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        if kind in ("sum", "count"):
            zero = F.lit(0)
            return F.when(here.isNull() & before.isNull(), here).otherwise(F.coalesce(here, zero) + F.coalesce(before, zero))
        if kind == "last":
            return F.coalesce(here, before)
        return (F.greatest if kind == "max" else F.least)(here, before)

    out = join_on_keys(local, carried, cols).withColumns({n: combine(n, k) for n, (k, _) in specs.items()})
    return out.drop("_cell", *drop, *[f"_l_{n}" for n in specs], *[f"_c_{n}" for n in specs])


def asof(
    left: DataFrame,
    right: DataFrame,
    by: tuple[str, ...],
    take: Mapping[str, str],
    ts: str = "ts",
    tie: str = "seq",
    tolerance_s: float | None = None,
    right_ts: str = "right_ts",
    forward: bool = False,
) -> DataFrame:
    """Latest right row at or before each left row (first at or after it when ``forward``).

    One union, one scan by key: no range join and no per-key collection. ``take`` maps right columns
    to their output names; the right time comes back as ``right_ts``. Needs ``ts`` and ``tie`` on both.
    """
    sign = -1 if forward else 1
    stamp = F.unix_micros(F.col(ts).cast("timestamp"))
    rights = right.select(
        *by, F.col(ts), F.col(tie), F.lit(0).alias("_side"),
        F.struct(F.col(ts).alias("_ts"), *[F.col(c).alias(n) for c, n in take.items()]).alias("_hit"),
    )
    lefts = left.withColumn("_side", F.lit(1))
    both = lefts.unionByName(rights, allowMissingColumns=True)
    both = both.withColumns({
        "_at": F.timestamp_micros(stamp * sign), "_tie": F.col(tie) * sign,
    })
    s = Series(tuple(by), ("_at", "_side", "_tie"))
    hit = running(both, s, {"_last": ("last", F.col("_hit"))}).filter("_side = 1")
    if tolerance_s is not None:
        gap = F.abs(F.unix_micros(F.col("_last._ts").cast("timestamp")) - stamp) / F.lit(1e6)
        hit = hit.withColumn("_last", F.when(gap <= tolerance_s, F.col("_last")))
    kept = [c for c in left.columns]
    return hit.select(*kept, F.col("_last._ts").alias(right_ts), *[F.col(f"_last.{n}").alias(n) for n in take.values()])


def over_time(
    df: DataFrame, s: Series, reach_s: float, build: Callable[[DataFrame, WindowSpec], DataFrame]
) -> DataFrame:
    """Run ``build(df, window)`` where every frame looks back at most ``reach_s`` seconds. The window is
    ordered by ``_t`` (epoch seconds), for range frames. Time slices get copies of the rows just before them and are
    no narrower than the reach, so a row is copied once at most."""
    timed = df.withColumn("_t", F.unix_micros(F.col(s.order[0]).cast("timestamp")) / F.lit(1e6))
    if s.bounded or is_small(df):
        return build(timed, Window.partitionBy(*s.keys).orderBy("_t")).drop("_t")
    timed = settled(timed)
    width = max(_cell_width(timed, s), int(reach_s * 1e6))
    own = _cell(s, width)
    last = F.floor((F.unix_micros(F.col(s.order[0]).cast("timestamp")) + F.lit(int(reach_s * 1e6))) / F.lit(width)).cast("long")
    cells = timed.withColumn("_own", own).withColumn("_cell", F.explode(F.sequence(F.col("_own"), F.coalesce(last, F.col("_own")))))
    out = build(cells, Window.partitionBy(*s.keys, "_cell").orderBy("_t"))
    return out.filter("_cell = _own").drop("_t", "_own", "_cell")
