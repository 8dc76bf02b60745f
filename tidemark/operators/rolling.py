"""Rolling statistics and technical features over ordered series.

Every function takes the series layout as ``s``: raw ticks use the split layout, bars and daily
aggregates (bounded by the calendar) one window per key. All columns of one window spec are built in
one projection, so a call costs one exchange and one sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.maths import clip, ratio, two_sided_normal_p
from tidemark.functions.rules import severity
from tidemark.plans.series import BARS, TICKS, Series, over_rows, rows_before, running, so_far, with_position
from tidemark.plans.sizing import broadcast_if_small

HOURS_PER_YEAR = 24 * 365


def _windowed(df, s, columns, before, after=0):
    """``columns`` maps names to functions of the window spec; built side by side."""
    return over_rows(df, s, lambda d, w: d.withColumns({n: f(w) for n, f in columns.items()}), before, after)


def moving_average(df: DataFrame, value: str, windows: Sequence[int] = (3, 7, 14), s: Series = TICKS) -> DataFrame:
    x, cols = F.col(value), {}
    for n in windows:
        cols[f"ma_{n}"] = lambda w, n=n: F.avg(x).over(rows_before(w, n))
        cols[f"ma_momentum_{n}"] = lambda w, n=n: ratio(x, F.avg(x).over(rows_before(w, n))) - 1
    return _windowed(df, s, cols, max(windows) - 1)


def volatility(df: DataFrame, value: str, windows: Sequence[int] = (7, 14), s: Series = TICKS) -> DataFrame:
    x, cols = F.col(value), {}
    for n in windows:
        cols[f"volatility_{n}"] = lambda w, n=n: F.stddev_samp(x).over(rows_before(w, n))
        cols[f"cv_{n}"] = lambda w, n=n: ratio(F.stddev_samp(x).over(rows_before(w, n)), F.avg(x).over(rows_before(w, n)))
    return _windowed(df, s, cols, max(windows) - 1)


def momentum(df: DataFrame, value: str, windows: Sequence[int] = (7, 14, 30), s: Series = TICKS) -> DataFrame:
    x = F.col(value)

    def build(d: DataFrame, w) -> DataFrame:
        d = d.withColumns({f"momentum_{n}": ratio(x, F.lag(x, n).over(w)) - 1 for n in windows})
        return d.withColumns({
            f"acceleration_{n}": F.col(f"momentum_{n}") - F.lag(f"momentum_{n}", 1).over(w) for n in windows
        })

    return over_rows(df, s, build, max(windows) + 1)


def rolling_zscore(df: DataFrame, value: str, windows: Sequence[int] = (30, 60), s: Series = TICKS) -> DataFrame:
    x = F.col(value)
    cols = {
        f"zscore_{n}": lambda w, n=n: ratio(x - F.avg(x).over(rows_before(w, n)), F.stddev_samp(x).over(rows_before(w, n)))
        for n in windows
    }
    return _windowed(df, s, cols, max(windows) - 1)


def rolling_percentile_rank(df: DataFrame, value: str, windows: Sequence[int] = (30, 60, 90), s: Series = TICKS) -> DataFrame:
    """Mean of the strict and weak percentile ranks of the current value in its window, in 0..1."""
    x = F.col(value)

    def build(d: DataFrame, w) -> DataFrame:
        d = d.withColumns({f"_list_{n}": F.collect_list(x).over(rows_before(w, n)) for n in windows})
        out = {}
        for n in windows:
            seen = F.col(f"_list_{n}")
            under = F.size(F.filter(seen, lambda v: v < x))
            upto = F.size(F.filter(seen, lambda v: v <= x))
            tied = F.when(upto > under, 1).otherwise(0)
            out[f"percentile_{n}"] = ratio((under + upto + tied).cast("double"), 2.0 * F.size(seen))
        return d.withColumns(out).drop(*[f"_list_{n}" for n in windows])

    return over_rows(df, s, build, max(windows) - 1)


def _median(sorted_values: Column) -> Column:
    n = F.size(sorted_values)
    upper = F.try_element_at(sorted_values, F.floor(n / 2).cast("int") + 1)
    lower = F.try_element_at(sorted_values, F.ceil(n / 2).cast("int"))
    return (upper + lower) / 2


def mad_score(df: DataFrame, value: str, windows: Sequence[int] = (14, 30), s: Series = TICKS) -> DataFrame:
    """Distance from the rolling median in units of the median absolute deviation."""
    x = F.col(value)

    def build(d: DataFrame, w) -> DataFrame:
        d = d.withColumns({f"_list_{n}": F.array_sort(F.collect_list(x).over(rows_before(w, n))) for n in windows})
        d = d.withColumns({f"_mid_{n}": _median(F.col(f"_list_{n}")) for n in windows})

        def deviations(n: int) -> Column:
            mid = F.col(f"_mid_{n}")
            return F.array_sort(F.transform(F.col(f"_list_{n}"), lambda v: F.abs(v - mid)))

        d = d.withColumns({f"_dev_{n}": deviations(n) for n in windows})
        d = d.withColumns({f"mad_score_{n}": ratio(F.abs(x - F.col(f"_mid_{n}")), _median(F.col(f"_dev_{n}"))) for n in windows})
        return d.drop(*[f"{p}_{n}" for n in windows for p in ("_list", "_mid", "_dev")])

    return over_rows(df, s, build, max(windows) - 1)


def trend_slope(df: DataFrame, value: str, windows: Sequence[int] = (7, 14, 30), s: Series = TICKS) -> DataFrame:
    """Least-squares slope against the row number, null with fewer than two rows."""
    y = F.col(value)

    def build(d: DataFrame, w) -> DataFrame:
        d = d.withColumn("_i", F.row_number().over(w).cast("double"))
        d = d.withColumns({
            f"trend_{n}": F.when(
                F.count(y).over(rows_before(w, n)) >= 2, F.regr_slope(y, F.col("_i")).over(rows_before(w, n))
            )
            for n in windows
        })
        return d.drop("_i")

    return over_rows(df, s, build, max(windows) - 1)


def rsi_simple(df: DataFrame, value: str, n: int = 14, s: Series = TICKS, unit: bool = False) -> DataFrame:
    """RSI from plain means of the last ``n`` gains and losses; 50 until there are n+1 rows, 100 without
    losses. With ``unit`` the scale is 0..1 and both special cases read 0.5."""
    x = F.col(value)

    def build(d: DataFrame, w) -> DataFrame:
        d = d.withColumn("_d", x - F.lag(x, 1).over(w))
        frame = rows_before(w, n)
        d = d.withColumns({
            "_gain": F.avg(F.greatest(F.col("_d"), F.lit(0.0))).over(frame),
            "_loss": F.avg(F.greatest(-F.col("_d"), F.lit(0.0))).over(frame),
            "_have": F.count("_d").over(frame),
        })
        full = 100 - 100 / (1 + ratio("_gain", "_loss"))
        rsi = F.when(F.col("_have") < n, 50.0).when(F.col("_loss") == 0, 50.0 if unit else 100.0).otherwise(full)
        return d.withColumn("rsi", rsi / 100 if unit else rsi).drop("_d", "_gain", "_loss", "_have")

    return over_rows(df, s, build, n)


def bollinger(df: DataFrame, value: str, n: int = 20, k: float = 2.0, clipped: bool = False, s: Series = TICKS) -> DataFrame:
    """Bands of k population deviations around the rolling mean, on full windows; the clipped position
    (regime features) reads 0.5 where the window is short or flat."""
    x = F.col(value)

    def build(d: DataFrame, w) -> DataFrame:
        frame = rows_before(w, n)
        full = F.count(x).over(frame) >= n
        d = d.withColumns({
            "bb_upper": F.when(full, F.avg(x).over(frame) + k * F.stddev_pop(x).over(frame)),
            "bb_lower": F.when(full, F.avg(x).over(frame) - k * F.stddev_pop(x).over(frame)),
        })
        place = ratio(x - F.col("bb_lower"), F.col("bb_upper") - F.col("bb_lower"))
        return d.withColumn("bb_position", F.coalesce(clip(place, 0, 1), F.lit(0.5)) if clipped else place)

    return over_rows(df, s, build, n - 1)


def true_range(high: str, low: str, prior_close: Column) -> Column:
    return F.greatest(F.col(high) - F.col(low), F.abs(F.col(high) - prior_close), F.abs(F.col(low) - prior_close))


def atr_simple(df: DataFrame, n: int = 14, s: Series = BARS) -> DataFrame:
    """Mean true range of the last n bars, 0 until there are n+1 bars."""

    def build(d: DataFrame, w) -> DataFrame:
        prior = F.lag("close", 1).over(w)
        d = d.withColumn("_tr", F.when(prior.isNotNull(), true_range("high", "low", prior)))
        frame = rows_before(w, n)
        return d.withColumn(
            "atr", F.when(F.count("_tr").over(frame) >= n, F.avg("_tr").over(frame)).otherwise(0.0)
        ).drop("_tr")

    return over_rows(df, s, build, n)


def fill_gaps(df: DataFrame, value: str, out: str, s: Series = TICKS) -> DataFrame:
    """Carry the last value forward; rows before the first value take that first value."""
    if s.bounded:
        onward = s.window().rowsBetween(Window.currentRow, Window.unboundedFollowing)
        past = F.last(value, ignorenulls=True).over(so_far(s.window()))
        return df.withColumn(out, F.coalesce(past, F.first(value, ignorenulls=True).over(onward)))
    ahead = running(df, s, {out: ("last", F.col(value))})
    at = F.struct(*[F.col(c) for c in s.order])
    first = df.filter(F.col(value).isNotNull()).groupBy(*s.keys).agg(F.min_by(value, at).alias("_first"))
    return (
        ahead.join(broadcast_if_small(first), list(s.keys), "left")
        .withColumn(out, F.coalesce(F.col(out), F.col("_first")))
        .drop("_first")
    )


def drawdown(df: DataFrame, value: str, s: Series = TICKS) -> DataFrame:
    """Running peak and drawdown from it; ``peak_time`` is when the current peak was reached."""
    peaks = running(df, s, {"peak": ("max", F.col(value))})
    ts = s.order[0]
    # a strictly higher value starts a new spell; equal values stay in the running drawdown
    prior = over_rows(peaks, s, lambda d, w: d.withColumn("_prior", F.lag("peak", 1).over(w)), before=1)
    marked = prior.withColumn("_new", F.when(F.col("_prior").isNull() | (F.col("peak") > F.col("_prior")), F.col(ts)))
    timed = running(marked, s, {"peak_time": ("last", F.col("_new"))})
    return timed.withColumn("drawdown", ratio(F.col("peak") - F.col(value), "peak")).drop("_prior", "_new")


def drawdown_summary(df: DataFrame, value: str, s: Series = TICKS) -> DataFrame:
    """Per key: current and maximum drawdown, and the longest closed spell below a peak in days."""
    at = F.struct(*[F.col(c) for c in s.order])
    ts = s.order[0]
    path = drawdown(df, value, s)
    spells = (
        path.groupBy(*s.keys, "peak_time")
        .agg(
            F.max("drawdown").alias("deepest"),
            F.min(F.when(F.col(ts) > F.col("peak_time"), F.col(ts))).alias("start"),
            F.max_by("drawdown", at).alias("final"),
        )
    )
    w = Window.partitionBy(*s.keys).orderBy("peak_time")
    ends = spells.withColumn("end", F.lead("peak_time").over(w))
    days = (F.unix_micros("end") - F.unix_micros("start")) / F.lit(86_400e6)
    return ends.groupBy(*s.keys).agg(
        F.max("deepest").alias("max_drawdown"),
        F.max_by("final", "peak_time").alias("current_drawdown"),
        F.coalesce(F.max(days), F.lit(0.0)).alias("longest_spell_days"),
    )


def returns(df: DataFrame, value: str = "price", s: Series = TICKS) -> DataFrame:
    """Simple and log returns to the previous row, 0 where either price is not positive."""
    x = F.col(value)

    def build(d: DataFrame, w) -> DataFrame:
        p = F.lag(x, 1).over(w)
        good = (x > 0) & (p > 0)
        return d.withColumns({
            "ret": F.when(p.isNull(), None).when(good, ratio(x, p) - 1).otherwise(0.0),
            "log_ret": F.when(p.isNull(), None).when(good, F.ln(ratio(F.when(x > 0, x), F.when(p > 0, p)))).otherwise(0.0),
        })

    return over_rows(df, s, build, 1)


def horizon_returns(df: DataFrame, value: str = "close", horizons: Sequence[int] = (1, 4, 24, 168), s: Series = BARS) -> DataFrame:
    x = F.col(value)
    cols = {f"returns_{n}": lambda w, n=n: ratio(x, F.lag(x, n).over(w)) - 1 for n in horizons}
    return _windowed(df, s, cols, max(horizons))


def horizon_volatility(df: DataFrame, value: str = "close", horizons: Sequence[int] = (1, 4, 24, 168), s: Series = BARS) -> DataFrame:
    """Annualised population deviation of the last n hourly returns, on full windows."""
    x = F.col(value)

    def build(d: DataFrame, w) -> DataFrame:
        d = d.withColumn("_r", ratio(x, F.lag(x, 1).over(w)) - 1)
        return d.withColumns({
            f"volatility_{n}": F.when(
                F.count("_r").over(rows_before(w, n)) >= n, F.stddev_pop("_r").over(rows_before(w, n)) * HOURS_PER_YEAR**0.5
            )
            for n in horizons
        }).drop("_r")

    return over_rows(df, s, build, max(horizons))


def volume_ratio(df: DataFrame, value: str = "volume", horizons: Sequence[int] = (1, 4, 24), s: Series = BARS) -> DataFrame:
    """Volume over the mean of the previous n bars."""
    x = F.col(value)
    cols = {}
    for n in horizons:
        cols[f"volume_ratio_{n}"] = lambda w, n=n: F.when(
            F.count(x).over(w.rowsBetween(-n, -1)) >= n, ratio(x, F.avg(x).over(w.rowsBetween(-n, -1)))
        )
    return _windowed(df, s, cols, max(horizons))


def volatility_clustering(df: DataFrame, ret: str = "ret", n: int = 20, s: Series = BARS) -> DataFrame:
    """Per key: lag-1 autocorrelation of the rolling deviation, 0 with fewer than 2n returns."""

    def build(d: DataFrame, w) -> DataFrame:
        frame = rows_before(w, n)
        d = d.withColumn("_v", F.when(F.count(ret).over(frame) >= n, F.stddev_samp(ret).over(frame)))
        return d.withColumn("_p", F.lag("_v", 1).over(w))

    pairs = over_rows(df.filter(F.col(ret).isNotNull()), s, build, n)
    enough = F.count(F.lit(1)) >= 2 * n
    return pairs.groupBy(*s.keys).agg(
        F.when(enough, F.coalesce(F.nanvl(F.corr("_v", "_p"), F.lit(0.0)), F.lit(0.0))).otherwise(0.0).alias("clustering")
    )


def volatility_regime_indicator(df: DataFrame, ret: str = "ret", n: int = 10, s: Series = BARS) -> DataFrame:
    """Recent over expanding deviation mapped to 0..1; 0.5 while short or flat."""
    x = F.col(ret)
    base = df.filter(x.isNotNull())
    sums = running(base, s, {"_n": ("count", x), "_s": ("sum", x), "_q": ("sum", x * x)})

    def build(d: DataFrame, w) -> DataFrame:
        mean = F.col("_s") / F.col("_n")
        whole = F.sqrt(F.greatest(F.col("_q") / F.col("_n") - mean * mean, F.lit(0.0)))
        score = clip((ratio(F.stddev_pop(x).over(rows_before(w, n)), whole) - 0.5) * 2, 0, 1)
        return d.withColumn(
            "vol_regime", F.when(F.col("_n") < n, 0.5).otherwise(F.coalesce(score, F.lit(0.5)))
        ).drop("_n", "_s", "_q")

    return over_rows(sums, s, build, n - 1)


def trend_quality(df: DataFrame, value: str = "close", n: int = 20, s: Series = BARS) -> DataFrame:
    """``trend_strength`` = slope / mean * r2 and ``trend_consistency`` = share of the dominant sign."""
    y = F.col(value)

    def build(d: DataFrame, w) -> DataFrame:
        d = d.withColumns({"_i": F.row_number().over(w).cast("double"), "_d": y - F.lag(y, 1).over(w)})
        frame, moves = rows_before(w, n), rows_before(w, n - 1)
        full = F.count(y).over(frame) >= n
        slope, mean = F.regr_slope(y, F.col("_i")).over(frame), F.avg(y).over(frame)
        r2 = F.coalesce(F.regr_r2(y, F.col("_i")).over(frame), F.lit(0.0))
        ups = F.sum(F.when(F.col("_d") > 0, 1).otherwise(0)).over(moves)
        downs = F.sum(F.when(F.col("_d") < 0, 1).otherwise(0)).over(moves)
        return d.withColumns({
            "trend_strength": F.when(full & (mean > 0), ratio(slope, mean) * r2).otherwise(0.0),
            "trend_consistency": F.when(full, F.greatest(ups, downs) / F.lit(n - 1)).otherwise(0.0),
        }).drop("_i", "_d")

    return over_rows(df, s, build, n - 1)


def zscore_anomaly(df: DataFrame, value: str, n: int = 50, threshold: float = 3.0, s: Series = TICKS) -> DataFrame:
    """Rows whose distance from the previous n-1 rows reaches ``threshold`` population deviations."""
    x = F.col(value)

    def build(d: DataFrame, w) -> DataFrame:
        past = w.rowsBetween(-(n - 1), -1)
        return d.withColumn(
            "z_score",
            F.when(F.count(x).over(past) >= n - 1, ratio(x - F.avg(x).over(past), F.stddev_pop(x).over(past))),
        )

    z = F.abs("z_score")
    return over_rows(df, s, build, n - 1).filter(z >= threshold).withColumns({
        "severity": severity("z_score", threshold),
        "p_value": two_sided_normal_p("z_score"),
        "confidence": F.least(F.lit(0.99), z / 5.0),
        "exceeded": z - threshold,
    })


def iqr_anomaly(df: DataFrame, value: str, n: int = 50, k: float = 1.5, s: Series = TICKS) -> DataFrame:
    """Rows outside the quartiles by k interquartile ranges; distance in ranges beyond the bound."""
    x = F.col(value)

    def build(d: DataFrame, w) -> DataFrame:
        frame = rows_before(w, n)
        full = F.count(x).over(frame) >= n
        return d.withColumns({
            "q1": F.when(full, F.percentile(x, F.lit(0.25)).over(frame)),
            "q3": F.when(full, F.percentile(x, F.lit(0.75)).over(frame)),
        })

    iqr = F.col("q3") - F.col("q1")
    low, high = F.col("q1") - k * iqr, F.col("q3") + k * iqr
    beyond = F.when(x < low, ratio(low - x, iqr)).when(x > high, ratio(x - high, iqr))
    return (
        over_rows(df, s, build, n - 1).withColumn("distance", beyond).filter(F.col("distance").isNotNull())
        .withColumns({
            "severity": severity("distance", k),
            "confidence": F.least(F.lit(0.99), F.col("distance") / 3.0),
        })
    )


def threshold_anomaly(df: DataFrame, value: str, threshold: float) -> DataFrame:
    """Rows at or below the threshold; severity by distance in units of its absolute value."""
    x = F.col(value)
    return df.filter(x <= threshold).withColumns({
        "exceeded": F.abs(x - threshold),
        "severity": severity(x, threshold),
    })


def diff_changepoints(df: DataFrame, value: str, s: Series = TICKS) -> DataFrame:
    """Rows whose absolute step exceeds the key's mean step by two population deviations."""
    x = F.col(value)
    steps = over_rows(df, s, lambda d, w: d.withColumn("step", F.abs(x - F.lag(x, 1).over(w))), before=1)
    bounds = steps.groupBy(*s.keys).agg((F.avg("step") + 2 * F.stddev_pop("step")).alias("bound"))
    return steps.join(broadcast_if_small(bounds), list(s.keys)).filter(F.col("step") > F.col("bound"))


def rolling_statistics(df: DataFrame, value: str, n: int = 24, s: Series = TICKS) -> DataFrame:
    x = F.col(value)

    def full(fn):
        return lambda w: F.when(F.count(x).over(rows_before(w, n)) >= n, fn(x).over(rows_before(w, n)))

    cols = {"rolling_mean": F.avg, "rolling_std": F.stddev_samp, "rolling_min": F.min, "rolling_max": F.max}
    return _windowed(df, s, {name: full(fn) for name, fn in cols.items()}, n - 1)


def spread(a: Column | str, b: Column | str, hedge: Column | float, method: str = "ratio") -> Column:
    """Pair spread by ``ratio``, ``difference`` or ``log_ratio``."""
    a, b = (F.col(v) if isinstance(v, str) else v for v in (a, b))
    h = hedge if isinstance(hedge, Column) else F.lit(float(hedge))
    if method == "ratio":
        return ratio(a, b) - h
    if method == "difference":
        return a - h * b
    if method == "log_ratio":
        q = ratio(a, b)
        return F.ln(F.when(q > 0, q)) - F.ln(F.when(h > 0, h))
    raise ValueError(f"unknown spread method {method}")


def spread_zscore(df: DataFrame, value: str, n: int = 100, s: Series = TICKS) -> DataFrame:
    """Z-score inside a window that includes the current row: null for one row, 0 when flat."""
    x = F.col(value)

    def build(d: DataFrame, w) -> DataFrame:
        frame = rows_before(w, n)
        z = ratio(x - F.avg(x).over(frame), F.stddev_samp(x).over(frame))
        return d.withColumn("z_score", F.when(F.count(x).over(frame) >= 2, F.coalesce(z, F.lit(0.0))))

    return over_rows(df, s, build, n - 1)


def adaptive_thresholds(
    df: DataFrame, spread_col: str, vol_col: str, n: int = 50, entry: float = 2.0, exit_: float = 0.5,
    factor: float = 0.5, low: float = 1.0, high: float = 4.0, s: Series = TICKS,
) -> DataFrame:
    """Entry, exit and stop levels scaled by the volatility forecast relative to its recent mean."""
    x, v = F.col(spread_col), F.col(vol_col)

    def build(d: DataFrame, w) -> DataFrame:
        f = rows_before(w, n)
        return d.withColumns({
            "_n": F.count(x).over(f), "_m": F.avg(x).over(f), "_sd": F.stddev_samp(x).over(f),
            "_vn": F.count(v).over(f), "_vm": F.avg(v).over(f), "_vs": F.stddev_pop(v).over(f),
            "_p25": F.percentile(v, F.lit(0.25)).over(f), "_p75": F.percentile(v, F.lit(0.75)).over(f),
        })

    d = over_rows(df, s, build, n - 1)
    short = F.col("_n") < 2
    z = F.when(short, x).when(F.col("_sd") == 0, 0.0).otherwise(ratio(x - F.col("_m"), "_sd"))
    relative = F.when(F.col("_vm") > 0, ratio(v, "_vm")).otherwise(1.0)
    multiplier = 1 + factor * (F.coalesce(relative, F.lit(1.0)) - 1)
    regime = F.when(F.col("_vn") < 10, "normal").when(v <= F.col("_p25"), "low").when(v >= F.col("_p75"), "high").otherwise("normal")
    stability = F.when(F.col("_vn") > 1, 1 / (1 + F.col("_vs"))).otherwise(0.5)
    d = d.withColumns({"z_score": z, "entry": clip(entry * multiplier, low, high), "_m2": multiplier})
    d = d.withColumns({
        "exit": F.least(F.greatest(exit_ * F.col("_m2"), F.lit(0.1)), F.col("entry") * 0.8),
        "stop": F.least(F.greatest(F.col("entry") * 1.5, F.col("entry")), F.lit(high * 1.5)),
        "regime": regime,
        "confidence": (F.least(F.lit(1.0), F.col("_n") / F.lit(n)) + stability) / 2,
    })
    return d.drop("_n", "_m", "_sd", "_vn", "_vm", "_vs", "_p25", "_p75", "_m2")


def bar_features(df: DataFrame, value: str = "close", s: Series = BARS) -> DataFrame:
    """Returns, volatility over 5 and 24 bars and momentum over 5 and 24 bars."""
    x = F.col(value)

    def build(d: DataFrame, w) -> DataFrame:
        p = F.lag(x, 1).over(w)
        d = d.withColumns({"ret": ratio(x, p) - 1, "log_ret": F.ln(ratio(F.when(x > 0, x), F.when(p > 0, p)))})
        cols = {}
        for n in (5, 24):
            f = rows_before(w, n)
            cols[f"volatility_{n}"] = F.when(F.count("ret").over(f) >= n, F.stddev_samp("ret").over(f))
            cols[f"momentum_{n}"] = ratio(x, F.lag(x, n).over(w)) - 1
        return d.withColumns(cols)

    return over_rows(df, s, build, 25)


def price_range_position(df: DataFrame, value: str = "close", n: int = 20, s: Series = BARS) -> DataFrame:
    x = F.col(value)

    def build(d: DataFrame, w) -> DataFrame:
        f = rows_before(w, n)
        low, high = F.min(x).over(f), F.max(x).over(f)
        place = F.when(F.count(x).over(f) >= n, ratio(x - low, high - low))
        return d.withColumn("range_position", F.coalesce(place, F.lit(0.5)))

    return over_rows(df, s, build, n - 1)


def stride_windows(df: DataFrame, size: int, stride: int, s: Series = BARS) -> DataFrame:
    """Copy each row into every full window of ``size`` rows that starts at a multiple of ``stride``."""
    totals = df.groupBy(*s.keys).agg(F.count(F.lit(1)).alias("_total"))
    placed = with_position(df, s, "_pos").join(broadcast_if_small(totals), list(s.keys))
    first = F.greatest(F.ceil((F.col("_pos") - F.lit(size)) / F.lit(stride)), F.lit(0))
    last = F.least(F.floor((F.col("_pos") - 1) / F.lit(stride)), F.floor((F.col("_total") - F.lit(size)) / F.lit(stride)))
    ids = F.when(first <= last, F.sequence(first.cast("long"), last.cast("long")))
    return placed.withColumn("window_id", F.explode(ids)).withColumn(
        "window_row", F.col("_pos") - 1 - F.col("window_id") * stride
    ).drop("_pos", "_total")


def regime_changes(df: DataFrame, label: str, last: int = 10, s: Series = TICKS) -> DataFrame:
    """The latest ``last`` changes per key, newest first."""
    from tidemark.operators.ranking import latest_per_key

    marked = over_rows(df, s, lambda d, w: d.withColumn("previous", F.lag(label, 1).over(w)), before=1)
    changed = marked.filter(F.col("previous").isNotNull() & (F.col(label) != F.col("previous")))
    return latest_per_key(changed, s, last, "recency")


def cross_features(df: DataFrame) -> DataFrame:
    """Ratios between on-chain metrics; null instead of infinity."""
    return df.withColumns({
        "flow_ratio": ratio("outflow", "inflow"),
        "flow_pressure": ratio(F.col("outflow") - F.col("inflow"), F.col("outflow") + F.col("inflow")),
        "tx_per_address": ratio("transactions", "addresses"),
        "whale_dominance": ratio("whales", "transactions"),
        "hodl_ratio": ratio("supply_old", "supply_young"),
        "valuation": F.col("mvrv") * F.col("nvt"),
    })


def composite_scores(df: DataFrame, s: Series = BARS) -> DataFrame:
    """Bullish, bearish and momentum scores; the whale z-score is taken over each key's whole series."""
    def with_stats(d: DataFrame) -> DataFrame:
        if s.bounded:
            whole = Window.partitionBy(*s.keys)
            return d.withColumns({"_wm": F.avg("whales").over(whole), "_ws": F.stddev_samp("whales").over(whole)})
        stats = df.groupBy(*s.keys).agg(F.avg("whales").alias("_wm"), F.stddev_samp("whales").alias("_ws"))
        return d.join(broadcast_if_small(stats), list(s.keys))

    def build(d: DataFrame, w) -> DataFrame:
        def change(c):
            return F.coalesce(ratio(c, F.lag(c, 7).over(w)) - 1, F.lit(0.0))

        return d.withColumns({"_fm": change("net_flow"), "_am": change("addresses"), "_wmo": change("whales")})

    d = with_stats(over_rows(df, s, build, 7))
    flow = F.coalesce(F.col("net_flow"), F.lit(0.0))
    whale = F.coalesce(ratio(F.col("whales") - F.col("_wm"), "_ws"), F.lit(0.0))
    return d.withColumns({
        "bullish": (flow + whale + F.col("_am")) / 3,
        "bearish": (-flow - F.col("_am")) / 2,
        "momentum": (F.col("_fm") + F.col("_am") + F.col("_wmo")) / 3,
    }).drop("_wm", "_ws", "_fm", "_am", "_wmo")


def positional_momentum(df: DataFrame, value: str = "close", places: Sequence[int] = (5, 24, 10), s: Series = BARS) -> DataFrame:
    """Value over the value at the n-th place from the end, minus 1; 0 while the series is short."""
    x = F.col(value)
    cols = {f"pos_momentum_{n}": lambda w, n=n: F.coalesce(ratio(x, F.lag(x, n - 1).over(w)) - 1, F.lit(0.0)) for n in places}
    return _windowed(df, s, cols, max(places))


def market_beta(df: DataFrame, ret: str = "ret", n: int = 30, s: Series = BARS) -> DataFrame:
    """Covariance with the mean return of all symbols over the last n rows, over its population variance."""
    ts = s.order[0]
    market = df.groupBy(ts).agg(F.avg(ret).alias("market"))
    joined = df.join(market, ts).filter(F.col(ret).isNotNull())

    def build(d: DataFrame, w) -> DataFrame:
        f = rows_before(w, n)
        beta = ratio(F.covar_samp(ret, "market").over(f), F.var_pop("market").over(f))
        return d.withColumn("beta", F.when(F.count(ret).over(f) >= n, F.coalesce(beta, F.lit(1.0))).otherwise(1.0))

    return over_rows(joined, s, build, n - 1)


def support_resistance(df: DataFrame, value: str = "close", n: int = 50, distance: int = 5, s: Series = BARS) -> DataFrame:
    """Relative distance to the nearest local minimum below and maximum above, over the last n rows."""
    import pandas as pd

    from tidemark.functions.peaks import levels_around

    x = F.col(value)

    def nearest(lists: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([levels_around(v, n, distance) for v in lists], columns=["support", "resistance"])

    nearest.__annotations__ = {"lists": pd.Series, "return": pd.DataFrame}
    near = F.pandas_udf(nearest, "struct<support: double, resistance: double>")

    def build(d: DataFrame, w) -> DataFrame:
        return d.withColumn("_list", F.collect_list(x.cast("double")).over(rows_before(w, n)))

    out = over_rows(df, s, build, n - 1).withColumn("_near", near("_list"))
    return out.withColumns({"support": F.col("_near.support"), "resistance": F.col("_near.resistance")}).drop("_list", "_near")
