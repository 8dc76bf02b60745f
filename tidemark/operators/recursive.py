"""Recursive operators as DataFrame functions: exponential averages, filters, detectors, signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.maths import ratio
from tidemark.operators import states as S
from tidemark.operators.bocd import LANES
from tidemark.operators.rolling import true_range
from tidemark.plans.filters import kalman_scan
from tidemark.plans.folds import fold
from tidemark.plans.scans import affine_scans
from tidemark.plans.series import BARS, TICKS, Series, by_key_size, over_rows, rows_before, with_position


# a step of the detector works on some hundred run lengths: a block has this many rows for each of the stretches that advance
# side by side, and so many rows ahead of it are mostly enough to forget what came before them
BOCD_ROWS = 8_192
BOCD_WARM = 3_000


def _ddl(df: DataFrame, keep: list[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return ", ".join(f"`{c}` {kinds[c]}" for c in keep)


def _run(df: DataFrame, s: Series, keep: list[str], step, schema: str, needs: list[str], rows: int | None = None, warm: int = 0) -> DataFrame:
    """Fold over only the columns the step reads, in blocks of ``rows`` rows at most where given, started ``warm`` rows ahead."""
    columns = list(dict.fromkeys([*s.keys, *s.order, *keep, *needs]))
    return by_key_size(df.select(*columns), s, lambda d, own: fold(d, own, step, f"{_ddl(df, keep)}, {schema}", rows, warm))


def ewm(df: DataFrame, value: str, out: str, span: float | None = None, alpha: float | None = None, adjust: bool = True, s: Series = TICKS) -> DataFrame:
    """Exponential moving average by span or alpha. ``adjust`` divides a linear recursion by the finite sum of
    weights, which depends on the position alone; without it the first value starts the average. No null values."""
    a = alpha if alpha is not None else 2.0 / (span + 1.0)
    return by_key_size(df, s, lambda d, own: _ewms(with_position(d, own, "_p"), {out: (value, a)}, adjust, own).drop("_p"))


def _ewms(d: DataFrame, averages: dict[str, tuple[str, float]], adjust: bool, s: Series) -> DataFrame:
    """Averages ``out: (value, alpha)`` of rows with their position in ``_p``, in one pass."""
    first, made = F.col("_p") == 1, {}
    for out, (value, a) in averages.items():
        x = F.col(value).cast("double")
        made[f"_m_{out}"] = F.lit(1.0 - a) if adjust else F.when(first, 0.0).otherwise(1.0 - a)
        made[f"_x_{out}"] = x if adjust else F.when(first, x).otherwise(x * a)
    d = affine_scans(d.withColumns(made), s, {out: (f"_m_{out}", f"_x_{out}") for out in averages}).drop(*made)
    if not adjust:
        return d
    return d.withColumns({out: F.col(out) / ((1 - F.pow(F.lit(1.0 - a), F.col("_p"))) / a) for out, (_, a) in averages.items()})


def _wilders(df: DataFrame, averages: dict[str, str], n: int, s: Series) -> DataFrame:
    """Wilder's averages ``out: value`` in one pass: the plain mean of the first n values, then
    (previous * (n-1) + value) / n. Null until n values; a leading null is the missing first difference."""
    d = over_rows(df, s, lambda x, w: x.withColumns({f"_seed_{out}": F.avg(v).over(rows_before(w, n)) for out, v in averages.items()}), n)
    d = with_position(d, s, "_p")
    early, made = F.col("_p") <= n + 1, {"_m": F.when(F.col("_p") <= n + 1, 0.0).otherwise((n - 1.0) / n)}
    for out, value in averages.items():
        made[f"_b_{out}"] = F.when(early, F.coalesce(f"_seed_{out}", F.lit(0.0))).otherwise(F.col(value) / n)
    d = affine_scans(d.withColumns(made).drop(*[f"_seed_{out}" for out in averages]), s, {out: ("_m", f"_b_{out}") for out in averages})
    return d.withColumns({out: F.when(F.col("_p") > n, F.col(out)) for out in averages}).drop("_p", *made)


def rsi_wilder(df: DataFrame, value: str, n: int = 14, s: Series = TICKS) -> DataFrame:
    """RSI from Wilder averages of gains and losses; 50 until there are n differences, 100 without losses."""
    return by_key_size(df, s, lambda d, own: _rsi_wilder(d, value, n, own))


def _rsi_wilder(df: DataFrame, value: str, n: int, s: Series) -> DataFrame:
    x = F.col(value)
    d = over_rows(df, s, lambda t, w: t.withColumn("_d", x - F.lag(x, 1).over(w)), 1)
    zero = F.lit(0.0)
    d = d.withColumns({"_up": F.when(F.col("_d").isNotNull(), F.greatest("_d", zero)), "_dn": F.when(F.col("_d").isNotNull(), F.greatest(-F.col("_d"), zero))})
    d = _wilders(d.drop("_d"), {"_au": "_up", "_ad": "_dn"}, n, s)
    rsi = F.when(F.col("_au").isNull(), 50.0).when(F.col("_ad") == 0, 100.0).otherwise(100 - 100 / (1 + ratio("_au", "_ad")))
    return d.withColumn("rsi", rsi).drop("_up", "_dn", "_au", "_ad")


def macd(df: DataFrame, value: str, fast: int = 12, slow: int = 26, signal: int = 9, adjust: bool = True, s: Series = TICKS) -> DataFrame:
    """Line, signal and histogram from exponential averages (weights adjusted as stated)."""
    return by_key_size(df, s, lambda d, own: _macd(d, value, fast, slow, signal, adjust, own))


def _macd(df: DataFrame, value: str, fast: int, slow: int, signal: int, adjust: bool, s: Series) -> DataFrame:
    a = lambda span: 2.0 / (span + 1.0)
    d = _ewms(with_position(df, s, "_p"), {"_f": (value, a(fast)), "_s": (value, a(slow))}, adjust, s)
    d = d.withColumn("macd", F.col("_f") - F.col("_s")).drop("_f", "_s")
    d = _ewms(d, {"macd_signal": ("macd", a(signal))}, adjust, s).drop("_p")
    return d.withColumn("macd_histogram", F.col("macd") - F.col("macd_signal"))


def atr_wilder(df: DataFrame, n: int = 14, s: Series = BARS) -> DataFrame:
    """Wilder average of the true range, 0 until there are n ranges."""
    def build(d: DataFrame, w) -> DataFrame:
        p = F.lag("close", 1).over(w)
        return d.withColumn("_tr", F.when(p.isNotNull(), true_range("high", "low", p)))

    d = _wilders(over_rows(df, s, build, 1), {"atr": "_tr"}, n, s)
    return d.withColumn("atr", F.coalesce("atr", F.lit(0.0))).drop("_tr")


def kalman_hedge_ratio(df: DataFrame, value: str, s: Series, keep: list[str], **params) -> DataFrame:
    """Level-and-velocity filter of a price ratio; long keys run as a parallel scan."""
    return kalman_scan(df, s, value, keep, **params)


def bocd(df: DataFrame, value: str, s: Series, keep: list[str], **params) -> DataFrame:
    return _run(df, s, keep, S.bocd_step(value, keep, **params), S.BOCD_SCHEMA, [value], BOCD_ROWS * LANES, BOCD_WARM)


def circuit_breaker(df: DataFrame, s: Series, keep: list[str], least: float = 0.1) -> DataFrame:
    """Breaker states over the change-point events (probability above ``least``)."""
    events = df.filter(F.col("probability") > least)
    return _run(events, s, keep, S.breaker_step(keep, ts=s.order[0]), S.BREAKER_SCHEMA, ["probability", "recent_std"])


def trade_lifecycle(df: DataFrame, s: Series, keep: list[str], **params) -> DataFrame:
    return _run(df, s, keep, S.lifecycle_step(keep, ts=s.order[0], **params), S.LIFECYCLE_SCHEMA, ["trigger"])


def threshold_signals(df: DataFrame, s: Series, keep: list[str]) -> DataFrame:
    return _run(df, s, keep, S.threshold_signal_step(keep), S.SIGNAL_SCHEMA, ["z_score", "entry", "exit", "stop"])


def spread_signals(df: DataFrame, s: Series, keep: list[str], stop: float = 4.0) -> DataFrame:
    """Spread signals with entry prices, strength and confidence."""
    from tidemark.functions.rules import signal_confidence, signal_strength

    needs = ["z_score", "entry_long", "entry_short", "exit", "bid1", "ask1", "bid2", "ask2", "hedge_confidence", "vol_regime"]
    kept = list(dict.fromkeys([*keep, "z_score", "hedge_confidence", "vol_regime"]))
    d = _run(df, s, kept, S.spread_signal_step(kept, stop), S.SPREAD_SIGNAL_SCHEMA, needs)
    live = F.col("signal") != "hold"
    d = d.withColumn("strength", F.when(live, signal_strength(F.abs("z_score"), F.col("threshold"))).otherwise("weak"))
    held = F.when(F.col("z_score").isNull(), 0.0).otherwise(0.5)
    return d.withColumn("confidence", F.when(live, signal_confidence("strength", "hedge_confidence", "vol_regime")).otherwise(held))


def regime_smoothing(df: DataFrame, s: Series, keep: list[str], **params) -> DataFrame:
    return _run(df, s, keep, S.smoothing_step(keep, ts=s.order[0], **params), S.SMOOTH_SCHEMA, ["regime", "confidence"])


def performance_learning(df: DataFrame, s: Series, keep: list[str]) -> DataFrame:
    return _run(df, s, keep, S.learning_step(keep), S.LEARN_SCHEMA, ["sharpe", "win_rate", "max_drawdown"])


def order_risk_gate(df: DataFrame, s: Series, keep: list[str], **params) -> DataFrame:
    """Decisions on orders; a column ``kelly``, where there is one, bounds position sizes too."""
    needs = ["symbol", "quantity", "price", *(["kelly"] if "kelly" in df.columns else [])]
    return _run(df, s, keep, S.risk_gate_step(keep, ts=s.order[0], **params), S.GATE_SCHEMA, needs)
