"""Threshold rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidemark.functions.maths import clip, ratio


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ladder(x: Column | str, steps: list[tuple[float, object]], otherwise: object) -> Column:
    """The label of the highest step that ``x`` reaches; steps are listed from high to low."""
    out = None
    for bound, label in steps:
        out = F.when(_c(x) >= bound, F.lit(label)) if out is None else out.when(_c(x) >= bound, F.lit(label))
    return out.otherwise(F.lit(otherwise))


def severity(magnitude: Column | str, threshold: Column | float) -> Column:
    """low / medium / high / critical at 1, 1.5, 2 and 3 times the absolute threshold."""
    thr = F.abs(threshold) if isinstance(threshold, Column) else F.lit(abs(float(threshold)))
    m = F.abs(_c(magnitude))
    return (
        F.when(m >= thr * 3.0, "critical").when(m >= thr * 2.0, "high").when(m >= thr * 1.5, "medium").otherwise("low")
    )


def changepoint_level(p: Column | str) -> Column:
    return ladder(p, [(0.9, "very_high"), (0.7, "high"), (0.5, "medium")], "low")


def confidence_level(c: Column | str) -> Column:
    return ladder(c, [(0.9, "very_high"), (0.7, "high"), (0.5, "medium"), (0.3, "low")], "very_low")


def signal_strength(magnitude: Column | str, threshold: Column | str) -> Column:
    q = ratio(magnitude, threshold)
    return F.coalesce(ladder(q, [(2.0, "very_strong"), (1.5, "strong"), (1.2, "medium")], "weak"), F.lit("weak"))


# Base confidence by strength and weight by volatility regime.
STRENGTH_CONFIDENCE = {"weak": 0.3, "medium": 0.6, "strong": 0.8, "very_strong": 0.9}
REGIME_WEIGHT = {"normal": 0.8, "low": 0.9, "high": 0.6}


def lookup(key: Column | str, table: dict[str, float], default: float | None = None) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(_c(key) == k, F.lit(v)) if out is None else out.when(_c(key) == k, F.lit(v))
    return out.otherwise(F.lit(default).cast("double"))


def width_confidence(half_width: Column | str) -> Column:
    """A 95 % half-width mapped into 0..1."""
    return F.lit(1.0) / (F.lit(1.0) + _c(half_width))


def signal_confidence(strength: Column | str, hedge_confidence: Column | str, regime: Column | str) -> Column:
    base = lookup(strength, STRENGTH_CONFIDENCE)
    weight = lookup(regime, REGIME_WEIGHT)
    hedge = _c(hedge_confidence)
    parts = F.coalesce(F.when(hedge != 0, hedge), F.lit(0.0)) + F.coalesce(weight, F.lit(0.0))
    count = F.when(hedge.isNotNull() & (hedge != 0), 1).otherwise(0) + F.when(weight.isNotNull(), 1).otherwise(0)
    blended = F.when(count > 0, (base + ratio(parts, count)) / 2).otherwise(base)
    bounded = clip(blended, 0.0, 1.0)
    return (
        F.when(_c(regime) == "high", bounded * 0.8)
        .when(_c(regime) == "low", F.least(F.lit(1.0), bounded * 1.1))
        .otherwise(bounded)
    )


def confidence_filter(signal: Column | str, confidence: Column | str, minimum: float = 0.6) -> Column:
    return F.when(_c(confidence) < minimum, "hold").otherwise(_c(signal))


# Size multiplier by signal strength.
STRENGTH_SIZE = {"weak": 0.5, "medium": 0.75, "strong": 1.0, "very_strong": 1.25}


def order_size(
    balance: Column | str, confidence: Column | str, strength: Column | str, volatility: Column | str,
    stop_distance: Column | str, risk: float = 0.02, smallest: float = 10.0, largest: float = 1000.0,
) -> Column:
    vol, stop = _c(volatility), _c(stop_distance)
    size = _c(balance) * risk * _c(confidence) * lookup(strength, STRENGTH_SIZE, 0.75)
    by_vol = F.when(vol > 0.15, 0.7).when((vol < 0.05) & (vol != 0), 1.2).otherwise(1.0)
    by_stop = F.when(stop > 3.0, 0.8).when((stop > 0) & (stop < 1.5), 1.1).otherwise(1.0)
    return clip(size * by_vol * by_stop, smallest, largest)


def pair_legs(notional: Column | str, price1: Column | str, price2: Column | str, hedge: Column | str, direction: Column | str) -> Column:
    """Quantities and sides of both legs; a long spread buys the first leg and sells the second."""
    long = _c(direction) == "long"
    return F.struct(
        ratio(notional, price1).alias("quantity1"),
        ratio(_c(notional) * _c(hedge), price2).alias("quantity2"),
        F.when(long, "buy").otherwise("sell").alias("side1"),
        F.when(long, "sell").otherwise("buy").alias("side2"),
    )


LABEL_SCORES = {"very_bullish": 1.0, "bullish": 0.5, "neutral": 0.0, "bearish": -0.5, "very_bearish": -1.0}


def five_way(x: Column | str, inner: float, outer: float) -> Column:
    """Bullish / bearish label by how far ``x`` lies beyond ±inner and ±outer; neutral when null."""
    x = _c(x)
    return (
        F.when(x > outer, "very_bullish").when(x > inner, "bullish")
        .when(x < -outer, "very_bearish").when(x < -inner, "bearish").otherwise("neutral")
    )


def label_score(label: Column | str) -> Column:
    return lookup(label, LABEL_SCORES, 0.0)


def network_sentiment(score: Column | str) -> Column:
    s = _c(score)
    return F.when(s.isNull() | ((s > 0.6) & (s <= 0.8)), "neutral").when(s > 0.8, "bullish").otherwise("bearish")


def recommended_action(score: Column | str, label: Column | str) -> Column:
    s, strong = _c(label), F.abs(_c(score)) > 0.8
    return (
        F.when(s.isin("bullish", "very_bullish") & strong, "STRONG_BUY").when(s.isin("bullish", "very_bullish"), "BUY")
        .when(s.isin("bearish", "very_bearish") & strong, "STRONG_SELL").when(s.isin("bearish", "very_bearish"), "SELL")
        .otherwise("HOLD")
    )


def contributing_metrics(bullish: Column | str, bearish: Column | str, flow_momentum: Column | str, whale_mean: Column | str) -> Column:
    """Names of the metrics behind a signal, at most five."""
    def on(cond: Column, name: str) -> Column:
        return F.when(cond, F.lit(name))

    names = F.array(
        on(_c(bullish) > 0.5, "exchange_outflow"), on(_c(bullish) > 0.5, "whale_transactions"),
        on(_c(bearish) > 0.5, "exchange_inflow"), on(F.abs(_c(flow_momentum)) > 0.1, "exchange_net_flow"),
        on(_c(whale_mean) > 0, "whale_transactions"),
    )
    return F.slice(F.array_compact(names), 1, 5)


def regime_from_state(ret: Column | str, volatility: Column | str) -> Column:
    x, wild = _c(ret), _c(volatility) > 0.5
    return (
        F.when(wild & (x > 0.02), "high_vol_bull").when(wild & (x < -0.02), "high_vol_bear").when(wild, "high_vol_range")
        .when(x > 0.02, "low_vol_bull").when(x < -0.02, "low_vol_bear")
        .when(F.abs(x) < 0.005, "stable_range").otherwise("low_vol_range")
    )


# Regime families and risk levels.
HIGH_VOLATILITY = ("high_vol_bull", "high_vol_bear", "high_vol_range", "crisis")
TRENDING = ("low_vol_bull", "low_vol_bear", "high_vol_bull", "high_vol_bear", "trending_up", "trending_down")
HIGH_RISK = ("high_vol_bear", "high_vol_range", "crisis", "recovery")
REGIME_RISK = {
    "low_vol_bull": "low", "low_vol_bear": "low", "low_vol_range": "very_low", "high_vol_bull": "medium",
    "high_vol_bear": "medium", "high_vol_range": "medium", "stable_range": "very_low", "trending_up": "low",
    "trending_down": "low", "crisis": "very_high", "recovery": "high", "unknown": "medium",
}


def is_high_volatility(regime: Column | str) -> Column:
    return _c(regime).isin(*HIGH_VOLATILITY)


def is_trending(regime: Column | str) -> Column:
    return _c(regime).isin(*TRENDING)


def risk_level(regime: Column | str) -> Column:
    out = None
    for k, v in REGIME_RISK.items():
        out = F.when(_c(regime) == k, v) if out is None else out.when(_c(regime) == k, v)
    return out.otherwise("medium")


def regime_alerts(regime: Column | str, previous: Column | str, confidence: Column | str) -> Column:
    """Array of alerts of one classification: change, high volatility, crisis, low confidence, emergency."""
    reg, prev, conf = _c(regime), _c(previous), _c(confidence)

    def alert(kind: str, when: Column, sev: Column | str) -> Column:
        level = sev if isinstance(sev, Column) else F.lit(sev)
        return F.when(when, F.struct(F.lit(kind).alias("alert_type"), level.alias("severity")))

    crisis = reg == "crisis"
    return F.array_compact(F.array(
        alert("regime_change", (reg != prev) & (prev != "unknown"), F.when(conf > 0.7, "medium").otherwise("low")),
        alert("high_volatility", is_high_volatility(reg), F.when(crisis, "high").otherwise("medium")),
        alert("crisis_detected", crisis, "critical"),
        alert("low_confidence", conf < 0.5, "medium"),
        alert("emergency_regime", crisis, "critical"),
    ))


def position_scaling(regime: Column | str, confidence: Column | str, halted: Column | bool = False) -> Column:
    reg, conf = _c(regime), _c(confidence)
    halt = halted if isinstance(halted, Column) else F.lit(bool(halted))
    base = F.when(reg == "crisis", 0.1).when(reg.isin(*HIGH_RISK), 0.5).when(reg == "stable_range", 1.2).otherwise(1.0)
    scaled = base * F.when(conf < 0.5, 0.7).when(conf > 0.8, 1.1).otherwise(1.0)
    return clip(F.when(halt, F.least(scaled, F.lit(0.1))).otherwise(scaled), 0.05, 2.0)


def allow_position(size: Column | str, scaling: Column | str, regime: Column | str, confidence: Column | str, halted: Column) -> Column:
    adjusted = _c(size) * _c(scaling)
    risky = _c(regime).isin(*HIGH_RISK) & (_c(confidence) < 0.6)
    reason = (
        F.when(halted, "emergency_halt").when(adjusted < 0.01, "too_small").when(_c(regime) == "crisis", "crisis")
        .when(risky, "low_confidence").otherwise("scaled")
    )
    ok = reason == "scaled"
    return F.struct(ok.alias("allowed"), F.when(ok, adjusted).otherwise(0.0).alias("adjusted_size"), reason.alias("reason"))
