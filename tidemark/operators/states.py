"""Step functions of the recursive operators: small state machines and filters over one key's rows.

Each factory returns ``step(rows, state) -> (out, state)``. The same step runs over batch blocks
(``tidemark.plans.folds``) and in streams (``tidemark.streaming.stateful``).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd

from tidemark.operators.bocd import BOCD_SCHEMA, bocd_step  # noqa: F401

KALMAN_SCHEMA = "hedge_ratio double, velocity double, variance double, half_width double, innovation double, innovation_variance double, log_likelihood double"


def seconds(ts: pd.Series) -> np.ndarray:
    return ts.to_numpy("datetime64[us]").astype(np.int64) / 1e6


def kalman_step(value: str, keep: list[str], ratio: float = 1.0, q: float = 1e-5, r: float = 1e-3, p0: float = 1.0):
    """Two-state (level, velocity) filter of a price ratio with Joseph covariance. The covariance path does
    not depend on the data, so the state forgets its start quickly."""

    def step(rows: pd.DataFrame, state):
        m, v, p11, p12, p22 = state or (ratio, 0.0, p0, 0.0, p0)
        out = np.empty((len(rows), 7))
        for i, z in enumerate(rows[value].to_numpy(float)):
            m += v
            a = p11 + 2 * p12 + p22 + q
            b = p12 + p22
            c = p22 + 0.1 * q
            s = a + r
            k1, k2 = a / s, b / s
            e = z - m
            m, v = m + k1 * e, v + k2 * e
            g = 1 - k1
            p11 = g * g * a + k1 * k1 * r
            p12 = g * (b - k2 * a) + k1 * k2 * r
            p22 = c - 2 * k2 * b + k2 * k2 * a + k2 * k2 * r
            out[i] = (m, v, p11, 1.96 * math.sqrt(p11), e, s, -0.5 * (math.log(2 * math.pi) + math.log(s) + e * e / s))
        names = [c.split()[0] for c in KALMAN_SCHEMA.split(", ")]
        return pd.concat([rows[keep].reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1), (m, v, p11, p12, p22)

    return step


BREAKER_SCHEMA = "state string, event string, severity string"
# Thresholds, counts and durations (seconds) of the circuit breaker.
BREAKER = {"warning": 0.5, "halt": 0.7, "critical": 0.9, "warnings": 3, "high_events": 2, "min_halt": 300.0, "max_halt": 7200.0,
           "recovery": 0.2, "stability": 300.0}


def breaker_row(state: tuple | None, t: float, p: float, std: float, conf: dict = BREAKER) -> tuple[tuple, tuple]:
    """The breaker's state after one change-point event, and (state, event, severity) of it."""
    mode, since, warnings, highs, recovering, seen = state or ("NORMAL", None, 0, 0, None, ())
    scale = 0.8 if std > 2.0 else 1.2 if std < 0.5 else 1.0
    bounds = ((0.1, 0.9), (0.2, 0.95), (0.3, 1.0))
    warn, halt, critical = (min(hi, max(lo, conf[k] * scale)) for k, (lo, hi) in zip(("warning", "halt", "critical"), bounds))
    event = severity = None
    if mode in ("NORMAL", "WARNING"):
        was_warning = mode == "WARNING"
        if p >= critical:
            event, severity = "halt", "CRITICAL"
        elif p >= halt:
            highs += 1
            mode = "WARNING"
            if highs >= conf["high_events"]:
                event, severity = "halt", "HIGH"
        elif p >= warn:
            mode = "WARNING"
            warnings += was_warning
            if warnings >= conf["warnings"]:
                event, severity = "halt", "MEDIUM"
        else:
            mode, warnings, highs = "NORMAL", 0, 0
    elif mode == "HALT":
        held = t - since
        if (held >= conf["min_halt"] and p <= conf["recovery"]) or held >= conf["max_halt"]:
            mode, recovering, seen = "RECOVERY", t, ()
    else:
        seen = (*seen, p)
        age = t - recovering
        if age > conf["stability"]:
            seen = seen[-int(len(seen) * conf["stability"] / age):]
        if len(seen) >= 3:
            top, mean = max(seen[-5:]), sum(seen[-10:]) / min(10, len(seen))
            if top <= conf["recovery"] and mean <= 1.5 * conf["recovery"]:
                event, mode = "recovery", "NORMAL"
                since, recovering, seen, warnings, highs = None, None, (), 0, 0
            elif top > halt:
                event, severity = "halt", "RECOVERY_FAILED"
    if event == "halt":
        mode, since, warnings, highs = "HALT", t, 0, 0
    return (mode, since, warnings, highs, recovering, seen), (mode, event, severity)


def breaker_step(keep: list[str], probability: str = "probability", spread_std: str = "recent_std", ts: str = "ts", conf: dict = BREAKER):
    """NORMAL / WARNING / HALT / RECOVERY over change-point events, with halt and recovery events."""

    def step(rows: pd.DataFrame, state):
        result = []
        for t, p, std in zip(seconds(rows[ts]), rows[probability].to_numpy(float), rows[spread_std].to_numpy(float)):
            state, said = breaker_row(state, t, p, std, conf)
            result.append(said)
        out = pd.concat([rows[keep].reset_index(drop=True), pd.DataFrame(result, columns=["state", "event", "severity"])], axis=1)
        return out, state

    return step


LIFECYCLE_SCHEMA = "state string, transition string"
# Trigger -> (states it applies to, next state).
LIFECYCLE = {
    "entry_signal": (("SEARCHING",), "ENTERING"), "position_entered": (("ENTERING",), "IN_POSITION"), "entry_failed": (("ENTERING",), "SEARCHING"),
    "exit_signal": (("IN_POSITION",), "EXITING"), "stop_loss": (("IN_POSITION",), "EXITING"), "position_exited": (("EXITING",), "SEARCHING"),
    "exit_failed": (("EXITING",), "ERROR"), "reset": (("ERROR",), "SEARCHING"), "pause": (("SEARCHING", "ERROR"), "PAUSED"),
    "resume": (("PAUSED",), "SEARCHING"), "error": (("SEARCHING", "ENTERING", "IN_POSITION", "EXITING", "PAUSED", "ERROR"), "ERROR"),
}


def lifecycle_row(state: tuple, t: float, trigger: str) -> tuple[tuple, bool]:
    """The state after a trigger, and whether its state allowed it."""
    mode, since, entered = state
    allowed, target = LIFECYCLE.get(trigger, ((), None))
    if mode not in allowed:
        return state, False
    return (target, t, t if trigger == "position_entered" else entered), True


def lifecycle_step(keep: list[str], trigger: str = "trigger", ts: str = "ts", entry_s: float = 300.0, exit_s: float = 300.0, hold_s: float = 86_400.0):
    """Trade states per pair: timeouts are applied first, then the row's trigger where its state allows it."""

    def step(rows: pd.DataFrame, state):
        mode, since, entered = state or ("SEARCHING", None, None)
        result = []
        for t, name in zip(seconds(rows[ts]), rows[trigger]):
            moves = []
            if mode in ("ENTERING", "EXITING") and t - since > (entry_s if mode == "ENTERING" else exit_s):
                moves.append((f"{'entry' if mode == 'ENTERING' else 'exit'}_timeout", "ERROR"))
            elif mode == "IN_POSITION" and t - entered > hold_s:
                moves.append(("position_timeout", "EXITING"))
            if moves:
                mode, since = moves[-1][1], t
            (mode, since, entered), moved = lifecycle_row((mode, since, entered), t, name)
            moves += [(name, mode)] if moved else []
            result.append((mode, ",".join(m for m, _ in moves) or None))
        out = pd.concat([rows[keep].reset_index(drop=True), pd.DataFrame(result, columns=["state", "transition"])], axis=1)
        return out, (mode, since, entered)

    return step


SIGNAL_SCHEMA = "signal string, strength double, side string"


def threshold_signal_step(keep: list[str]):
    """Entry, exit and stop signals from z_score, entry, exit and stop columns, with the side they leave."""

    def step(rows: pd.DataFrame, state):
        side = state
        result = []
        for z, entry, leave, stop in zip(*(rows[c].to_numpy(float) for c in ("z_score", "entry", "exit", "stop"))):
            signal, strength = "hold", 0.0
            if side is None:
                if z <= -entry or z >= entry:
                    side = "long" if z <= -entry else "short"
                    signal, strength = f"entry_{side}", min(1.0, abs(z / entry))
            else:
                toward = z if side == "long" else -z  # distance back from the entered side
                if toward >= -leave or toward <= -stop:
                    strength = 1.0 if toward <= -stop else min(1.0, abs(z / leave))
                    signal, side = "exit", None
            result.append((signal, strength, side))
        out = pd.concat([rows[keep].reset_index(drop=True), pd.DataFrame(result, columns=["signal", "strength", "side"])], axis=1)
        return out, side

    return step


SPREAD_SIGNAL_SCHEMA = "signal string, side string, price1 double, price2 double, threshold double"


def spread_signal_step(keep: list[str], stop: float = 4.0):
    """Entries beyond the thresholds at the touch prices, exits inside the exit band, stops beyond ±stop.
    Needs z_score, entry_long, entry_short, exit, bid1, ask1, bid2, ask2; null z holds."""

    def step(rows: pd.DataFrame, state):
        side = state
        result = []
        cols = [rows[c].to_numpy(float) for c in ("z_score", "entry_long", "entry_short", "exit", "bid1", "ask1", "bid2", "ask2")]
        for z, low, high, band, bid1, ask1, bid2, ask2 in zip(*cols):
            signal, p1, p2, level = "hold", None, None, None
            if math.isnan(z):
                pass
            elif side is None:
                if z <= low:
                    signal, side, p1, p2, level = "entry_long", "long", ask1, bid2, abs(low)
                elif z >= high:
                    signal, side, p1, p2, level = "entry_short", "short", bid1, ask2, abs(high)
            else:
                if abs(z) <= band:
                    signal, side, level = "exit", None, band
                elif (z < -stop) if side == "long" else (z > stop):
                    signal, side, level = "stop_loss", None, band
            result.append((signal, side, p1, p2, level))
        out = pd.concat([rows[keep].reset_index(drop=True), pd.DataFrame(result, columns=["signal", "side", "price1", "price2", "threshold"])], axis=1)
        return out, side

    return step


SMOOTH_SCHEMA = "smoothed string, smoothed_confidence double, from_regime string, seconds_in_regime double"


def smoothing_step(keep: list[str], persistence: int = 3, least: float = 0.3, regime: str = "regime", confidence: str = "confidence", ts: str = "ts"):
    """Keep the regime until a new one was seen ``persistence`` times with enough confidence."""

    def step(rows: pd.DataFrame, state):
        current, start, counts = state or ("unknown", None, ())
        counts = dict(counts)
        result = []
        for t, seen, c in zip(seconds(rows[ts]), rows[regime], rows[confidence].to_numpy(float)):
            start = t if start is None else start
            target, conf = current, c
            if c < least:
                conf = c * 0.8
            elif seen != current:
                counts[seen] = counts.get(seen, 0) + 1
                if counts[seen] >= persistence:
                    target, counts = seen, {}
                else:
                    conf = c * 0.9
            else:
                counts = {}
            left = current if target != current else None
            spent = t - start
            if left is not None:
                current, start = target, t
            result.append((current, conf, left, spent))
        out = pd.concat([rows[keep].reset_index(drop=True), pd.DataFrame(result, columns=["smoothed", "smoothed_confidence", "from_regime", "seconds_in_regime"])], axis=1)
        return out, (current, start, tuple(sorted(counts.items())))

    return step


LEARN_SCHEMA = "position_factor double, kelly_factor double, entry_factor double, exit_factor double"


def learning_step(keep: list[str]):
    """Multiplicative parameter factors per regime from Sharpe, win rate and drawdown of each period."""

    def step(rows: pd.DataFrame, state):
        pos, kelly, entry, leave = state or (1.0, 1.0, 1.0, 1.0)
        result = []
        for sharpe, wins, dd in zip(*(rows[c].to_numpy(float) for c in ("sharpe", "win_rate", "max_drawdown"))):
            if sharpe > 1.5:
                pos, kelly = min(1.2, pos * 1.02), min(1.2, kelly * 1.01)
            elif sharpe < 0.5:
                pos, entry = max(0.5, pos * 0.98), min(1.5, entry * 1.01)
            if wins > 0.6:
                leave = max(0.7, leave * 0.99)
            elif wins < 0.4:
                leave = min(1.3, leave * 1.01)
            if dd > 0.1:
                pos, kelly = max(0.3, pos * 0.95), max(0.3, kelly * 0.95)
            result.append((pos, kelly, entry, leave))
        names = ["position_factor", "kelly_factor", "entry_factor", "exit_factor"]
        return pd.concat([rows[keep].reset_index(drop=True), pd.DataFrame(result, columns=names)], axis=1), (pos, kelly, entry, leave)

    return step


GATE_SCHEMA = "result string, approved double, reason string"


def risk_gate_step(keep: list[str], capital: float = 100_000.0, position_pct: float = 0.1, concentration: float = 0.2, margin: float = 0.1,
                   buffer: float = 1000.0, daily_loss: float = 0.05, drawdown: float = 0.15, kelly_share: float = 0.25, ts: str = "ts"):
    """Orders of one account in time order: halts first, then size, concentration and capital. Approved
    quantities fill at the order price; a daily-loss halt lifts on the next day if the limits allow. A positive
    ``kelly`` of a row (fraction from enough closed trades) also bounds the position by ``kelly_share`` of it."""

    def step(rows: pd.DataFrame, state):
        cash, held, last, peak, day, day_start, halted = state or (capital, (), (), capital, None, capital, None)
        held, last = dict(held), dict(last)
        result = []
        kelly = rows["kelly"].to_numpy(float) if "kelly" in rows else np.zeros(len(rows))
        for t, symbol, q, px, fraction in zip(seconds(rows[ts]), rows["symbol"], rows["quantity"].to_numpy(float), rows["price"].to_numpy(float), kelly):
            if px > 0:
                last[symbol] = px
            value = cash + sum(n * last[k] for k, n in held.items())
            peak = max(peak, value)
            today = int(t // 86_400)
            loss = lambda: (day_start - value) / day_start if day_start > 0 else 0.0
            fall = (peak - value) / peak if peak > 0 else 0.0
            if day is None or today > day:
                day, day_start = today, value
                if halted == "daily_loss" and fall <= drawdown:
                    halted = None
            ok, approved, reason = "approved", q, None
            if halted:
                ok, approved, reason = "halted", 0.0, "trading_halted"
            elif abs(q) < 1e-8 or px <= 0:
                ok, approved, reason = "rejected", 0.0, "invalid_order"
            elif loss() > daily_loss:
                halted, ok, approved, reason = "daily_loss", "halted", 0.0, "daily_loss_limit"
            elif fall > drawdown:
                halted, ok, approved, reason = "drawdown", "halted", 0.0, "max_drawdown"
            else:
                pos, cap = held.get(symbol, 0.0), value * (min(position_pct, fraction * kelly_share) if fraction > 0 else position_pct)
                if abs((pos + q) * px) > cap:
                    room = (cap - abs(pos * px)) / px
                    approved = 0.0 if room <= 0 else min(q, room) if q > 0 else max(q, -room)
                if value <= 0:
                    ok, approved, reason = "rejected", 0.0, "insufficient_capital"
                elif abs(approved) < 1e-8:
                    ok, approved, reason = "rejected", 0.0, "position_size_exceeded"
                elif abs((pos + approved) * px) / value > concentration:
                    ok, approved, reason = "rejected", 0.0, "concentration_risk"
                elif value < abs(approved * px) * margin + buffer:
                    ok, approved, reason = "rejected", 0.0, "insufficient_capital"
                elif approved != q:
                    ok = "modified"
            if approved:
                cash -= approved * px
                held[symbol] = held.get(symbol, 0.0) + approved
            result.append((ok, approved, reason))
        out = pd.concat([rows[keep].reset_index(drop=True), pd.DataFrame(result, columns=["result", "approved", "reason"])], axis=1)
        return out, (cash, tuple(sorted(held.items())), tuple(sorted(last.items())), peak, day, day_start, halted)

    return step
