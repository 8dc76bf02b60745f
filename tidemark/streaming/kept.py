"""Keyed entries in state that leave it by event time.

A key's entries are one map in the state store: only entries that changed are written, and one timer at the time when
the oldest is over removes what is too old, also for keys that stay silent. A key whose entries are all gone has no
state left.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.states import seconds
from tidemark.streaming.timers import keyed_state


class Rule:
    """What a row does to the entries: ``entry`` gives the map key and values it sets (None removes), ``report`` the
    columns ``out`` of a row after that (None for no row). ``key_fields`` and ``value_fields`` are DDL."""

    key_fields: str
    value_fields: str
    needs: Sequence[str]
    out: str

    def entry(self, values: tuple) -> tuple[tuple, tuple | None]:
        raise NotImplementedError

    def report(self, entries: dict) -> tuple | None:
        raise NotImplementedError


class Latest(Rule):
    """The latest value of each named stream, when all are there."""

    key_fields, value_fields = "name string", "value double"

    def __init__(self, stream: str, value: str, names: Sequence[str]):
        self.names, self.needs = list(names), (stream, value)
        self.out = ", ".join(f"{n} double" for n in names)

    def entry(self, values):
        return (values[0],), (float(values[1]),)

    def report(self, entries):
        found = [entries.get((n,)) for n in self.names]
        return tuple(f[1] for f in found) if all(f is not None for f in found) else None


class Book(Rule):
    """Levels of an order book and its touch; quantity 0 removes a level."""

    key_fields, value_fields = "side string, price double", "quantity double"
    needs, out = ("side", "price", "quantity"), "best_bid double, best_ask double, n_bids long, n_asks long"

    def __init__(self, depth: int = 20):
        self.depth = depth

    def entry(self, values):
        side, price, quantity = values
        return (side, float(price)), (float(quantity),) if quantity else None

    def report(self, entries):
        bids, asks = ([p for s, p in entries if s == side] for side in ("bid", "ask"))
        return max(bids, default=None), min(asks, default=None), min(self.depth, len(bids)), min(self.depth, len(asks))


class Kept(StatefulProcessor):
    """Applies a rule to each key's rows in time order and drops entries older than ``ttl_s``."""

    def __init__(self, rule: Rule, keys: Sequence[str], ttl_s: float, ts: str, tie: str):
        self.rule, self.keys, self.ttl, self.ts, self.tie = rule, list(keys), ttl_s, ts, tie

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.map = handle.getMapState("entries", self.rule.key_fields, f"t double, {self.rule.value_fields}")

    def _load(self) -> dict:
        """Entries, the oldest first."""
        found = [(tuple(k), tuple(v)) for k, v in self.map.iterator()] if self.map.exists() else []
        return dict(sorted(found, key=lambda x: x[1][0]))

    def _drop(self, entries: dict, now: float) -> None:
        for k in list(entries):
            if now - entries[k][0] <= self.ttl:
                break
            del entries[k]

    def _save(self, before: dict, entries: dict) -> None:
        for k in before.keys() - entries.keys():
            self.map.removeKey(k)
        for k, v in entries.items():
            if before.get(k) != v:
                self.map.updateValue(k, v)
        oldest = next(iter(entries.values()), None)
        due = None if oldest is None else math.floor((oldest[0] + self.ttl) * 1000) + 1
        old = list(self.handle.listTimers())
        for x in old:
            if x != due:
                self.handle.deleteTimer(x)
        if due is not None and due not in old:
            self.handle.registerTimer(due)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True).sort_values([self.ts, self.tie], kind="stable")
        entries = self._load()
        before, out = dict(entries), []
        for t, tie, *values in zip(seconds(frame[self.ts]).tolist(), frame[self.tie].tolist(), *(frame[c].tolist() for c in self.rule.needs)):
            name, value = self.rule.entry(tuple(values))
            entries.pop(name, None)
            if value is not None:
                entries[name] = (t, *value)
            self._drop(entries, t)
            said = self.rule.report(entries)
            if said is not None:
                out.append((*key, tie, *said))
        self._save(before, entries)
        if out:
            yield pd.DataFrame(out, columns=[*self.keys, self.tie, *[f.split()[0] for f in self.rule.out.split(", ")]])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        entries = self._load()
        before = dict(entries)
        self._drop(entries, timerValues.getCurrentWatermarkInMs() / 1000)
        self._save(before, entries)
        yield from ()


def kept_entries(stream: DataFrame, keys: Sequence[str], rule: Rule, ttl_s: float, ts: str = "ts", tie: str = "seq") -> DataFrame:
    """What ``rule`` reports after each row: keys, ``tie`` and its columns.

    ``stream`` needs a watermark on ``ts``; rows behind it are dropped, and micro-batches must follow each other in
    time. An entry is used while no older than ``ttl_s`` and leaves the state once the watermark has passed that.
    """
    keyed_state(stream.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"{tie} long", rule.out])
    return stream.groupBy(*keys).transformWithStateInPandas(Kept(rule, keys, ttl_s, ts, tie), schema, "Append", "EventTime")
