"""State machines over streams whose deadlines fire by event time, without a further row.

A machine says, for a state, when it would move on its own. Rows of a key are taken in time order; a deadline before
the next row is passed first, and one that no row reaches in time is passed by an event-time timer as soon as the
watermark shows that no earlier row can come. Either way the move is reported at the deadline, so results depend
neither on micro-batches nor on how long a key stays silent.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators import states as ST

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> None:
    """Lists, maps and timers in state need the store that keeps them outside the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class Machine:
    """What a key does: ``fields`` is the DDL of its state, ``listed`` the DDL type of a list beside it (or None).

    A state is a tuple of the fields, with the list as a tuple at the end; ``None`` at the start. Times are seconds.
    ``row`` returns the new state and the columns ``out`` of the row (None for no row); ``deadline`` the time at
    which the state moves by itself (None for never), and ``expire`` that move.
    """

    fields: str
    listed: str | None = None
    needs: Sequence[str] = ()
    out: str

    def row(self, state: tuple | None, t: float, values: tuple) -> tuple[tuple, tuple | None]:
        raise NotImplementedError

    def deadline(self, state: tuple) -> float | None:
        raise NotImplementedError

    def expire(self, state: tuple, at: float) -> tuple[tuple | None, tuple | None]:
        raise NotImplementedError


class Lifecycle(Machine):
    """Trade states with timeouts of entries, exits and held positions."""

    fields, needs, out = "mode string, since double, entered double", ("trigger",), ST.LIFECYCLE_SCHEMA

    def __init__(self, entry_s: float = 300.0, exit_s: float = 300.0, hold_s: float = 86_400.0):
        self.wait = {"ENTERING": entry_s, "EXITING": exit_s, "IN_POSITION": hold_s}

    def row(self, state, t, values):
        state, moved = ST.lifecycle_row(state or ("SEARCHING", None, None), t, values[0])
        return state, (state[0], values[0] if moved else None)

    def deadline(self, state):
        mode, since, entered = state
        return None if mode not in self.wait else (entered if mode == "IN_POSITION" else since) + self.wait[mode]

    def expire(self, state, at):
        mode, _, entered = state
        name, target = ("position_timeout", "EXITING") if mode == "IN_POSITION" else ("entry_timeout" if mode == "ENTERING" else "exit_timeout", "ERROR")
        return (target, at, entered), (target, name)


class Breaker(Machine):
    """The circuit breaker; a halt ends after its longest time even if nothing arrives."""

    fields, listed = "mode string, since double, warnings int, highs int, recovering double", "p double"
    needs, out = ("probability", "recent_std"), ST.BREAKER_SCHEMA

    def __init__(self, conf: dict = ST.BREAKER):
        self.conf = conf

    def row(self, state, t, values):
        return ST.breaker_row(state, t, *values, self.conf)

    def deadline(self, state):
        return state[1] + self.conf["max_halt"] if state[0] == "HALT" else None

    def expire(self, state, at):
        _, since, warnings, highs, _, _ = state
        return ("RECOVERY", since, warnings, highs, at, ()), ("RECOVERY", "forced_release", None)


class Snapshots(Machine):
    """A snapshot at once when none was made for ``every`` seconds, else of the newest row when that time is over."""

    fields, needs, out = "made double, seq long, value double", ("seq", "value"), "snapshot_seq long, value double"

    def __init__(self, every: float = 300.0):
        self.every = every

    def row(self, state, t, values):
        seq, value = int(values[0]), float(values[1])
        if state is None or t >= state[0] + self.every:
            return (t, None, None), (seq, value)
        return (state[0], seq, value), None

    def deadline(self, state):
        return None if state[1] is None else state[0] + self.every

    def expire(self, state, at):
        return (at, None, None), (state[1], state[2])


class Timed(StatefulProcessor):
    """Runs a machine for every key, with its state in a value (and a list) and one timer at its deadline."""

    def __init__(self, machine: Machine, keys: Sequence[str], ts: str, tie: str):
        self.machine, self.keys, self.ts, self.tie = machine, list(keys), ts, tie

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("state", self.machine.fields)
        self.list = handle.getListState("list", self.machine.listed) if self.machine.listed else None

    def _load(self) -> tuple | None:
        if not self.value.exists():
            return None
        state = tuple(self.value.get())
        if self.list is not None:
            state = (*state, tuple(x[0] for x in self.list.get()) if self.list.exists() else ())
        return state

    def _save(self, before: tuple | None, state: tuple | None) -> None:
        if state == before:
            return
        plain = state
        if self.list is not None:
            *plain, listed = state
            if before is None or listed != before[-1]:
                self.list.put([(x,) for x in listed]) if listed else self.list.clear()
        self.value.update(tuple(plain))
        due = self.machine.deadline(state)
        timer = None if due is None else math.ceil(due * 1000)
        old = list(self.handle.listTimers())
        for x in old:
            if x != timer:
                self.handle.deleteTimer(x)
        if timer is not None and timer not in old:
            self.handle.registerTimer(timer)

    def _passed(self, state: tuple | None, until: float, inclusive: bool, out: list) -> tuple | None:
        while state is not None:
            due = self.machine.deadline(state)
            if due is None or due > until or (due == until and not inclusive):
                break
            state, said = self.machine.expire(state, due)
            if said is not None:
                out.append((due, None, *said))
        return state

    def _frame(self, key: tuple, out: list) -> pd.DataFrame:
        names = [self.ts, self.tie, *[f.split()[0] for f in self.machine.out.split(", ")]]
        frame = pd.DataFrame(out, columns=names)
        frame[self.ts] = pd.to_datetime((frame[self.ts] * 1e6).round().astype("int64"), unit="us")
        frame[self.tie] = frame[self.tie].astype("Int64")
        for place, (name, value) in enumerate(zip(self.keys, key)):
            frame.insert(place, name, value)
        return frame

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True).sort_values([self.ts, self.tie], kind="stable")
        before = state = self._load()
        out: list = []
        for t, tie, *values in zip(ST.seconds(frame[self.ts]).tolist(), frame[self.tie].tolist(), *(frame[c].tolist() for c in self.machine.needs)):
            state = self._passed(state, t, False, out)
            state, said = self.machine.row(state, t, tuple(values))
            if said is not None:
                out.append((t, tie, *said))
        self._save(before, state)
        if out:
            yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        before = self._load()
        out: list = []
        state = self._passed(before, timerValues.getCurrentWatermarkInMs() / 1000, True, out)
        if state is not None:
            self._save(before, state)
        if out:
            yield self._frame(key, out)


def timed_fold(stream: DataFrame, keys: Sequence[str], machine: Machine, ts: str = "ts", tie: str = "seq") -> DataFrame:
    """Rows and deadlines of each key: keys, the time, ``tie`` of the row (null at a deadline), and the machine's columns.

    ``stream`` needs a watermark on ``ts``; rows behind it are dropped, and micro-batches must follow each other in
    time, up to its delay.
    """
    keyed_state(stream.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"{ts} timestamp", f"{tie} long", machine.out])
    return stream.groupBy(*keys).transformWithStateInPandas(Timed(machine, keys, ts, tie), schema, "Append", "EventTime")
