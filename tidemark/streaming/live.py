"""Live states of series whose rows come late and out of order: rows wait until the watermark has passed them, and are taken in order of time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


@dataclass(frozen=True)
class Machine:
    """What rows do to a state: ``step(state, row)`` gives the next state and the row's results, each a tuple of its columns.

    ``columns`` are read from a row, in this order; states and results have the types of ``state`` and ``results``. The state before the first row is None.
    """

    columns: tuple[str, ...]
    state: str
    results: str
    step: Callable[[tuple | None, tuple], tuple[tuple, tuple]]


class InOrder(StatefulProcessor):
    """Feeds a machine each series' rows in order of time.

    Rows wait in a list state. A timer at the earliest waiting row fires once the watermark is past
    it; then all rows up to the watermark are taken in order, and their results go out. A time
    that has been taken is not taken again, of several rows of a time the first to come counts, so
    that rows delivered twice change nothing. A series without rows for ``idle_ms`` of event time is forgotten.
    """

    def __init__(self, machine: Machine, waiting: StructType, state: StructType, names: list[str], idle_ms: int | None):
        self.machine, self.waiting_type, self.state_type, self.names, self.idle_ms = machine, waiting, state, names, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.waiting_type)
        self.state = handle.getValueState("state", self.state_type)
        self.last = handle.getValueState("last", "ms long")

    def _held(self) -> list[tuple]:
        return [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        taken = self.last.get()[0] if self.last.exists() else None
        new = [tuple(None if x is pd.NaT else x for x in r) for part in rows for r in part[["event_ms", *self.machine.columns]].astype(object).itertuples(index=False)]
        new = [(int(r[0]), *r[1:]) for r in new if taken is None or r[0] > taken]
        if new:
            self.waiting.appendList(new)
            for ms in {r[0] for r in new}:
                self.handle.registerTimer(ms)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = self._held()
        taken = self.last.get()[0] if self.last.exists() else None
        state = tuple(self.state.get()) if self.state.exists() else None
        due: dict[int, tuple] = {}
        for r in held:
            if r[0] <= now:
                due.setdefault(r[0], r[1:])
        out = []
        for ms in sorted(due):
            if taken is None or ms > taken:
                state, found = self.machine.step(state, due[ms])
                out.append((*key, *found))
                taken = ms
        if due:
            rest = [r for r in held if r[0] > now]
            self.waiting.clear()
            if rest:
                self.waiting.appendList(rest)
            self.last.update((taken,))
            if state is not None:
                self.state.update(state)
            if self.idle_ms is not None:
                self.handle.registerTimer(taken + self.idle_ms)
        elif self.idle_ms is not None and taken is not None and not held and now >= taken + self.idle_ms:
            self.state.clear()
            self.last.clear()
        yield pd.DataFrame(out, columns=self.names)


def in_order(rows: DataFrame, machine: Machine, late: str, idle_days: int | None = None) -> DataFrame:
    """(symbol, *results) of a stream ``rows(symbol, date, *machine.columns)``, each row's once the watermark ``late`` behind the latest date has passed it.

    Results equal those of a table in order, if no row comes later than ``late``; later ones
    are dropped by the watermark. Appends only.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    timed = rows.withColumn("event_time", F.col("date").cast("timestamp")).withWatermark("event_time", late).withColumn("event_ms", F.unix_millis("event_time"))
    picked = timed.select("symbol", "event_time", "event_ms", *machine.columns)
    kind = lambda described: StructType.fromDDL(described)
    waiting = StructType([f for f in picked.schema if f.name in ("event_ms", *machine.columns)])
    waiting = StructType([waiting["event_ms"], *[waiting[n] for n in machine.columns]])
    results = kind(f"symbol {rows.schema['symbol'].dataType.simpleString()}, {machine.results}")
    processor = InOrder(machine, waiting, kind(machine.state), results.names, None if idle_days is None else idle_days * DAY_MS)
    return picked.groupBy("symbol").transformWithStateInPandas(processor, results, "Append", "EventTime")


def online_swings(bars: DataFrame, k: float = 1.5, late: str = "3 days", idle_days: int | None = None) -> DataFrame:
    """(symbol, date, direction, confirmed, pivot, pivot_date): the zigzag of a stream ``bars(symbol, date, high, low, close, atr_pct)``."""
    from tidemark.operators.swings import Zigzag

    def step(state: tuple | None, bar: tuple) -> tuple[tuple, tuple]:
        leg = Zigzag(k)
        if state is not None:
            leg.direction, leg.pivot, leg.pivot_at, leg.extreme, leg.extreme_at = state
        done = leg.feed(*bar)
        return (leg.direction, leg.pivot, leg.pivot_at, leg.extreme, leg.extreme_at), (bar[0], leg.direction, done is not None, leg.pivot, leg.pivot_at)

    machine = Machine(("date", "high", "low", "close", "atr_pct"), "direction int, pivot double, pivot_at date, extreme double, extreme_at date", "date date, direction int, confirmed boolean, pivot double, pivot_date date", step)
    return in_order(bars, machine, late, idle_days)


def online_regimes(rows: DataFrame, pack: dict, late: str = "3 days", idle_days: int | None = None) -> DataFrame:
    """(symbol, date, p): a fitted regime model's state probabilities given the rows so far, of a stream of its inputs."""
    from tidemark.operators.models import apply_hmm

    inputs = tuple(pack["inputs"])

    def step(state: tuple | None, row: tuple) -> tuple[tuple, tuple]:
        p = apply_hmm(pack, np.array([row[1:]], dtype=float), None if state is None else state[0])[0].tolist()
        return (p,), (row[0], p)

    return in_order(rows, Machine(("date", *inputs), "p array<double>", "date date, p array<double>", step), late, idle_days)


def online_ewma(values: DataFrame, span: int = 20, late: str = "3 days", idle_days: int | None = None) -> DataFrame:
    """(symbol, date, n, ewma): the exponentially weighted mean of a stream ``values(symbol, date, value)``; null values are left out."""
    alpha = 2 / (span + 1)

    def step(state: tuple | None, row: tuple) -> tuple[tuple, tuple]:
        n, mean = state or (0, 0.0)
        if row[1] is not None and row[1] == row[1]:  # a null arrives as NaN
            n, mean = n + 1, float(row[1]) if n == 0 else mean + alpha * (float(row[1]) - mean)
        return (n, mean), (row[0], n, mean)

    return in_order(values, Machine(("date", "value"), "n long, mean double", "date date, n long, ewma double", step), late, idle_days)
