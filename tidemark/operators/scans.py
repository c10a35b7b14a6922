"""Recursions over a series without the series in one task: associative scans over ranges of its rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days of one range, and so the rows of a group in a series of one row a day.
RANGE_DAYS = 512


@dataclass(frozen=True)
class Recursion:
    """How a range of rows acts on the state before it.

    ``summarise`` turns ordered rows into an element, ``advance`` takes a state (None: before
    the first row) through an element, and ``replay`` gives the rows' results from the state before
    them. States and elements are lists of numbers, elements of bounded length.
    """

    summarise: Callable[[pd.DataFrame], list[float]]
    advance: Callable[[list[float] | None, list[float]], list[float]]
    replay: Callable[[pd.DataFrame, list[float] | None], pd.DataFrame]


def days_of(date: str = "date", days: int = RANGE_DAYS) -> Column:
    """The range of a date, counted in ``days``."""
    return F.floor(F.datediff(F.col(date), F.lit("1970-01-01").cast("date")) / days)


def scan(rows: DataFrame, recursion: Recursion, schema: str, ranges: Column | None = None, keys: Sequence[str] = ("symbol",), order: str = "date") -> DataFrame:
    """The rows of ``recursion.replay`` over every series of ``keys``.

    ``ranges`` must not fall with ``order``, and bounds the rows of a group. Each range is
    summarised by one element; elements, one row a range, are gone through in order for the state before
    each range; then all ranges are replayed at once. A series of n ranges so takes three short
    steps of n parallel tasks instead of one long task.
    """
    keys = list(keys)
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    placed = rows.withColumn("_range", (days_of(order) if ranges is None else ranges).cast("long"))

    def element(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        found = recursion.summarise(part.sort_values(order, kind="stable").drop(columns="_range"))
        return pd.DataFrame([(*key, [float(x) for x in found])], columns=[*keys, "_range", "element"])

    def states(key: tuple, elements: pd.DataFrame) -> pd.DataFrame:
        state, out = None, []
        for at, found in elements.sort_values("_range")[["_range", "element"]].itertuples(index=False):
            out.append((*key, at, state))
            state = [float(x) for x in recursion.advance(state, list(found))]
        return pd.DataFrame(out, columns=[*keys, "_range", "state"])

    def results(part: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        state = before["state"].iat[0]
        return recursion.replay(part.sort_values(order, kind="stable").drop(columns="_range").reset_index(drop=True), None if state is None else list(state))

    elements = placed.groupBy(*keys, "_range").applyInPandas(element, f"{kinds}, _range long, element array<double>")
    before = elements.groupBy(*keys).applyInPandas(states, f"{kinds}, _range long, state array<double>")
    return placed.groupBy(*keys, "_range").cogroup(before.groupBy(*keys, "_range")).applyInPandas(results, schema)


# ------------------------------------------------------------------ weighted means


def ewma(span: int, value: str, name: str) -> Recursion:
    """The exponentially weighted mean of ``value`` as ``name``, null before ``span`` values; missing values age the mean.

    Between values the mean's weight shrinks, so a range acts through its first value and is affine after it:
    (rows, values, rows before the first, first value, slope, offset, rows after the last).
    """
    alpha = 2 / (span + 1)
    keep = 1 - alpha

    def meet(mean: float, age: int, x: float) -> float:
        old = keep**age
        return (old * mean + alpha * x) / (old + alpha)

    def summarise(rows: pd.DataFrame) -> list[float]:
        x = rows[value].to_numpy(dtype=float)
        at = np.flatnonzero(np.isfinite(x))
        if not len(at):
            return [len(x), 0, 0, 0, 0, 0, 0]
        slope, offset = 1.0, 0.0
        for gap, v in zip(np.diff(at), x[at[1:]]):
            old = keep**gap
            slope, offset = slope * old / (old + alpha), (offset * old + alpha * v) / (old + alpha)
        return [len(x), len(at), at[0], x[at[0]], slope, offset, len(x) - 1 - at[-1]]

    def advance(state: list[float] | None, element: list[float]) -> list[float]:
        mean, age, n = state or [0.0, 0.0, 0.0]
        rows, values, lead, first, slope, offset, tail = element
        if not values:
            return [mean, age + rows, n]
        first = meet(mean, age + lead + 1, first) if n else first
        return [slope * first + offset, tail, n + values]

    def replay(rows: pd.DataFrame, state: list[float] | None) -> pd.DataFrame:
        mean, age, n = state or [0.0, 0.0, 0.0]
        out = []
        for x in rows[value].to_numpy(dtype=float):
            age += 1
            if np.isfinite(x):
                mean, age, n = meet(mean, age, x) if n else x, 0.0, n + 1
            out.append(mean if n >= span else None)
        return rows.assign(**{name: pd.array(out, dtype="Float64") if any(v is None for v in out) else out})

    return Recursion(summarise, advance, replay)


# ------------------------------------------------------------------ hidden Markov filter


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def log_product(steps: np.ndarray) -> np.ndarray:
    """The product of log matrices in order, by halves: (n, k, k) to (k, k)."""
    k = steps.shape[1]
    while len(steps) > 1:
        odd = steps[-1:] if len(steps) % 2 else np.zeros((0, k, k))
        pairs = steps[: len(steps) // 2 * 2].reshape(-1, 2, k, k)
        steps = np.concatenate([log_sum(pairs[:, 0, :, :, None] + pairs[:, 1, None, :, :], 2), odd])
    return steps[0]


def chain_element(density: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What rows of log densities do to a log state vector: the first row's densities, and one log matrix for the rest."""
    k = len(move)
    if len(density) == 1:
        return density[0], np.where(np.eye(k) > 0, 0.0, -np.inf)
    return density[0], log_product(move[None] + density[1:, None, :])


def chain_step(state: np.ndarray | None, first: np.ndarray, rest: np.ndarray, start: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The log state vector behind an element; None: before the first row."""
    a = first + (start if state is None else log_sum(state[:, None] + move, 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        return log_sum(a[:, None] + rest, 0)


def markov_filter(inputs: Sequence[str], densities: Callable[[np.ndarray], np.ndarray], start: np.ndarray, move: np.ndarray, columns: Sequence[str]) -> Recursion:
    """State probabilities given the rows so far, as ``columns``; ``start`` and ``move`` are logs. A range is a k x k log matrix."""
    k = len(start)

    def summarise(rows: pd.DataFrame) -> list[float]:
        first, rest = chain_element(densities(rows[list(inputs)].to_numpy(dtype=float)), move)
        return [*first, *np.maximum(rest, -1e300).ravel()]

    def advance(state: list[float] | None, element: list[float]) -> list[float]:
        element = np.array(element)
        a = chain_step(None if state is None else np.array(state), element[:k], element[k:].reshape(k, k), start, move)
        return (a - log_sum(a, 0)).tolist()

    def replay(rows: pd.DataFrame, state: list[float] | None) -> pd.DataFrame:
        density = densities(rows[list(inputs)].to_numpy(dtype=float))
        out, a = np.empty_like(density), None if state is None else np.array(state)
        for t in range(len(density)):
            a = density[t] + (start if a is None else log_sum(a[:, None] + move, 0))
            a = a - log_sum(a, 0)
            out[t] = np.exp(a)
        return rows.assign(**{n: out[:, i] for i, n in enumerate(columns)})

    return Recursion(summarise, advance, replay)


# ------------------------------------------------------------------ rate limits


class Limited:
    """The map of a value through rate-limited moves: monotone, pieces of slope 0 or 1 between few knots.

    A move of at most ``limit`` towards a goal sends all values within ``limit`` of the goal there; as
    each such plateau uses up twice the limit of the values' range, there are at most as many as fit.
    """

    def __init__(self, low: float, high: float):
        self.low, self.high = low, high
        self.at = self.to = np.array([low, high])

    def move(self, goal: float, limit: float) -> None:
        bends = [b for b in (goal - limit, goal + limit) if self.to[0] < b < self.to[-1]]
        at = np.unique(np.concatenate([self.at, self._back(bends)]))
        to = np.interp(at, self.at, self.to)
        reached = np.abs(goal - to) <= limit + 1e-12  # a plateau's ends are equal to the last bit
        to = np.clip(np.where(reached, goal, to + np.clip(goal - to, -limit, limit)), self.low, self.high)
        slope = np.diff(to) / np.diff(at)
        bent = np.abs(np.diff(slope)) > 1e-9
        inner = np.concatenate([[True], bent, [True]])
        self.at, self.to = at[inner], to[inner]

    def _back(self, values: list[float]) -> np.ndarray:
        """Where the map takes these values on its rising pieces."""
        rising = np.flatnonzero(np.diff(self.to) > 0)
        found = [self.at[i] + (v - self.to[i]) * (self.at[i + 1] - self.at[i]) / (self.to[i + 1] - self.to[i]) for v in values for i in rising if self.to[i] < v < self.to[i + 1]]
        return np.array(found)

    def numbers(self) -> list[float]:
        return [len(self.at), *self.at, *self.to]


def limited_at(x: float, numbers: Sequence[float]) -> float:
    n = int(numbers[0])
    return float(np.interp(x, numbers[1 : n + 1], numbers[n + 1 : 2 * n + 1]))
