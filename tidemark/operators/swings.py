"""Swing detection and what hangs on swings: live state, taxonomy, containing and next swing, zone labels."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import at_least, clip01, full, quantiles, series

c = F.col


def with_atr(bars: DataFrame, window: int = 10) -> DataFrame:
    """(symbol, date, high, low, close, atr_pct): mean true range over the close, rows without it left out."""
    w = series()
    before = F.lag("close").over(w)
    spread = c("high") - c("low")
    ranged = bars.withColumn("tr", F.when(before.isNull(), spread).otherwise(F.greatest(spread, F.abs(c("high") - before), F.abs(c("low") - before))))
    return ranged.withColumn("atr_pct", full(F.avg("tr"), c("tr"), window) / at_least(c("close"), 1e-8)).where(c("atr_pct").isNotNull()).select("symbol", "date", "high", "low", "close", "atr_pct")


class Zigzag:
    """One series' reversal scan: feed bars in order, read the leg's state after each."""

    __slots__ = ("direction", "extreme", "extreme_at", "k", "pivot", "pivot_at")

    def __init__(self, k: float):
        self.k, self.direction, self.pivot, self.pivot_at, self.extreme, self.extreme_at = k, 0, None, None, None, None

    def feed(self, at, high: float, low: float, close: float, atr: float):
        """The swing that this bar confirms, as (start, end, direction, amplitude), or None."""
        if self.pivot is None:
            self.pivot, self.pivot_at = close, at
            return None
        need = self.k * atr
        if self.direction == 0:
            up, down = high / self.pivot - 1, low / self.pivot - 1
            if up >= need and up >= abs(down):
                self.direction, self.extreme, self.extreme_at = 1, high, at
            elif abs(down) >= need:
                self.direction, self.extreme, self.extreme_at = -1, low, at
            return None
        rising = self.direction == 1
        beyond = high >= self.extreme if rising else low <= self.extreme
        if beyond:
            self.extreme, self.extreme_at = (high if rising else low), at
            return None
        back = 1 - low / self.extreme if rising else high / self.extreme - 1
        if back < need:
            return None
        swing = (self.pivot_at, self.extreme_at, "up" if rising else "down", self.extreme / self.pivot - 1)
        self.pivot, self.pivot_at = self.extreme, self.extreme_at
        self.direction, self.extreme, self.extreme_at = -self.direction, (low if rising else high), at
        return swing


def zigzag(ranged: DataFrame, ks: Sequence[float] = (1.5,)) -> DataFrame:
    """(symbol, k, start_date, end_date, direction, amplitude_pct, duration_days) of confirmed swings.

    The scan carries state from bar to bar; a series has one bar for each calendar day, which
    bounds its group. Parameters are spread over tasks too.
    """

    def scan(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("date")
        symbol, k = rows["symbol"].iloc[0], float(rows["k"].iloc[0])
        leg, out = Zigzag(k), []
        for bar in zip(rows["date"], rows["high"], rows["low"], rows["close"], rows["atr_pct"], strict=True):
            if (s := leg.feed(*bar)) is not None:
                out.append((symbol, k, s[0], s[1], s[2], s[3], (s[1] - s[0]).days))
        return pd.DataFrame(out, columns=["symbol", "k", "start_date", "end_date", "direction", "amplitude_pct", "duration_days"])

    each = ranged.withColumn("k", F.explode(F.array(*[F.lit(float(k)) for k in ks])))
    return each.groupBy("symbol", "k").applyInPandas(scan, "symbol string, k double, start_date date, end_date date, direction string, amplitude_pct double, duration_days int")


def live_state(ranged: DataFrame, k: float = 1.5) -> DataFrame:
    """Each bar's view of the open leg, with what earlier bars have confirmed.

    Only the two fractions of a median look at the whole series' swings.
    """

    def scan(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("date")
        leg, out, pivot, pivot_at = Zigzag(k), [], None, None
        for bar in zip(rows["date"], rows["high"], rows["low"], rows["close"], rows["atr_pct"], strict=True):
            at, close, atr = bar[0], bar[3], bar[4]
            confirmed = leg.feed(*bar) is not None
            if confirmed:
                pivot, pivot_at = leg.pivot, leg.pivot_at
            shown = leg.direction != 0 and pivot is not None
            out.append(
                (
                    rows["symbol"].iloc[0], at, {0: "unknown", 1: "up", -1: "down"}[leg.direction], confirmed,
                    pivot_at if shown else None, pivot if shown else None, (at - pivot_at).days if shown else None,
                    close / pivot - 1 if shown else None, (close - pivot) / (atr * close) if shown and atr * close > 0 else None, atr,
                )
            )
        return pd.DataFrame(out, columns=["symbol", "date", "live_swing_direction", "swing_confirmed_today", "last_confirmed_pivot_date", "last_confirmed_pivot_price", "days_since_last_pivot", "distance_from_last_pivot_pct", "distance_from_last_pivot_atr_units", "atr_pct"])

    live = ranged.groupBy("symbol").applyInPandas(scan, "symbol string, date date, live_swing_direction string, swing_confirmed_today boolean, last_confirmed_pivot_date date, last_confirmed_pivot_price double, days_since_last_pivot double, distance_from_last_pivot_pct double, distance_from_last_pivot_atr_units double, atr_pct double")
    typical = zigzag(ranged, [k]).groupBy("symbol").agg(F.median(F.abs("amplitude_pct")).alias("size"), F.median("duration_days").alias("age"))
    return live.join(F.broadcast(typical), "symbol", "left").withColumns({"current_swing_age_pct_of_median": F.when(c("age") != 0, c("days_since_last_pivot") / c("age")), "current_swing_size_pct_of_median": F.when(c("size") != 0, F.abs("distance_from_last_pivot_pct") / c("size"))}).drop("size", "age")


def grid_summary(bars: DataFrame, atr_windows: Sequence[int] = (10, 14, 20), ks: Sequence[float] = (1.0, 1.25, 1.5, 2.0, 2.5)) -> DataFrame:
    """Counts, median size and duration of swings for each ATR window and k."""
    every = None
    for n in atr_windows:
        found = zigzag(with_atr(bars, n), ks).withColumn("atr_window", F.lit(n))
        every = found if every is None else every.unionByName(found)
    up = c("direction") == "up"
    return every.groupBy("atr_window", "k").agg(F.count(F.lit(1)).alias("swings"), F.count_if(up).alias("up_swings"), F.count_if(~up).alias("down_swings"), F.median(F.abs("amplitude_pct")).alias("median_abs_amplitude"), F.median("duration_days").alias("median_duration"), F.avg("duration_days").alias("mean_duration"))


def overlay(swings: DataFrame) -> DataFrame:
    """Swings as a chart takes them: dates as text, amplitudes that are no number missing; an error if a column lacks."""
    needed = ("symbol", "start_date", "end_date", "direction", "amplitude_pct", "duration_days")
    if lacking := [n for n in needed if n not in swings.columns]:
        raise ValueError(f"swings lack {lacking}")
    amplitude = F.when(F.abs("amplitude_pct") < float("inf"), c("amplitude_pct"))
    return swings.select("symbol", *[F.date_format(n, "yyyy-MM-dd").alias(n) for n in ("start_date", "end_date")], "direction", amplitude.alias("amplitude_pct"), c("duration_days").cast("long").alias("duration_days"))


def taxonomy(swings: DataFrame) -> DataFrame:
    """``swings`` with ``swing_id`` and size and duration class by the terciles of their series."""
    size = F.abs("amplitude_pct")
    cuts = swings.groupBy("symbol").agg(quantiles(size, [1 / 3, 2 / 3]).alias("s"), quantiles(c("duration_days"), [1 / 3, 2 / 3]).alias("d"))

    def third(x: Column, at: str, names: tuple[str, str, str]) -> Column:
        return F.when(x <= c(at)[0], names[0]).when(x <= c(at)[1], names[1]).otherwise(names[2])

    return (
        swings.join(F.broadcast(cuts), "symbol")
        .withColumns({"abs_amplitude_pct": size, "size_class": third(size, "s", ("small", "medium", "large")), "duration_class": third(c("duration_days"), "d", ("short", "medium", "long")), "swing_id": F.row_number().over(Window.partitionBy("symbol").orderBy("start_date", "end_date"))})
        .drop("s", "d")
    )


def containing(days: DataFrame, swings: DataFrame) -> DataFrame:
    """``days(symbol, date)`` inside a swing, with the first such swing by start and end, the stage and its bucket.

    Swings are exploded to their days, so that the join is on equality; a pivot day belongs to the earlier swing.
    """
    inside = swings.select("symbol", F.explode(F.sequence("start_date", "end_date")).alias("date"), F.struct("start_date", "end_date", "direction", "amplitude_pct", "duration_days").alias("s"))
    first = inside.groupBy("symbol", "date").agg(F.min_by("s", F.struct("s.start_date", "s.end_date")).alias("s"))
    stage = F.datediff("date", "start_date") / F.greatest("duration_days", F.lit(1))
    joined = days.join(first, ["symbol", "date"]).select(*days.columns, "s.*").withColumn("stage_pct", stage)
    return joined.withColumn("stage", F.when(c("stage_pct") <= 1 / 3, "early").when(c("stage_pct") <= 2 / 3, "mid").otherwise("late"))


def next_swing(days: DataFrame, swings: DataFrame) -> DataFrame:
    """``days`` with ``next_start``, ``next_direction``, ``next_amplitude`` of the first swing that starts later: one window over both."""
    marks = swings.select("symbol", c("start_date").alias("date"), F.struct(c("start_date").alias("next_start"), c("direction").alias("next_direction"), c("amplitude_pct").alias("next_amplitude")).alias("s"), F.lit(0).alias("kind"))
    both = days.select("symbol", "date").withColumns({"s": F.lit(None).cast(marks.schema["s"].dataType), "kind": F.lit(1)}).unionByName(marks)
    # on equal dates the swing sorts before the day, so only later ones follow
    later = Window.partitionBy("symbol").orderBy("date", "kind").rowsBetween(1, Window.unboundedFollowing)
    return both.withColumn("n", F.first("s", ignorenulls=True).over(later)).where("kind = 1").select("symbol", "date", "n.*")


def first_lower_low(days: DataFrame, lows: DataFrame) -> DataFrame:
    """``days(symbol, date, close)`` with the first of ``lows(symbol, low_date, low_price)`` that comes later at or below the close.

    Lows are few against days and are joined by symbol; the inequality is part of the join.
    """
    met = days.alias("d").join(lows.alias("l"), (c("d.symbol") == c("l.symbol")) & (c("l.low_date") > c("d.date")) & (c("l.low_price") <= c("d.close")))
    return met.groupBy("d.symbol", "d.date").agg(F.min("l.low_date").alias("low_date"), F.min_by("l.low_price", "l.low_date").alias("low_price"))


def pivot_prices(swings: DataFrame, bars: DataFrame) -> DataFrame:
    """``swings`` with the prices at their ends: low to high going up, high to low going down."""
    s = bars.select("symbol", c("date").alias("start_date"), c("high").alias("sh"), c("low").alias("sl"))
    e = bars.select("symbol", c("date").alias("end_date"), c("high").alias("eh"), c("low").alias("el"))
    up = c("direction") == "up"
    return swings.join(s, ["symbol", "start_date"]).join(e, ["symbol", "end_date"]).withColumns({"start_price": F.when(up, c("sl")).otherwise(c("sh")), "end_price": F.when(up, c("eh")).otherwise(c("el"))}).drop("sh", "sl", "eh", "el")


def zone_labels(bars: DataFrame, swings: DataFrame) -> DataFrame:
    """Distance and fraction of range to the containing swing's end, and the buy and sell zone flags; 0 outside."""
    priced = pivot_prices(swings, bars).select("symbol", "start_date", "end_date", "start_price", "end_price")
    x = containing(bars.select("symbol", "date", "close"), swings).join(priced, ["symbol", "start_date", "end_date"])
    low, high = F.least("start_price", "end_price"), F.greatest("start_price", "end_price")
    down = c("direction") == "down"
    x = x.withColumns(
        {
            "distance": F.when(down, F.greatest(c("close") / low - 1, F.lit(0.0))).otherwise(F.greatest(high / c("close") - 1, F.lit(0.0))),
            "fraction": F.when(high > low, clip01(F.when(down, (c("close") - low) / (high - low)).otherwise((high - c("close")) / (high - low)))),
        }
    )
    flags = {}
    for side, is_side in (("buy", down), ("sell", ~down)):
        for cut in (0.05, 0.03):
            flags[f"{side}_zone_{round(cut * 100)}pct"] = F.when(is_side & (c("distance") <= cut), 1).otherwise(0)
        for cut in (0.10, 0.05):
            flags[f"{side}_zone_frac_{round(cut * 100)}"] = F.when(is_side & (c("fraction") <= cut), 1).otherwise(0)
    found = x.withColumns(flags).select("symbol", "date", "direction", "distance", "fraction", *flags)
    return bars.select("symbol", "date").join(found, ["symbol", "date"], "left").fillna(0, list(flags))


def bottom_labels(bars: DataFrame, swings: DataFrame) -> DataFrame:
    """Progress in time and price of a down swing, and its late zones; 0 outside down swings."""
    priced = pivot_prices(swings, bars).select("symbol", "start_date", "end_date", "start_price", "end_price")
    x = containing(bars.select("symbol", "date", "close"), swings).where("direction = 'down'").join(priced, ["symbol", "start_date", "end_date"])
    span = c("start_price") - c("end_price")
    x = x.withColumns({"time_progress": clip01(c("stage_pct")), "range_progress": F.when(span > 0, clip01((c("start_price") - c("close")) / span)), "above_low": c("close") / c("end_price") - 1})
    flag = lambda e: F.when(e, 1).otherwise(0)
    labels = {"zone_80": flag((c("time_progress") >= 0.8) & (c("range_progress") >= 0.8)), "zone_90": flag((c("time_progress") >= 0.9) & (c("range_progress") >= 0.9)), "near_low_2pct": flag(c("above_low") <= 0.02), "near_low_3pct": flag(c("above_low") <= 0.03)}
    found = x.withColumns(labels).select("symbol", "date", "time_progress", "range_progress", *labels)
    return bars.select("symbol", "date").join(found, ["symbol", "date"], "left").fillna(0, list(labels))
