"""What a table must hold before a model sees it: columns, rows, joins, splits and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

c = F.col

# Columns that know the future or a swing's confirmed end.
LEAKING_PREFIXES = ("next_", "containing_", "buy_zone_", "sell_zone_", "dist_to_current_", "current_confirmed_")
LEAKING = ("date", "row_is_in_confirmed_down_swing", "row_is_in_confirmed_up_swing", "current_leg_start_price", "last_confirmed_pivot_price", "last_confirmed_pivot_date", "current_leg_start_date")
# Least rows of a calibrated model's parts, and the parts' shares.
LEAST_ROWS, TEST_SHARE, CALIBRATION_SHARE = {"train": 800, "calibration": 200, "test": 200}, 0.20, 0.20
MAPPINGS = ("CORE", "DRIFT", "SHOCK", "SURGE")


def causal_columns(names: Sequence[str]) -> list[str]:
    """The names that don't leak; an error if none is left."""
    kept = [n for n in names if n not in LEAKING and not n.startswith(LEAKING_PREFIXES)]
    if not kept:
        raise ValueError("no causal column is left")
    return kept


def column_kinds(rows: DataFrame, names: Sequence[str]) -> dict[str, str]:
    """``numeric`` or ``categorical`` by type; booleans are numbers."""
    number = (T.NumericType, T.BooleanType)
    return {n: "numeric" if isinstance(rows.schema[n].dataType, number) else "categorical" for n in names}


def varying_columns(train: DataFrame, names: Sequence[str]) -> DataFrame:
    """(column, kind, values): how many different values the training rows hold, for causal columns with more than one."""
    names = causal_columns(names)
    kinds = column_kinds(train, names)
    counted = train.agg(*[F.count_distinct(n).alias(n) for n in names])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.lit(kinds[n]).alias("kind"), c(n).alias("values")) for n in names]))
    return counted.select(each.alias("x")).select("x.*").where(c("values") > 1)


def with_any(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows in which some of the columns is known."""
    return rows.where(F.greatest(*[c(n).isNotNull() for n in names]) if len(names) > 1 else c(names[0]).isNotNull())


def complete_rows(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """(symbol, rows, usable, dropped, first, last): rows with all columns known, and the span of dates that they cover."""
    whole = F.least(*[c(n).isNotNull() for n in names])
    return rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.count_if(whole).alias("usable"), F.count_if(~whole).alias("dropped"), F.min(F.when(whole, c("date"))).alias("first"), F.max(F.when(whole, c("date"))).alias("last"))


def one_hot(rows: DataFrame, column: str, train: Column) -> DataFrame:
    """``rows`` with a 0/1 column for each value in the training rows; missing values take the commonest of them (the least of equals), unknown ones have none.

    The values come to the driver: a categorical column has few by definition, and more than 1000 are an error.
    """
    seen = rows.where(train & c(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), column).limit(1001).collect()
    if len(seen) > 1000:
        raise ValueError(f"{column} has too many values")
    values = sorted(r[column] for r in seen)
    filled = F.coalesce(c(column), F.lit(seen[0][column] if seen else None))
    return rows.withColumns({f"{column}={v}": F.when(filled == v, 1.0).otherwise(0.0) for v in values})


def date_range(rows: DataFrame, first: str, last: str, names: Sequence[str]) -> DataFrame:
    """(symbol, date, name, value) of the days from ``first`` to ``last``, both included."""
    return rows.where(c("date").between(F.lit(first).cast("date"), F.lit(last).cast("date"))).select("symbol", "date", *[c(n).cast("double").alias(n) for n in names]).unpivot(["symbol", "date"], list(names), "name", "value")


def column_series(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """(symbol, dates, *names): each series as arrays in the order of its dates; a series has one row a day, which bounds them."""
    held = F.array_sort(F.collect_list(F.struct("date", *names)))
    return rows.groupBy("symbol").agg(held.alias("x")).select("symbol", c("x.date").alias("dates"), *[c(f"x.{n}").alias(n) for n in names])


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join in which no key may repeat on either side: a repeat fails the query instead of multiplying rows."""

    def single(rows: DataFrame) -> DataFrame:
        n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
        return rows.withColumn("_n", n).withColumn("_n", F.when(c("_n") == 1, 1).otherwise(F.raise_error(F.concat_ws(" ", F.lit("repeated key:"), *[c(k).cast("string") for k in keys])))).where(c("_n") == 1).drop("_n")

    return single(left).join(single(right), list(keys))


def outer_without(left: DataFrame, right: DataFrame, keys: Sequence[str], needed: str) -> DataFrame:
    """Both sides' rows, but for those in which ``needed`` is missing."""
    return left.join(right, list(keys), "full").where(c(needed).isNotNull())


def uncovered(days: DataFrame, covering: DataFrame, keys: Sequence[str] = ("date",)) -> DataFrame:
    """``days`` that ``covering`` lacks."""
    return days.join(covering.select(*keys).distinct(), list(keys), "left_anti")


def aligned(index: DataFrame, values: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """``index`` in full, with the values of its keys where there are any."""
    return index.join(values.select(*keys, *names), list(keys), "left")


def markers(bars: DataFrame, scores: DataFrame, threshold: float) -> DataFrame:
    """(symbol, date, name, price): a mark where a score of ``scores(symbol, date, name, score)`` reaches the threshold, at the low for buying and the high for selling."""
    return scores.where(c("score") >= threshold).join(bars.select("symbol", "date", "high", "low"), ["symbol", "date"]).select("symbol", "date", "name", F.when(c("name").contains("buy"), c("low")).otherwise(c("high")).alias("price"))


def interval_outcomes(intervals: DataFrame, rows: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """``intervals(symbol, end_row, similarity)`` with what followed their last row: log return, best rise and worst fall for each horizon.

    ``rows(symbol, date, close, high, low)`` are numbered by date from 1; outcomes that would pass the last row are missing.
    """
    w = Window.partitionBy("symbol").orderBy("date")
    out = {"end_row": F.row_number().over(w)}
    for k in horizons:
        after, there = w.rowsBetween(1, k), F.lead("close", k).over(w)
        out |= {f"fwd_logret_{k}": F.ln(there / c("close")), f"mfe_{k}": F.when(there.isNotNull(), F.max("high").over(after) / c("close") - 1), f"mae_{k}": F.when(there.isNotNull(), F.min("low").over(after) / c("close") - 1)}
    numbered = rows.select("symbol", *[v.alias(k) for k, v in out.items()])
    return intervals.join(numbered, ["symbol", "end_row"])


def outcome_summary(found: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """(symbol, horizon, n, similarity_median, logret_mean, logret_median, winrate, mfe_median, mae_median); a missing return doesn't win."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("horizon"), c(f"fwd_logret_{k}").alias("r"), c(f"mfe_{k}").alias("up"), c(f"mae_{k}").alias("down")) for k in horizons]))
    x = found.select("symbol", "similarity", each.alias("x")).select("symbol", "similarity", "x.*")
    return x.groupBy("symbol", "horizon").agg(
        F.count(F.lit(1)).alias("n"), F.median("similarity").alias("similarity_median"), F.avg("r").alias("logret_mean"), F.median("r").alias("logret_median"),
        F.avg(F.when(F.coalesce(c("r") > 0, F.lit(False)), 1.0).otherwise(0.0)).alias("winrate"), F.median("up").alias("mfe_median"), F.median("down").alias("mae_median"),
    )


def temporal_bounds(sizes: DataFrame, least: dict[str, int] | None = None, test: float = TEST_SHARE, calibration: float = CALIBRATION_SHARE) -> DataFrame:
    """``sizes(symbol, n)`` with train_rows, calibration_rows and test_rows: shares rounded half to even, raised to the least, the rest to train; null where ``n`` is too small."""
    least = least or LEAST_ROWS
    enough = c("n") >= sum(least.values())
    t = F.least(F.greatest(F.bround(c("n") * test).cast("long"), F.lit(least["test"])), c("n") - least["train"] - least["calibration"])
    x = sizes.withColumn("test_rows", F.when(enough, t))
    rest = c("n") - c("test_rows")
    x = x.withColumn("calibration_rows", F.least(F.greatest(F.bround(rest * calibration).cast("long"), F.lit(least["calibration"])), rest - least["train"]))
    return x.withColumn("train_rows", c("n") - c("test_rows") - c("calibration_rows"))


def target_kinds(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """(target, is_binary, is_return): whether a column holds nothing but 0 and 1, and whether it is a return by its name."""
    aggregated = rows.agg(*[F.coalesce(F.min((c(n) == 0) | (c(n) == 1)), F.lit(False)).alias(n) for n in names])
    return aggregated.select(F.explode(F.array(*[F.struct(F.lit(n).alias("target"), c(n).alias("is_binary"), F.lit(n.startswith("ret_")).alias("is_return")) for n in names])).alias("x")).select("x.*")


def zone_violations(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """(rule, n): rows of a zone dataset against its invariants; ``rows(symbol, date, direction, distance, fraction, *zones)``.

    One row a day as in ``prices``; labels only inside their swing; fractions within [0, 1]; distances not negative; flags 0 or 1; never both sides at once.
    """
    buy, sell = ([n for n in rows.columns if n.startswith(f"{side}_zone_")] for side in ("buy", "sell"))
    some = lambda names: F.greatest(*[F.coalesce(c(n) > 0, F.lit(False)) for n in names])
    way = F.coalesce("direction", F.lit(""))
    rules = {
        "buy_outside_down": some(buy) & (way != "down"),
        "sell_outside_up": some(sell) & (way != "up"),
        "fraction_out_of_range": F.coalesce((c("fraction") < 0) | (c("fraction") > 1), F.lit(False)),
        "distance_negative": F.coalesce(c("distance") < -1e-12, F.lit(False)),
        "flag_not_binary": F.greatest(*[F.coalesce(~c(n).isin(0, 1), F.lit(True)) for n in (*buy, *sell)]),
        "both_sides": some(buy) & some(sell),
    }
    counted = rows.agg(*[F.count_if(v).alias(k) for k, v in rules.items()]).select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), c(k).alias("n")) for k in rules])).alias("x")).select("x.*")
    per_day = rows.groupBy("symbol", "date").agg(F.count(F.lit(1)).alias("k")).join(prices.select("symbol", "date", F.lit(1).alias("p")), ["symbol", "date"], "full")
    days = per_day.agg(F.count_if(c("k") > 1).alias("date_repeated"), F.count_if(c("k").isNull()).alias("date_missing"), F.count_if(c("p").isNull()).alias("date_unknown"))
    return counted.unionByName(days.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), c(k).alias("n")) for k in days.columns])).alias("x")).select("x.*"))


def signature_table(rows: DataFrame, states: Sequence[str], names: Sequence[str]) -> DataFrame:
    """(symbol, state, occupancy, mean_<name>...): each state's means, weighted by its probability in ``states``; a missing value has no weight, occupancy is the mean probability."""
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("state"), c(s).alias("p")) for s in states]))
    long = rows.where(F.least(*[c(s).isNotNull() for s in states])).select("symbol", *names, each.alias("x")).select("symbol", "x.*", *names)
    mean = lambda n: F.when(F.sum(F.when(c(n).isNotNull(), c("p"))) > 0, F.sum(c(n) * c("p")) / F.sum(F.when(c(n).isNotNull(), c("p")))).alias(f"mean_{n}")
    return long.groupBy("symbol", "state").agg(F.avg("p").alias("occupancy"), *[mean(n) for n in names])


def mixture_moments(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, mean, sd) of a mixture of ``parts(*keys, weight, mean, sd)``; weights count as shares of their sum, the variance is 1e-12 at least."""
    share = c("weight") / F.sum("weight").over(Window.partitionBy(*keys))
    x = parts.withColumn("w", share).groupBy(*keys).agg(F.sum(c("w") * c("mean")).alias("m"), F.sum(c("w") * (c("sd") * c("sd") + c("mean") * c("mean"))).alias("q"))
    return x.select(*keys, c("m").alias("mean"), F.sqrt(F.greatest(c("q") - c("m") * c("m"), F.lit(1e-12))).alias("sd"))


def recommendation(metrics: DataFrame, baseline: str) -> DataFrame:
    """(symbol, candidate, verdict): the other method of least mean distance against the baseline.

    ``metrics(symbol, method, distance, hit_5, top_hit_5)``. A candidate that comes nearer and
    gives up neither hit rate is taken, one that only comes nearer with caution.
    """
    best = metrics.where(c("method") != baseline).groupBy("symbol").agg(F.min(F.struct(c("distance").isNull(), "distance", "method", "hit_5", "top_hit_5")).alias("b"))
    fixed = metrics.where(c("method") == baseline).select("symbol", c("distance").alias("d"), c("hit_5").alias("h"), c("top_hit_5").alias("t"))
    nearer = F.coalesce(c("b.distance") < c("d"), F.lit(False))
    whole = nearer & F.coalesce((c("b.hit_5") >= c("h")) & (c("b.top_hit_5") >= c("t")), F.lit(False))
    return fixed.join(best, "symbol", "left").select("symbol", c("b.method").alias("candidate"), F.when(whole, "Continue").when(nearer, "Continue cautiously").otherwise("Pause / likely dead end").alias("verdict"))


def recommended_grid(summary: DataFrame) -> DataFrame:
    """(granularity, atr_window, k, swings, median_duration): the fine and the medium setting of a swing grid, which has a row a setting.

    Of the stable middle (k of 1.25, 1.5 and 2) those with the wanted duration and count, or
    where there are none those on the right side of four days; the nearest to the wanted
    duration, then to an ATR window of 14, then of least k, then of most swings.
    """
    # Wanted durations, counts, and the centre.
    wanted = {"fine": (3, 4, 650, 800, 3), "medium": (4, 7, 300, 600, 5)}
    middle = summary.where(c("k").isin(1.25, 1.5, 2.0))
    out = None
    for name, (low, high, few, many, centre) in wanted.items():
        fits = c("median_duration").between(low, high) & c("swings").between(few, many)
        fallback = c("median_duration") <= 4 if name == "fine" else c("median_duration") >= 4
        preferred = middle.withColumn("fits", fits).where(c("fits") | fallback)
        best = preferred.orderBy(F.desc("fits"), F.abs(c("median_duration") - centre), F.abs(c("atr_window") - 14), "k", F.desc("swings")).limit(1).select(F.lit(name).alias("granularity"), "atr_window", "k", "swings", "median_duration")
        out = best if out is None else out.unionByName(best)
    return out


def grid_ranges(summary: DataFrame, by: str) -> DataFrame:
    """(by, least and greatest count, median size and duration) over the rest of a swing grid."""
    return summary.groupBy(by).agg(*[f(n).alias(f"{n}_{k}") for n in ("swings", "median_abs_amplitude", "median_duration") for k, f in (("min", F.min), ("max", F.max))])


def pack_view(pack: dict) -> dict:
    """A fitted regime model's transitions with rows that sum to one, and its names; an error if a name is missing or the matrix isn't square."""
    move = pack["move"]
    if any(len(row) != len(move) for row in move):
        raise ValueError("the transition matrix must be square")
    names = dict(zip(MAPPINGS, pack["states"], strict=False)) if len(pack["states"]) == len(MAPPINGS) else {}
    if set(names.values()) != set(range(len(move))):
        raise ValueError("the pack's names are incomplete")
    return {"move": [[x / max(sum(row), 1e-12) for x in row] for row in move], "name_to_state": names, "state_to_name": {s: n for n, s in names.items()}}
