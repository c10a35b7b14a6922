"""Analogs of a row among earlier rows, and intervals like a given one."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import clip, clip01, last_rows, next_rows, series

c = F.col


def analog_vector(lags: int = 5) -> Column:
    """Scaled candles of the last ``lags`` rows and sixteen clipped state terms; null unless all are finite."""
    w = series()
    atr = F.when(c("atr") > 0, c("atr"))
    candle = [c("r1"), c("candle_body") / atr, c("candle_range") / atr, c("upper_wick_ratio"), c("lower_wick_ratio"), c("close_in_range")]
    zero = lambda n: F.coalesce(c(n), F.lit(0.0))
    # The scales of the state terms.
    state = [
        clip01(zero("band_pos")), clip(zero("dist_from_mean_vol_units") / 3, -1, 1), clip01(zero("atr_pct") / 0.10), clip01(zero("ewma_vol") / 0.10),
        clip01(zero("P_CORRECTION_10D_CAL")), clip01(zero("P_REBOUND_10D_CAL")), clip01(zero("P_SHOCK_HMM")), clip01(zero("P_SURGE_HMM")),
        F.when(c("live_swing_direction") == "down", -1.0).when(c("live_swing_direction") == "up", 1.0).otherwise(0.0),
        clip01(zero("days_since_last_pivot") / 20), clip(zero("distance_from_last_pivot_pct") / 0.20, -1, 1), clip01(zero("current_swing_age_pct_of_median") / 2), clip01(zero("current_swing_size_pct_of_median") / 2),
        clip(zero("ONCHAIN_DOM_Z") / 3, -1, 1), clip(zero("ONCHAIN_WHALE_SHARE_Z") / 3, -1, 1), clip(zero("ONCHAIN_VOL_Z") / 3, -1, 1),
    ]
    parts = [F.lag(x, k).over(w) if k else x for k in range(lags) for x in candle] + state
    vector = F.array(*[x.cast("double") for x in parts])
    return F.when(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), vector)


def outcomes(days: int = 5) -> dict[str, Column]:
    """What the next ``days`` rows, or as many as there are, brought: a rise of 5 and 3 percent, days to the first."""
    w, close = next_rows(days), c("close")
    highs = F.collect_list("high").over(w)
    first = F.array_position(F.transform(highs, lambda h: h >= close * 1.05), F.lit(True))
    return {"hit_5": (F.max("high").over(w) >= close * 1.05).cast("double"), "hit_3": (F.max("high").over(w) >= close * 1.03).cast("double"), "days": F.when(first > 0, first.cast("double"))}


def zone_outcomes(side: str, days: int = 5) -> dict[str, Column]:
    """Whether the next ``days`` rows, or as many as there are, hold one of the side's five and three percent zones, and days to the first; null without a next row."""
    w = next_rows(days)
    first = F.array_position(F.collect_list(F.coalesce(c(f"{side}_zone_5pct"), F.lit(0))).over(w), 1)
    hit = {f"hit_{n}": F.max(F.coalesce(c(f"{side}_zone_{n}pct"), F.lit(0))).over(w).cast("double") for n in (5, 3)}
    return hit | {"days": F.when(first > 0, first.cast("double"))}


#: Rows of a series that are compared with as many earlier ones in one task.
BLOCK = 512


def top_matches(rows: DataFrame, k: int, outcomes: Sequence[str], embargo: int = 0, block: int = BLOCK) -> DataFrame:
    """(symbol, date, s, *outcomes): for each row the ``k`` most similar earlier candidates of its series, the later of equals first.

    ``rows(symbol, date, vector, candidate, *outcomes)``; rows without a vector take no part,
    ``embargo`` leaves out the nearest rows. A series is cut into blocks of rows, and
    each block is multiplied with each of the blocks up to it in a task of its own; of a pair of
    blocks only the ``k`` best of a row go on, and are merged by row. The work is quadratic in a series, but no task sees more than two blocks.
    """
    numbered = rows.withColumn("rn", F.row_number().over(series())).withColumn("_last", F.max("rn").over(Window.partitionBy("symbol"))).where(c("vector").isNotNull())
    own = F.floor(c("rn") / block)
    queries = numbered.select("symbol", "date", "rn", "vector", own.alias("_q"), F.explode(F.sequence(F.lit(0).cast("long"), own)).alias("_e"))
    # new names for the other side: both come from the same rows
    earlier = numbered.where("candidate").select(c("symbol").alias("_symbol"), c("rn").alias("_prior"), c("vector").alias("_other"), *[c(n).alias(f"_of_{n}") for n in outcomes], own.alias("_from"), F.explode(F.sequence(own, F.floor(c("_last") / block))).alias("_to"))
    names = ["symbol", "date", "rn", "s", "prior", *outcomes]

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=names)
        right = right.sort_values("_prior", ascending=False)
        x, y = np.stack(left["vector"].to_numpy()), np.stack(right["_other"].to_numpy())
        nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
        s = np.round(x @ y.T / (nx[:, None] * ny[None] + 1e-12), 12)
        allowed = (right["_prior"].to_numpy()[None] < left["rn"].to_numpy()[:, None] - embargo) & (nx[:, None] > 0) & (ny[None] > 0)
        order = np.argsort(np.where(allowed, -s, np.inf), axis=1, kind="stable")[:, :k]
        i, j = np.nonzero(np.take_along_axis(allowed, order, 1))
        at = order[i, j]
        found = left[["symbol", "date", "rn"]].iloc[i].reset_index(drop=True)
        best = right[["_prior", *[f"_of_{n}" for n in outcomes]]].iloc[at].reset_index(drop=True)
        best.columns = ["prior", *outcomes]
        return pd.concat([found, pd.Series(s[i, at], name="s"), best], axis=1)[names]

    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in outcomes)
    best = queries.groupBy("symbol", "_q", "_e").cogroup(earlier.groupBy("_symbol", "_to", "_from")).applyInPandas(compare, f"symbol string, date date, rn long, s double, prior long, {kinds}")
    place = F.row_number().over(Window.partitionBy("symbol", "rn").orderBy(F.desc("s"), F.desc("prior")))
    return best.withColumn("_place", place).where(c("_place") <= k).select("symbol", "date", "s", *outcomes)


def _weighted(matches: DataFrame, temperature: float) -> DataFrame:
    """``matches`` with similarity weights ``w``, the best of a row weighing one."""
    return matches.withColumn("w", F.exp((c("s") - F.max("s").over(Window.partitionBy("symbol", "date"))) / temperature))


def analogs(rows: DataFrame, k: int = 40, temperature: float = 0.15, side: str = "down", embargo: int = 0, block: int = BLOCK) -> DataFrame:
    """(symbol, date, analog_hit_5, analog_hit_3, analog_days, matches): weighted outcomes of the ``k`` most similar earlier rows.

    ``rows(symbol, date, vector, way, hit_5, hit_3, days)``. Only earlier rows on ``side``
    with an outcome are candidates; ``embargo`` leaves out the nearest ones, whose outcomes
    look past the current row. Similarity is the cosine, ties go to the later row, weights are
    ``exp((s - max) / temperature)``; ``analog_days`` is the weighted median of the known days.
    """
    values = ["hit_5", "hit_3", "days"]
    candidates = rows.select("symbol", "date", "vector", F.coalesce((c("way") == side) & c("hit_5").isNotNull(), F.lit(False)).alias("candidate"), *[c(n).cast("double").alias(n) for n in values])
    found = _weighted(top_matches(candidates, k, values, embargo, block), temperature)
    known = F.array_sort(F.collect_list(F.when(c("days").isNotNull(), F.struct("days", "w"))))
    out = found.groupBy("symbol", "date").agg((F.sum(c("w") * c("hit_5")) / F.sum("w")).alias("analog_hit_5"), (F.sum(c("w") * c("hit_3")) / F.sum("w")).alias("analog_hit_3"), known.alias("known"), F.count(F.lit(1)).cast("int").alias("matches"))
    total = F.aggregate("known", F.lit(0.0), lambda s, x: s + x["w"])
    nothing = F.struct(F.lit(0.0).alias("run"), F.lit(None).cast("double").alias("at"))
    middle = F.aggregate("known", nothing, lambda s, x: F.struct((s["run"] + x["w"]).alias("run"), F.when(s["at"].isNull() & (s["run"] + x["w"] >= 0.5 * total), x["days"]).otherwise(s["at"]).alias("at")))
    return out.select("symbol", "date", "analog_hit_5", "analog_hit_3", middle["at"].alias("analog_days"), "matches")


def candle_vector(lags: int = 5) -> Column:
    """Seven scaled candle terms of each of the last ``lags`` rows; null unless all are finite."""
    w, atr = series(), F.when(c("atr") > 0, c("atr"))
    terms = [c("r1"), c("candle_body") / atr, c("candle_range") / atr, c("upper_wick_ratio"), c("lower_wick_ratio"), c("close_in_range"), c("body_to_range_ratio")]
    vector = F.array(*[(F.lag(x, k).over(w) if k else x).cast("double") for k in range(lags) for x in terms])
    return F.when(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), vector)


def memory_scores(rows: DataFrame, outcomes: dict[str, float], k: int = 50, temperature: float = 0.08, block: int = BLOCK) -> DataFrame:
    """(symbol, date, score, matches): what followed the ``k`` most similar earlier candidates, each outcome column with its weight.

    ``rows(symbol, date, vector, candidate, *outcomes)``. An outcome's value is the average of
    its known values under similarity weights; the score is the weighted mean of the known
    outcomes, clipped to 0 and 1; rows without any are left out. Ties in similarity go to the later row.
    """
    doubles = rows.select("symbol", "date", "vector", F.coalesce("candidate", F.lit(False)).alias("candidate"), *[F.nanvl(c(n).cast("double"), F.lit(None)).alias(n) for n in outcomes])
    found = _weighted(top_matches(doubles, k, list(outcomes), 0, block), temperature)
    value = {n: F.sum(c("w") * c(n)) / F.sum(F.when(c(n).isNotNull(), c("w"))) for n in outcomes}
    out = found.groupBy("symbol", "date").agg(*[v.alias(n) for n, v in value.items()], F.count(F.lit(1)).cast("int").alias("matches"))
    share = sum((F.when(c(n).isNotNull(), F.lit(float(x))).otherwise(0.0) for n, x in outcomes.items()), F.lit(0.0))
    total = sum((F.coalesce(c(n), F.lit(0.0)) * float(x) for n, x in outcomes.items()), F.lit(0.0))
    return out.where(F.coalesce(*outcomes).isNotNull()).select("symbol", "date", clip01(total / share).alias("score"), "matches")


def sequences(rows: DataFrame, columns: Sequence[str], length: int) -> DataFrame:
    """(symbol, start_row, start_date, end_date, vector): every complete window of ``length`` rows, flattened."""
    numbered = rows.withColumn("rn", F.row_number().over(series()))
    w = last_rows(length)
    held = F.flatten(F.collect_list(F.array(*[c(x).cast("double") for x in columns])).over(w))
    full = numbered.select("symbol", c("date").alias("end_date"), F.first("date").over(w).alias("start_date"), (c("rn") - length + 1).alias("start_row"), held.alias("vector"), F.count(F.lit(1)).over(w).alias("n"))
    return full.where((c("n") == length) & (F.size("vector") == length * len(columns)) & F.forall("vector", lambda x: x.isNotNull())).drop("n")


def locate(rows: DataFrame, symbol: str, start: str, end: str) -> tuple[int, int]:
    """Row numbers of the first row from ``start`` on and the last up to ``end``."""
    numbered = rows.where(c("symbol") == symbol).withColumn("rn", F.row_number().over(series()))
    found = numbered.agg(F.min(F.when(c("date") >= F.lit(start).cast("date"), c("rn"))).alias("a"), F.max(F.when(c("date") <= F.lit(end).cast("date"), c("rn"))).alias("b")).first()
    if found["a"] is None or found["b"] is None or found["a"] > found["b"]:
        raise ValueError("no rows in the interval")
    return found["a"], found["b"]


def similar_intervals(windows: DataFrame, symbol: str, start_row: int, length: int, metric: str = "euclidean", tau: str = "median", zone: int = 0, live: bool = False, lookback: int | None = None) -> DataFrame:
    """Windows of one series by similarity ``exp(-d / tau)`` to the one that starts at ``start_row``.

    Candidates don't overlap the query, nor start within ``zone`` rows of it; ``live`` keeps
    those that end before it, at most ``lookback`` rows back. Values are standardised by the
    candidates' population deviation; Mahalanobis uses their sample covariance with a ridge
    of 1e-6. ``tau`` is ``median``, ``p75`` or a number.
    """
    one = windows.where(c("symbol") == symbol)
    apart = (c("start_row") + length <= start_row) | (c("start_row") >= start_row + length)
    candidates = one.where(apart & (F.abs(c("start_row") - start_row) > zone))
    if live:
        candidates = candidates.where(c("start_row") + length <= start_row)
        if lookback is not None:
            candidates = candidates.where(c("start_row") >= start_row - lookback)
    stats = candidates.select(F.posexplode("vector").alias("p", "v")).groupBy("p").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).agg(F.array_sort(F.collect_list(F.struct("p", "m", F.when(c("s") > 0, c("s")).otherwise(1.0).alias("s")))).alias("st"))

    def scaled(df: DataFrame) -> DataFrame:
        return df.crossJoin(F.broadcast(stats)).withColumn("vector", F.zip_with("vector", "st", lambda v, q: (v - q["m"]) / q["s"])).drop("st")

    query = scaled(one.where(c("start_row") == start_row)).select(c("vector").alias("q"), c("start_date").alias("query_date"))
    both = scaled(candidates).crossJoin(F.broadcast(query))
    gap = F.zip_with("vector", "q", lambda a, b: a - b)
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    if metric == "euclidean":
        both = both.withColumn("distance", F.sqrt(square(gap)))
    elif metric == "cosine":
        dot = F.aggregate(F.zip_with("vector", "q", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        both = both.withColumn("distance", 1 - dot / (F.sqrt(square(c("vector"))) * F.sqrt(square(c("q"))) + 1e-12))
    elif metric == "mahalanobis":
        both = both.withColumn("gap", gap).withColumn("distance", _whitened_norm(scaled(candidates))("gap")).drop("gap")
    else:
        raise ValueError(f"unknown metric {metric!r}")
    if tau in ("median", "p75"):
        scale = both.agg(F.percentile("distance", F.lit(0.5 if tau == "median" else 0.75)).alias("tau"))
        both = both.crossJoin(F.broadcast(scale))
    else:
        both = both.withColumn("tau", F.lit(float(tau)))
    return both.select("symbol", "start_row", "start_date", "end_date", "distance", F.when(c("tau") > 0, F.exp(-c("distance") / c("tau"))).alias("similarity"), F.abs(F.datediff("start_date", "query_date")).alias("gap_days"))


def covariance(rows: DataFrame, column: str = "vector") -> np.ndarray:
    """Sample covariance of an array column; the Gram matrix is summed up a tree of tasks, only its sum reaches the driver."""
    vectors = rows.select(array_to_vector(column).alias("v"))
    sd = vectors.agg(Summarizer.metrics("std").summary(c("v")).alias("s")).first()["s"]["std"].toArray()
    correlation = Correlation.corr(vectors, "v").first()[0].toArray()  # NaN for constant columns
    found = np.nan_to_num(correlation) * np.outer(sd, sd)
    np.fill_diagonal(found, sd * sd)
    return found


def _whitened_norm(rows: DataFrame):
    """A column function: the length of a vector after whitening by the covariance of ``rows``, a matrix product a batch."""
    found = covariance(rows)
    root = np.linalg.cholesky(np.linalg.inv(found + 1e-6 * np.eye(len(found))))  # as wide as a window, whatever the rows

    @F.pandas_udf("double")
    def length(gap: pd.Series) -> pd.Series:
        return pd.Series(np.linalg.norm(np.stack(gap.to_numpy()) @ root, axis=1) if len(gap) else [], dtype=float)

    return length


def ranked_matches(matches: DataFrame, least: float = 0.0, within_days: int | None = None) -> DataFrame:
    found = matches.where(c("similarity") >= least)
    if within_days is not None:
        found = found.where(c("gap_days") <= within_days)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("similarity"), "gap_days", "start_row")))
