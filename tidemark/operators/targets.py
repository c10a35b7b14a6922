"""Forward-looking targets; rows without the whole horizon are null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import complete, next_rows, series

RETURNS, EXCURSIONS = (1, 3, 5, 10, 20), (3, 5, 10)
TOUCHES = ((0.02, 3), (0.02, 5), (0.02, 10), (0.05, 10))


def first_touch(horizon: int, share: float = 0.02) -> Column:
    """Which barrier around the close the next bars reach first."""
    w = next_rows(horizon)
    up, down = F.col("close") * (1 + share), F.col("close") * (1 - share)
    hits = F.filter(F.collect_list(F.struct("high", "low")).over(w), lambda b: (b["high"] >= up) | (b["low"] <= down))
    first = F.get(hits, F.lit(0))
    label = F.when(F.size(hits) == 0, "none").when((first["high"] >= up) & (first["low"] <= down), "both_same_bar").when(first["high"] >= up, "up").otherwise("down")
    return F.when(F.count("close").over(w) == horizon, label)


def targets(bars: DataFrame) -> DataFrame:
    c, w = F.col("close"), series()
    out: dict[str, Column] = {f"ret_{k}d": F.lead("close", k).over(w) / c - 1 for k in RETURNS}
    for n in EXCURSIONS:
        out[f"max_up_{n}d"] = complete(F.max("high"), F.col("high"), n) / c - 1
        out[f"max_down_{n}d"] = complete(F.min("low"), F.col("low"), n) / c - 1
    for share, n in TOUCHES:
        out[f"touch_up_{round(share * 100)}pct_{n}d"] = (complete(F.max("high"), F.col("high"), n) >= c * (1 + share)).cast("double")
        out[f"touch_down_{round(share * 100)}pct_{n}d"] = (complete(F.min("low"), F.col("low"), n) <= c * (1 - share)).cast("double")
    for n in EXCURSIONS:
        out[f"first_touch_2pct_{n}d"] = first_touch(n)
    return bars.select("symbol", "date", *[v.alias(k) for k, v in out.items()])
