"""Candle shape features and categories, and their forward outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import complete, quantiles, series

HORIZONS = (1, 3, 5)


def candle_features(bars: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    c, w = F.col, series()
    x = bars.withColumns({"range_size": c("high") - c("low"), "net_move": c("close") - c("open"), "upper_shadow": c("high") - F.greatest("open", "close"), "lower_shadow": F.least("open", "close") - c("low"), "prev_close": F.coalesce(F.lag("close").over(w), c("open"))})

    def share(v: Column) -> Column:
        return F.when(c("range_size") > 0, v / c("range_size")).otherwise(0.0)

    out: dict[str, Column] = {n: c(n) for n in ("range_size", "net_move", "upper_shadow", "lower_shadow", "prev_close")}
    out |= {f"pct_{n}": c(n) / c("prev_close") for n in ("range_size", "net_move", "upper_shadow", "lower_shadow")}
    out |= {"frac_body": share(F.abs("net_move")), "frac_upper_shadow": share(c("upper_shadow")), "frac_lower_shadow": share(c("lower_shadow")), "direction": F.signum("net_move"), "close_in_range": share(c("close") - c("low"))}
    for n in horizons:
        out[f"fwd_logret_{n}"] = F.ln(F.lead("close", n).over(w) / c("close"))
        out[f"mfe_{n}"] = complete(F.max("high"), c("high"), n) / c("close") - 1
        out[f"mae_{n}"] = complete(F.min("low"), c("low"), n) / c("close") - 1
    return x.select("symbol", "date", *[v.alias(k) for k, v in out.items()])


def quantile_label(x: Column, edges: Column) -> Column:
    """``Q1``... by sorted distinct edges, upper edge included, the lowest one too."""
    inside = F.size(F.filter(F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0))), lambda e: x > e))
    return F.when(x.isNotNull(), F.concat(F.lit("Q"), (inside + 1).cast("string")))


def candle_classes(candles: DataFrame, buckets: int = 4, dominant: float = 0.5, doji: float = 0.1) -> DataFrame:
    """Volatility quartile, shape, direction, and the three joined by a pipe."""
    c = F.col
    edges = candles.groupBy("symbol").agg(F.array_distinct(quantiles(c("pct_range_size"), [i / buckets for i in range(buckets + 1)])).alias("edges"))
    shape = F.when(c("frac_body") <= doji, "doji-ish").when(c("frac_body") >= dominant, "body-dominant").when(c("frac_lower_shadow") >= dominant, "lower-dominant").when(c("frac_upper_shadow") >= dominant, "upper-dominant").otherwise("balanced")
    side = F.when(c("direction") > 0, "bull").when(c("direction") < 0, "bear").otherwise("flat")
    named = candles.join(F.broadcast(edges), "symbol").withColumns({"vol_class": quantile_label(c("pct_range_size"), c("edges")), "shape_class": shape, "direction_class": side}).drop("edges")
    return named.withColumn("candle_class", F.concat("vol_class", F.lit("|"), "shape_class", F.lit("|"), "direction_class"))


def identity_breaks(candles: DataFrame, atol: float = 1e-9, rtol: float = 1e-9) -> DataFrame:
    """Rows whose shadows and body don't add up to their range."""
    total = F.col("upper_shadow") + F.col("lower_shadow") + F.abs("net_move")
    return candles.where(F.abs(total - F.col("range_size")) > F.lit(atol) + F.lit(rtol) * F.abs("range_size"))
