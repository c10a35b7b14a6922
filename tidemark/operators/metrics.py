"""Scores held against labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import quantiles
from tidemark.operators.ranks import row_numbers, running_sums

c = F.col


def chronological_split(rows: DataFrame, train: float = 0.70, validation: float = 0.15) -> DataFrame:
    """``rows`` with ``split`` by place in their series."""
    w = Window.partitionBy("symbol")
    place, n = F.row_number().over(w.orderBy("date")), F.count(F.lit(1)).over(w)
    return rows.withColumn("split", F.when(place <= F.floor(n * train), "train").when(place <= F.floor(n * (train + validation)), "validation").otherwise("test"))


def classification(rows: DataFrame, keys: Sequence[str], score: str = "score", label: str = "label", cut: float = 0.5) -> DataFrame:
    """ROC and average-precision areas, Brier, log loss, precision, recall and F1 by group.

    Both areas come from running counts over the distinct scores, so that no group is ordered in one task and a score may hold any share of the rows.
    """
    keys = list(keys)
    x = rows.where(c(score).isNotNull() & c(label).isNotNull()).select(*keys, c(score).alias("s"), c(label).cast("double").alias("y"))
    clipped = F.least(F.greatest(c("s"), F.lit(1e-6)), F.lit(1 - 1e-6))
    hit = (c("s") >= cut).cast("double")
    p = F.sum("y")
    basic = x.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("y").alias("prevalence"),
        F.avg((c("s") - c("y")) * (c("s") - c("y"))).alias("brier"),
        (-F.avg(c("y") * F.ln(clipped) + (1 - c("y")) * F.ln(1 - clipped))).alias("log_loss"),
        F.when(F.sum(hit) > 0, F.sum(hit * c("y")) / F.sum(hit)).otherwise(0.0).alias("precision"),
        F.when(p > 0, F.sum(hit * c("y")) / p).otherwise(0.0).alias("recall"),
    )
    basic = basic.withColumn("f1", F.when(c("precision") + c("recall") > 0, 2 * c("precision") * c("recall") / (c("precision") + c("recall"))).otherwise(0.0))
    steps = x.groupBy(*keys, "s").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).cast("double").alias("all"))
    run = running_sums(steps, keys, [F.desc("s")], {"cp": c("pos"), "ca": c("all")})
    rank = c("ca_all") - c("ca") + (c("all") + 1) / 2  # the mean rank of a score, the lowest first
    p, n = F.first("cp_all"), F.first("ca_all") - F.first("cp_all")
    areas = run.groupBy(*keys).agg(F.when((p > 0) & (n > 0), (F.sum(rank * c("pos")) - p * (p + 1) / 2) / (p * n)).alias("roc_auc"), (F.sum(c("pos") * c("cp") / c("ca")) / F.sum("pos")).alias("average_precision"))
    return basic.join(areas, keys).select(*keys, "n", "prevalence", "roc_auc", "brier", "log_loss", "precision", "recall", "f1", "average_precision")


def calibration_table(rows: DataFrame, keys: Sequence[str], bins: int = 10) -> DataFrame:
    """(keys, bin, n, mean_score, event_rate) over quantile bins of ``score``, equal edges dropped."""
    keys = list(keys)
    edges = rows.groupBy(*keys).agg(F.array_distinct(quantiles(c("score"), [i / bins for i in range(bins + 1)])).alias("e"))
    inner = F.slice("e", F.lit(2), F.greatest(F.size("e") - 2, F.lit(0)))
    placed = rows.join(F.broadcast(edges), keys).withColumn("bin", F.size(F.filter(inner, lambda e: c("score") > e)))
    return placed.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.avg(c("label").cast("double")).alias("event_rate"))


def top_share(rows: DataFrame, keys: Sequence[str], share: float) -> DataFrame:
    """The first ``max(1, ceil(n * share))`` rows of each group by score, missing scores last."""
    x = row_numbers(rows, keys, [F.desc_nulls_last("score"), "symbol", "date"], "_rn")
    return x.where(c("_rn") <= F.greatest(F.lit(1), F.ceil(c("_rn_all") * share))).drop("_rn", "_rn_all")


def threshold_grid(rows: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """(threshold, selected, share, hit_rate) of scores at or above each threshold."""
    cuts = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    x = rows.select("score", "label", cuts)
    over = c("score") >= c("threshold")
    return x.groupBy("threshold").agg(F.count_if(over).alias("selected"), F.avg(F.coalesce(over, F.lit(False)).cast("double")).alias("share"), F.avg(F.when(over, c("label").cast("double"))).alias("hit_rate"))


def best_per_swing(rows: DataFrame, score: str = "score") -> DataFrame:
    """The row of highest score in each swing, the earliest of equals."""
    w = Window.partitionBy("symbol", "start_date").orderBy(F.desc_nulls_last(score), "date")
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def two_stage_best(rows: DataFrame, first: str, second: str, share: float = 0.4) -> DataFrame:
    """Of the top ``share`` of a swing's rows by one score, the best by another."""
    w = Window.partitionBy("symbol", "start_date")
    kept = rows.withColumns({"_rn": F.row_number().over(w.orderBy(F.desc_nulls_last(first), "date")), "_n": F.count(F.lit(1)).over(w)}).where(c("_rn") <= F.ceil(c("_n") * share)).drop("_rn", "_n")
    return best_per_swing(kept, second)


def capture(rows: DataFrame, hit: Column) -> DataFrame:
    """Swings with any hit among all swings, and the mean distance at the first hit. ``rows(symbol, start_date, date, distance)``."""
    per = rows.groupBy("symbol", "start_date").agg(F.max(F.when(hit, 1).otherwise(0)).alias("hit"), F.min_by(F.when(hit, c("distance")), F.when(hit, c("date"))).alias("at"))
    return per.groupBy("symbol").agg(F.count(F.lit(1)).alias("swings"), F.sum("hit").alias("captured"), F.avg("at").alias("mean_first_distance"))


def weighted_moments(rows: DataFrame, keys: Sequence[str], x: str = "x", w: str = "w") -> DataFrame:
    """Weighted mean and variance; unweighted where the weights sum to nothing. Negative weights count as 0."""
    weight = F.greatest(c(w), F.lit(0.0))
    m = rows.groupBy(*keys).agg(F.sum(weight).alias("sw"), F.sum(weight * c(x)).alias("sx"), F.sum(weight * c(x) * c(x)).alias("sxx"), F.avg(x).alias("mean0"), F.var_pop(x).alias("var0"))
    mean = c("sx") / c("sw")
    return m.select(*keys, F.when(c("sw") > 0, mean).otherwise(c("mean0")).alias("mean"), F.when(c("sw") > 0, F.greatest(c("sxx") / c("sw") - mean * mean, F.lit(0.0))).otherwise(c("var0")).alias("variance"))


def winsorised(rows: DataFrame, keys: Sequence[str], x: str, p: float) -> DataFrame:
    """``rows`` with ``x`` clipped at the quantiles ``p`` and ``1 - p`` of its group."""
    cuts = rows.groupBy(*keys).agg(quantiles(c(x), [p, 1 - p]).alias("_q"))
    return rows.join(F.broadcast(cuts), list(keys)).withColumn(x, F.when(c(x).isNotNull(), F.least(F.greatest(c(x), c("_q")[0]), c("_q")[1]))).drop("_q")


def weighted_median(rows: DataFrame, keys: Sequence[str], x: str = "x", w: str = "w", parts: int = 64) -> DataFrame:
    """The least value whose cumulative weight reaches half.

    Weights are summed by value first. A group isn't ordered in one task: its values are dealt
    to ``parts`` ranges by approximate quantiles, the range that holds the middle is found from
    the ranges' sums, and only that one is ordered.
    """
    keys = list(keys)
    known = rows.where(c(x).isNotNull() & (c(w) > 0)).groupBy(*keys, c(x).alias("_x")).agg(F.sum(w).alias("_w"))
    edges = known.groupBy(*keys).agg(F.percentile_approx("_x", [i / parts for i in range(1, parts)], 1000).alias("_e"), F.sum("_w").alias("_t"))
    placed = known.join(edges, keys).withColumn("_p", F.size(F.filter("_e", lambda e: e < c("_x")))).drop("_e")
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy(*keys, "_p", "_t").agg(F.sum("_w").alias("_s")).withColumn("_b", F.coalesce(F.sum("_s").over(before), F.lit(0.0)))
    middle = ranges.where((c("_b") < 0.5 * c("_t")) & (c("_b") + c("_s") >= 0.5 * c("_t"))).select(*keys, "_p", "_b")
    run = Window.partitionBy(*keys).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    near = placed.join(middle, [*keys, "_p"]).withColumn("_c", c("_b") + F.sum("_w").over(run))
    return near.where(c("_c") >= 0.5 * c("_t")).groupBy(*keys).agg(F.min("_x").alias("weighted_median"))
