"""Aggregates over a ledger of blocks, transactions and outputs, and the daily features made of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import last_rows, series

# Names of the eight amount buckets, in bitcoin, and their upper bounds.
BUCKETS = ("b0_lt_0_001", "b1_lt_0_01", "b2_lt_0_1", "b3_lt_1", "b4_lt_10", "b5_lt_100", "b6_lt_1000", "b7_rest")
BOUNDS = (0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0)
Z_WINDOW = 365


def unique_rows(blocks: DataFrame, txs: DataFrame, outs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables with one row for each primary key.

    Of outputs that differ in their amounts, the first one stays in the order of a column ``place``, amounts that are
    missing last. Without such a column equal keys must have equal amounts.
    """
    if "place" in outs.columns:
        # min_by skips rows without an order
        first = outs.groupBy("tx_hash", "count").agg(F.min_by("amount", F.when(F.col("amount").isNotNull(), F.col("place"))).alias("amount"))
    else:
        first = outs.dropDuplicates(["tx_hash", "count"])
    return blocks.dropDuplicates(["hash"]), txs.dropDuplicates(["hash"]), first


def doubled_blocks(blocks: DataFrame) -> DataFrame:
    """(hash, files): blocks that more than one source file holds."""
    return blocks.groupBy("hash").agg(F.count_distinct("file").alias("files")).where(F.col("files") > 1)


def amounts_by_period(blocks: DataFrame, txs: DataFrame, outs: DataFrame, unit: str = "day", start=None, end=None) -> DataFrame:
    """(period, amount): sum of outputs by UTC hour, day, week, month or year of their block."""
    if start is not None:
        blocks = blocks.where(F.col("time").between(start, end))
    joined = outs.join(txs.select(F.col("hash").alias("tx_hash"), "block_hash"), "tx_hash").join(blocks.select(F.col("hash").alias("block_hash"), "time"), "block_hash")
    return joined.groupBy(F.date_trunc(unit, "time").alias("period")).agg(F.sum("amount").alias("amount"))


def tx_totals(blocks: DataFrame, txs: DataFrame, outs: DataFrame) -> DataFrame:
    """(tx_hash, time, amount): each transaction's summed outputs."""
    totals = outs.groupBy("tx_hash").agg(F.sum("amount").alias("amount"))
    return totals.join(txs.select(F.col("hash").alias("tx_hash"), "block_hash"), "tx_hash").join(blocks.select(F.col("hash").alias("block_hash"), "time"), "block_hash").select("tx_hash", "time", "amount")


def bucket_counts(totals: DataFrame, bounds: Sequence[float] = BOUNDS, names: Sequence[str] = BUCKETS) -> DataFrame:
    """Per UTC day the number of transactions in each amount bucket, lower bound included."""
    edges = [None, *bounds, None]

    def inside(low: float | None, high: float | None) -> Column:
        above = F.lit(True) if low is None else F.col("amount") >= low
        return above if high is None else above & (F.col("amount") < high)

    return totals.groupBy(F.to_date("time").alias("date")).agg(*[F.count_if(inside(a, b)).alias(n) for n, a, b in zip(names, edges, edges[1:], strict=False)])


def merge_days(old: DataFrame, new: DataFrame) -> DataFrame:
    """Days of both, the new ones in place of equal old ones, so that a slice may be loaded twice."""
    return old.join(new.select("date"), "date", "left_anti").unionByName(new)


def rolling_z(x: Column, n: int = Z_WINDOW) -> Column:
    """Sample z-score within the last ``n`` rows, of which ``max(10, n / 5)`` must hold a value; 0 without spread."""
    w = last_rows(n)
    sd = F.stddev_samp(x).over(w)
    known = (F.row_number().over(series()) >= n) & (F.count(x).over(w) >= max(10, n // 5))
    return F.when(known, F.when(F.coalesce(sd, F.lit(0.0)) == 0, 0.0).otherwise((x - F.avg(x).over(w)) / sd))


def change_from_last(x: Column) -> Column:
    """Relative change from the last value there was; null after 0."""
    before = F.last(x, ignorenulls=True).over(series().rowsBetween(-(1 << 31) + 1, -1))
    return F.when(before != 0, x / before - 1)


def chain_features(amounts: DataFrame, counts: DataFrame, names: Sequence[str] = BUCKETS, two_largest: bool = False, window: int = Z_WINDOW) -> DataFrame:
    """Thirteen daily columns from ``amounts(symbol, date, amount)`` and ``counts(symbol, date, buckets)``; days of either table."""
    both = amounts.join(counts, ["symbol", "date"], "full_outer")
    last, second, third = (F.col(n).cast("double") for n in (names[-1], names[-2], names[-3]))
    rest = sum((F.col(n).cast("double") for n in names[: -3 if two_largest else -2]), F.lit(0.0))
    x = both.withColumns({"ONCHAIN_AMOUNT_TOTAL": F.col("amount"), "ONCHAIN_TX_WHALE": last + second if two_largest else last, "ONCHAIN_TX_MID": third if two_largest else second, "ONCHAIN_TX_SMALL": rest})
    whale, mid, small = F.col("ONCHAIN_TX_WHALE"), F.col("ONCHAIN_TX_MID"), F.col("ONCHAIN_TX_SMALL")
    log = lambda c: F.when(c > 0, F.ln(F.greatest(c, F.lit(1e-12))))
    x = x.withColumns({"ONCHAIN_AMOUNT_LOG": log(F.col("amount")), "ONCHAIN_WHALE_SHARE": F.when(whale + mid + small > 0, whale / (whale + mid + small)), "ONCHAIN_DOMINANCE": F.when(small > 0, (whale + mid) / small)})
    x = x.withColumn("dom_log", log(F.col("ONCHAIN_DOMINANCE")))
    return x.select(
        "symbol", "date", "ONCHAIN_AMOUNT_TOTAL", "ONCHAIN_AMOUNT_LOG", "ONCHAIN_TX_WHALE", "ONCHAIN_TX_MID", "ONCHAIN_TX_SMALL", "ONCHAIN_WHALE_SHARE", "ONCHAIN_DOMINANCE",
        rolling_z(F.col("ONCHAIN_AMOUNT_LOG"), window).alias("ONCHAIN_VOL_Z"), rolling_z(F.col("dom_log"), window).alias("ONCHAIN_DOM_Z"), rolling_z(F.col("ONCHAIN_WHALE_SHARE"), window).alias("ONCHAIN_WHALE_SHARE_Z"),
        change_from_last(F.col("ONCHAIN_AMOUNT_TOTAL")).alias("ONCHAIN_AMOUNT_PCT"), change_from_last(whale).alias("ONCHAIN_WHALE_TX_PCT"), change_from_last(F.col("ONCHAIN_DOMINANCE")).alias("ONCHAIN_DOM_PCT"),
    )
