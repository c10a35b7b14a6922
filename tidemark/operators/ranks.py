"""Ranks and running sums of groups that don't fit a task: a range exchange, local sums, and shifts by the sums of the ranges before."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.storage import stored


def running_sums(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], sums: Mapping[str, Column], parts: int | None = None) -> DataFrame:
    """``rows`` with the sum of each of ``sums`` over the rows of its ``keys`` up to it in ``order``, and over all of them as ``<name>_all``.

    Rows are dealt to ``parts`` ranges of keys and order, so that a group of any size is spread over
    tasks; a window only ever sees one range of a group, and the sums of ranges, a row each,
    are what is shifted. ``order`` must tell rows apart, else rows that tie share no fixed place; columns named ``_part`` are replaced.
    """
    keys, order = list(keys), [F.col(o) if isinstance(o, str) else o for o in order]
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(rows.withColumns(dict(sums)).repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    near = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    by_range = dealt.groupBy(*keys, "_part").agg(*[F.sum(n).alias(n) for n in sums])
    shifts = by_range.select(*keys, "_part", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_{n}_shift") for n in sums], *[F.sum(n).over(whole).alias(f"{n}_all") for n in sums])
    if keys:
        # null keys are groups like others
        renamed = shifts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), *[c for c in shifts.columns if c not in (*keys, "_part")])
        same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    else:
        renamed, same = shifts.withColumnRenamed("_part", "_p"), []
    condition = F.col("_part") == F.col("_p")
    for test in same:
        condition = condition & test
    local = dealt.withColumns({f"_{n}_near": F.sum(n).over(near) for n in sums})
    joined = local.join(renamed, condition)
    columns = [c for c in rows.columns if c not in sums and c != "_part"]
    return joined.select(*columns, *[(F.col(f"_{n}_shift") + F.col(f"_{n}_near")).alias(n) for n in sums], *[F.col(f"{n}_all") for n in sums])


def row_numbers(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "rn", parts: int | None = None) -> DataFrame:
    """``rows`` with their place in ``order`` among those of their ``keys``, from 1, and the group's size as ``<name>_all``."""
    return running_sums(rows, keys, order, {name: F.lit(1).cast("long")}, parts)


def average_ranks(rows: DataFrame, keys: Sequence[str], x: str, name: str, times: Column | None = None, parts: int | None = None) -> DataFrame:
    """(keys, x, name): the mean rank that the rows of each known value share; a row stands for ``times`` rows.

    Equal values are counted before anything is ordered, so that one value may hold any share of the rows.
    """
    counted = rows.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.sum(F.lit(1).cast("long") if times is None else times).alias("_n"))
    run = running_sums(counted, keys, [x], {"_upto": F.col("_n")}, parts)
    return run.select(*keys, x, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(name))
