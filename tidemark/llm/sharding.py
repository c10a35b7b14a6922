"""Rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets into which each shard is dealt while its rows are numbered.
SLOT_BUCKETS = 1024


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the highest score ``-weight / ln(u)``, ``u`` a hash of key and shard in (0, 1).

    Adding a shard adds one score, so a row either stays or moves into the new shard; a
    changed weight moves only the rows that this shard gains or loses. A null key counts as
    an empty string. Ties, if any, go to the higher shard number.
    """
    name = F.coalesce(key.cast("string"), F.lit(""))

    def score(shard: int, weight: float) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(F.concat_ws("#", name, F.lit(str(shard)))), 12)
        unit = (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))  # 52 bits and a half are exact: never 0 or 1
        return F.struct((F.lit(-float(weight)) / F.ln(unit)).alias("score"), F.lit(shard).alias("shard"))

    return F.array_max(F.array(*[score(i, w) for i, w in enumerate(weights)]))["shard"]


def with_slots(rows: DataFrame, shard: str, order: Sequence[str], buckets: int = SLOT_BUCKETS) -> DataFrame:
    """Number each shard's rows gapless from 0 as ``slot``.

    A shard may hold any share of the table, so it isn't numbered by one window: its rows are
    dealt to ``buckets`` by a hash of ``order``, numbered in each bucket, and shifted by the
    sizes of the buckets before. The table of sizes has ``buckets`` rows a shard at most.
    """
    spread = rows.withColumn("_sl_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = spread.groupBy(shard, "_sl_bucket").agg(F.count(F.lit(1)).alias("_sl_n"))
    before = Window.partitionBy(shard).orderBy("_sl_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(shard, "_sl_bucket", F.coalesce(F.sum("_sl_n").over(before), F.lit(0)).alias("_sl_shift"))
    place = Window.partitionBy(shard, "_sl_bucket").orderBy(*order)
    return (
        spread.withColumn("_sl_row", F.row_number().over(place) - 1)
        .join(F.broadcast(shifts), [shard, "_sl_bucket"])
        .withColumn("slot", F.col("_sl_shift") + F.col("_sl_row"))
        .drop("_sl_bucket", "_sl_row", "_sl_shift")
    )


def shard_documents(docs: DataFrame, weights: Sequence[float], grown: Sequence[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Place documents by key: ``shard`` under ``weights``, ``grown_shard`` under ``grown``.

    Size is the text's UTF-8 bytes plus one; a null text has no bytes and the checksum of
    none. Only the key and the shards decide, so repeated rows of a key share a shard and
    take different slots; a null key counts as an empty one. Other columns aren't read. An
    empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.col(id_col)
    placed = docs.select(
        key.cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous_shard(key, weights).alias("shard"),
        rendezvous_shard(key, grown).alias("grown_shard"),
    )
    return with_slots(placed, "shard", ["doc_id", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
