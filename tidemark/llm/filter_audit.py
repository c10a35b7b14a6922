"""What filters remove in every order in which they can be applied: wide packed counters, summed once."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The counts of a step, one field each. Shapley values are sums of ``removed``.
OUTCOMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
#: A field counts rows of one part, which Spark numbers by a signed 64-bit count: it can't run over into the next.
FIELD_BITS = 64


def packed(mask: int, good: bool, toxic: bool, filters: int) -> int:
    """A row's outcomes at each step of each order, as one integer of ``FIELD_BITS`` a field.

    Fields stand in the order of ``permutations``, then steps, then ``OUTCOMES``, the first
    one lowest. Bit i of ``mask`` says that the row fails filter i.
    """
    total, at = 0, 0
    for order in permutations(range(filters)):
        alive = True
        for f in order:
            fails = bool(mask >> f & 1)
            removed = alive and fails
            for outcome in (alive and not fails, removed, fails and not alive, mask == 1 << f, removed and good, removed and toxic):
                total |= outcome << at
                at += FIELD_BITS
            alive = alive and not fails
    return total


def unpacked(total: int, filters: int) -> np.ndarray:
    """Fields of a sum of packed rows: orders x steps x outcomes."""
    orders = len(list(permutations(range(filters))))
    fields = orders * filters * len(OUTCOMES)
    return np.frombuffer(total.to_bytes(fields * FIELD_BITS // 8, "little"), "<i8").reshape(orders, filters, len(OUTCOMES))


def order_audit(counts: DataFrame, letters: str) -> DataFrame:
    """Counts of every part, order and step, from ``part``, ``mask``, ``good``, ``toxic`` and the number ``n`` of rows alike in these.

    Each kind of row is one packed integer; a part's integers, times their numbers of rows,
    are summed and the sum is unpacked. A part has at most ``4 * 2 ** len(letters)`` kinds,
    however many rows it has: that is all that reaches a task.
    """
    orders = ["".join(x) for x in permutations(letters)]
    steps = pd.DataFrame({"filter_order": np.repeat(orders, len(letters)), "step": np.tile(np.arange(1, len(letters) + 1, dtype=np.int32), len(orders))})
    letter = np.array(list("".join(orders)))

    def one_part(kinds: pd.DataFrame) -> pd.DataFrame:
        total = sum(packed(int(r.mask), bool(r.good), bool(r.toxic), len(letters)) * int(r.n) for r in kinds.itertuples())
        fields = unpacked(total, len(letters)).reshape(len(steps), len(OUTCOMES))
        out = pd.concat([steps, pd.DataFrame(fields, columns=OUTCOMES)], axis=1)
        out.insert(0, "part", kinds["part"].iat[0])
        out["shapley"] = out["removed"].groupby(letter).transform("sum")
        return out

    counted = ", ".join(f"{c} long" for c in (*OUTCOMES, "shapley"))
    return counts.groupBy("part").applyInPandas(one_part, f"part string, filter_order string, step int, {counted}")


def text_failures(text: Column, words: Column) -> dict[str, Column]:
    """Failure conditions A to D of a non-null text with these words."""
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    return {
        "A": n < 200,
        "B": 100 * distinct.cast("long") < 50 * n.cast("long"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 3 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def _mask(fails: Mapping[str, Column]) -> Column:
    mask = F.lit(0)
    for i, letter in enumerate(sorted(fails)):
        mask = mask.bitwiseOR(fails[letter].cast("int") * (1 << i))
    return mask


def audit_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Counts of filters A to E, in all 120 orders, for each value of ``part_col`` (null: the empty string).

    E, a text that stands under a smaller id too, is decided over the whole table: rows are
    counted by digest (SHA-256) and id, then by digest, and all of a digest's rows but those of its
    least id fail. However large a group of copies is, only a few counts of it leave a task.
    Labels are joined by id; of several labels of an id, one that says good or toxic
    decides. A null text is an empty one. A null id has no label, isn't smaller than any
    other and so has no smaller one. Repeated rows count each, and are not smaller than one
    another. Only the named columns are read. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", "[\t-\r ]+"), ""))
    masked = rows.select("id", "part", _mask(text_failures(text, F.col("words"))).alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))
    counted = masked.groupBy("id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.select(F.col("doc_id").alias("id"), "quality", "toxic").where(F.col("id").isNotNull()).groupBy("id")
    marks = marks.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    named = counted.where(F.col("id").isNotNull()).join(marks, "id", "left").fillna(False, ["good", "toxic"])
    kinds = named.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.min(F.struct("id", "n")).alias("first"))
    least = F.min("first.id").over(Window.partitionBy("digest"))
    kinds = kinds.withColumn("passing", F.when(F.col("first.id") == least, F.col("first.n")).otherwise(0))
    e = 1 << 4
    each = F.array(F.struct(F.col("mask"), F.col("passing").alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(e)).alias("mask"), (F.col("n") - F.col("passing")).alias("n")))
    split = kinds.select("part", "good", "toxic", F.explode(each).alias("x")).select("part", "x.mask", "good", "toxic", "x.n")
    nameless = counted.where(F.col("id").isNull()).select("part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic"), "n")
    return order_audit(split.unionByName(nameless).groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")), "ABCDE")
