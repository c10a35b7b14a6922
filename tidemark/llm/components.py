"""Connected components of a link table, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import Workspace

#: Rounds after which the search gives up with an error; each at least halves the longest chain.
MAX_ROUNDS = 60


def _stars(links: DataFrame, larger: bool) -> DataFrame:
    """Link each node's larger (or smaller) neighbours, and itself, to the least node around it."""
    around = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = around.join(least, "a")
    if larger:
        return joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct()
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where(F.col("a") != F.col("b")).distinct()


def _settled(stars: DataFrame) -> bool:
    """Does every link lead from a node of its own straight to a root?"""
    ends = stars.select(F.col("a").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(stars.select(F.col("b").alias("n"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("n").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("into") > 0))).isEmpty()


def components(links: DataFrame, work: Workspace | None = None) -> DataFrame:
    """(node, component) for the nodes of ``links(a, b)``: the least node reachable.

    Alternates large stars and small stars until every node points at its root; every round is
    written to the shared folder, so a lost executor repeats one round at most, and the round
    before is dropped. Links may repeat and run either way; no links give no rows. With
    ``work`` the result is one of its tables, else it stays in the shared folder.
    """
    rounds = Workspace(links.sparkSession)
    now = rounds.keep(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "0")
    for i in range(MAX_ROUNDS):
        if _settled(now):
            found = now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
            if work is None:
                return rounds.result(found)
            out = work.keep(found, f"components-{rounds.name}")
            rounds.drop(str(i))
            return out
        now = rounds.keep(_stars(_stars(now, True), False), str(i + 1))
        rounds.drop(str(i))
    raise RuntimeError("components did not settle")
