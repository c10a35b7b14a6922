"""Boilerplate lines by their frequency within a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import materialize

#: A line is boilerplate if it stands on more than this share of its host's pages, and on so many at least.
MAX_RATIO = 0.05
MIN_PAGES = 5
#: Boilerplate lines, of eight bytes each, that are sent to every executor; beyond that the tables are joined by host.
BROADCAST_LINES = 500_000


def _shape(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def boilerplate_lines(docs: DataFrame, host_col: str = "source", text_col: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Per host (null: the empty host) the hashes of the lines that stand on too many of its pages.

    A page counts once per host however often its exact text recurs, so that a copied page
    isn't taken for boilerplate. Lines are compared without the white space around them;
    empty ones never count. A host has fewer than ``lines per page / max_ratio`` such lines.
    """
    lines = F.transform(F.split(F.col("_ld_text"), "\n", -1), _shape)
    pages = docs.select(F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("_ld_host"), F.col(text_col).alias("_ld_text")).where(F.col("_ld_text").isNotNull()).withColumn("_ld_page", F.xxhash64("_ld_text"))
    on_pages = (
        pages.select("_ld_host", "_ld_page", F.explode(F.array_distinct(F.transform(F.filter(lines, lambda x: x != ""), lambda x: F.xxhash64(x)))).alias("_ld_line"))
        .groupBy("_ld_host", "_ld_line")
        .agg(F.count_distinct("_ld_page").alias("_ld_n"))
        .where(F.col("_ld_n") >= min_pages)
    )
    totals = pages.groupBy("_ld_host").agg(F.count_distinct("_ld_page").alias("_ld_total"))
    return (
        on_pages.join(totals, "_ld_host")
        .where(F.col("_ld_n") > F.col("_ld_total") * F.lit(max_ratio))
        .groupBy("_ld_host")
        .agg(F.collect_list("_ld_line").alias("_ld_common"))
    )


def drop_boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with boilerplate lines gone from the text, and ``n_lines`` and ``n_dropped`` added.

    Null texts stay null with no lines; an empty text has one, empty line. Repeated rows are
    treated alike, all other columns pass unchanged, and an empty table gives no rows.
    Columns named ``n_lines`` or ``n_dropped`` are replaced.
    """
    common = materialize(boilerplate_lines(docs, host_col, text_col, max_ratio, min_pages), "boilerplate")
    if (common.agg(F.sum(F.size("_ld_common") + 1)).first()[0] or 0) <= BROADCAST_LINES:
        common = F.broadcast(common)
    lines = F.split(F.col(text_col), "\n", -1)
    kept = F.filter(F.col("_ld_lines"), lambda x: (_shape(x) == "") | ~F.array_contains(F.col("_ld_common"), F.xxhash64(_shape(x))))
    n = F.when(F.col(text_col).isNull(), 0).otherwise(F.size("_ld_lines"))
    return (
        docs.withColumn("_ld_host", F.coalesce(F.col(host_col).cast("string"), F.lit("")))
        .join(common, "_ld_host", "left")
        .withColumn("_ld_lines", lines)
        .withColumn("_ld_kept", F.when(F.col("_ld_common").isNull(), F.col("_ld_lines")).otherwise(kept))
        .withColumns({"n_lines": n.cast("long"), "n_dropped": (n - F.when(F.col(text_col).isNull(), 0).otherwise(F.size("_ld_kept"))).cast("long")})
        .withColumn(text_col, F.when(F.col(text_col).isNotNull(), F.array_join("_ld_kept", "\n")))
        .drop("_ld_host", "_ld_lines", "_ld_common", "_ld_kept")
    )
