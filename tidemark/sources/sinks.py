"""Exports: date-first csv, JSON objects and matrices, columnar chart payloads, contract checks, upserts."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col


def date_first(df: DataFrame, columns: Sequence[str] | None = None, required: str | None = None) -> DataFrame:
    """ISO date first, eight decimals, rows without ``required`` left out."""
    names = [n for n in (columns or df.columns) if n != "date"]
    kept = df.na.drop(subset=[required]) if required else df
    kinds = dict(df.dtypes)
    return kept.select(F.date_format("date", "yyyy-MM-dd").alias("date"), *[F.round(c(n), 8).alias(n) if kinds[n] == "double" else c(n) for n in names])


def write_rows(df: DataFrame, path: str, kind: str) -> None:
    """Csv with header, parquet, or JSON lines."""
    out = df.write.mode("overwrite")
    if kind == "csv":
        out.csv(path, header=True)
    elif kind == "parquet":
        out.parquet(path)
    elif kind == "jsonl":
        out.json(path)
    else:
        raise ValueError(f"unknown kind {kind!r}")


def json_object(df: DataFrame, key: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, json): one JSON object of key and value for each group, keys in order. Groups are meant to be a series' days."""
    pairs = F.array_sort(F.collect_list(F.struct(c(key).cast("string").alias("k"), c(value).alias("v"))))
    return df.groupBy(*by).agg(F.to_json(F.map_from_entries(pairs)).alias("json"))


def json_matrix(df: DataFrame, columns: Sequence[str]) -> str:
    """Header and rows in date order, as one JSON text; for daily tables."""
    import json

    rows = df.select(F.date_format("date", "yyyy-MM-dd").alias("date"), *columns).orderBy("date").collect()
    return json.dumps([["date", *columns], *[list(r) for r in rows]])


def chart_payload(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(symbol, json): dates and one list for each column, eight decimals, gaps as null."""
    kept = F.struct(c("date"), *[F.when(~F.isnan(c(n)), F.round(c(n), 8)).alias(n) for n in columns])
    rows = df.groupBy("symbol").agg(F.array_sort(F.collect_list(kept)).alias("r"))
    lists = F.struct(*[c(f"r.{n}").alias(n) for n in columns])
    return rows.select("symbol", F.to_json(F.struct(F.transform("r", lambda x: F.date_format(x["date"], "yyyy-MM-dd")).alias("dates"), lists.alias("series")), {"ignoreNullFields": "false"}).alias("json"))


def column_groups(names: Sequence[str]) -> dict[str, list[str]]:
    """Dashboard groups of columns, by their names."""
    groups: dict[str, list[str]] = {"scores": [], "labels": [], "components": [], "diagnostics": []}
    for n in names:
        if n.endswith(("_score", "_prob")):
            groups["scores"].append(n)
        elif "zone" in n or "label" in n:
            groups["labels"].append(n)
        elif re.search(r"phase|analog|exhaustion", n):
            groups["components"].append(n)
        elif n not in ("date", "symbol", "open", "high", "low", "close", "volume"):
            groups["diagnostics"].append(n)
    return groups


def dashboard(bars: DataFrame, data: DataFrame) -> DataFrame:
    """Bars with whatever the dataset holds for their day."""
    own = [n for n in data.columns if n not in bars.columns or n in ("symbol", "date")]
    return bars.join(data.select(*own), ["symbol", "date"], "left")


def up_days(bars: DataFrame) -> DataFrame:
    """Volume bars with their colour flag."""
    return bars.select("symbol", "date", "volume", F.when(c("close") >= c("open"), 1).otherwise(0).alias("up"))


def upsert_amounts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Amounts by day, the sum where both hold one."""
    return old.unionByName(new).groupBy("date").agg(F.sum("amount").alias("amount"))


def contract(df: DataFrame, required: Sequence[str], forbidden: Sequence[str] = ("ret_", "max_up_", "max_down_", "touch_", "first_touch_", "future_")) -> DataFrame:
    """(check, passed): columns there, none of the forbidden prefixes, rows, dates known and unique within a symbol."""
    stats = df.groupBy("symbol", "date").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("most"), F.count_if(c("date").isNull()).alias("missing"))
    missing = [n for n in required if n not in df.columns]
    leaking = [n for n in df.columns if n.startswith(tuple(forbidden))]
    checks = {"columns": F.lit(not missing), "no_future_columns": F.lit(not leaking), "not_empty": c("rows") > 0, "dates_known": c("missing") == 0, "dates_unique": F.coalesce(c("most") == 1, F.lit(True))}
    return stats.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), v.alias("passed")) for k, v in checks.items()])).alias("x")).select("x.*")
