"""Daily OHLCV bars, from ticks or from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAR_SCHEMA = T.StructType([T.StructField("timestamp", T.StringType())] + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def placed_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with ``place``, a number that grows with the files' names and, in a file, with the rows. A file holds up to 2^40 rows."""
    rows = table(spark, sf_dir, name).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    # one row a file
    files = rows.select("_file").distinct().withColumn("_number", F.row_number().over(Window.orderBy("_file")).cast("long"))
    placed = rows.join(F.broadcast(files), "_file")
    return placed.withColumn("place", F.shiftleft("_number", 40) + F.col("_row")).drop("_file", "_row", "_number")


def index_ticks(values: DataFrame, step: float = 0.01) -> DataFrame:
    """(symbol, date, key, px): a price index from ``values(symbol, date, key, v)``.

    Each value moves its symbol's log price by its z-score times ``step``. The running sum
    is taken within days, plus the totals of the days before, so that the window over all of
    a symbol's days sees one row a day.
    """
    stats = values.groupBy("symbol").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
    moves = values.join(F.broadcast(stats), "symbol").withColumn("move", (F.col("v") - F.col("mean")) / F.col("sd") * step)
    days = moves.groupBy("symbol", "date").agg(F.sum("move").alias("total"))
    before = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    prior = days.select("symbol", "date", F.coalesce(F.sum("total").over(before), F.lit(0.0)).alias("prior"))
    inside = Window.partitionBy("symbol", "date").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    return moves.withColumn("inner", F.sum("move").over(inside)).join(prior, ["symbol", "date"]).select("symbol", "date", "key", F.round(F.exp(F.col("prior") + F.col("inner")) * 100, 4).alias("px"))


def bars_of_ticks(ticks: DataFrame) -> DataFrame:
    """(symbol, date, open, high, low, close, volume) of ``ticks(symbol, date, key, px)``; volume counts ticks."""
    return ticks.groupBy("symbol", "date").agg(
        F.min_by("px", "key").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "key").alias("close"), F.count(F.lit(1)).cast("double").alias("volume")
    )


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of an index over order totals, one series for each order priority."""
    orders = table(spark, sf_dir, "orders")
    values = orders.select(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("date"), F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("v"))
    return bars_of_ticks(index_ticks(values))


def read_bars_json(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """Bars of a JSON array of objects; a malformed row fails the read."""
    rows = spark.read.schema(BAR_SCHEMA).json(path, multiLine=True, mode="FAILFAST")
    return rows.select(F.lit(symbol).alias("symbol"), F.to_date("timestamp", "yyyy-MM-dd").alias("date"), "open", "high", "low", "close", "volume")


def read_rows(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Csv with header, parquet, or JSON lines."""
    if kind == "csv":
        return spark.read.csv(path, header=True, inferSchema=True)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "jsonl":
        return spark.read.json(path)
    raise ValueError(f"unknown kind {kind!r}")


def read_features(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A feature csv: ISO dates, all other columns numbers. A date that is none, or one that repeats, fails the query; a cell that is no number is missing.

    The schema comes from the header alone, so the data is read once.
    """
    names = spark.read.csv(path, header=True).columns
    if "date" not in names or (lacking := [n for n in columns or () if n not in names]):
        raise ValueError(f"the file lacks {'date' if 'date' not in names else lacking}")
    rows = spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).csv(path, header=True)
    date = F.try_to_date("date", "yyyy-MM-dd")
    kept = [n for n in columns or names if n != "date"]
    typed = rows.select(F.when(date.isNotNull(), date).otherwise(F.raise_error(F.concat(F.lit("no date: "), F.coalesce("date", F.lit("null")))).cast("date")).alias("date"), *[F.col(n).try_cast("double").alias(n) for n in kept])
    times = F.count(F.lit(1)).over(Window.partitionBy("date"))
    return typed.withColumn("_n", times).where(F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.concat(F.lit("repeated date: "), F.col("date").cast("string"))).cast("boolean"))).drop("_n")


def read_day_values(spark: SparkSession, path: str) -> DataFrame:
    """(date, value) of a JSON object of numbers by date; entries that are no numbers are left out."""
    text = spark.read.text(path, wholetext=True)
    pairs = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("date", "v"))
    return pairs.select(F.try_to_date("date", "yyyy-MM-dd").alias("date"), F.expr("try_cast(v AS double)").alias("value")).where(F.col("date").isNotNull() & F.col("value").isNotNull())


def read_day_rows(spark: SparkSession, path: str) -> DataFrame:
    """(date, counts) of a JSON array of rows; the header and rows that hold anything but numbers are left out."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", "array<array<string>>")).alias("r")).where(F.size("r") >= 2)
    numbers = F.transform(F.slice("r", 2, F.size("r") - 1), lambda x: x.try_cast("double"))
    return rows.select(F.try_to_date(F.col("r")[0], "yyyy-MM-dd").alias("date"), numbers.alias("counts")).where(F.col("date").isNotNull() & F.forall("counts", lambda x: x.isNotNull()))


def violations(bars: DataFrame) -> DataFrame:
    """(rule, n, first): how many bars break each rule of a valid series, and the first date."""
    good = {
        "price_not_positive_finite": F.forall(F.array("open", "high", "low", "close"), lambda x: x.isNotNull() & ~F.isnan(x) & (x > 0) & (x < float("inf"))),
        "volume_not_finite": F.col("volume").isNotNull() & ~F.isnan("volume") & (F.col("volume") >= 0) & (F.col("volume") < float("inf")),
        "high_below_low": F.col("high") >= F.col("low"),
        "high_below_body": F.col("high") >= F.greatest("open", "close"),
        "low_above_body": F.col("low") <= F.least("open", "close"),
        "date_missing": F.col("date").isNotNull(),
        "date_repeated": F.count(F.lit(1)).over(Window.partitionBy("symbol", "date")) == 1,
    }
    flags = bars.select("date", *[(~F.coalesce(ok, F.lit(False))).alias(rule) for rule, ok in good.items()])
    pairs = flags.select("date", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("broken")) for r in good])).alias("x")).select("date", "x.*")
    return pairs.groupBy("rule").agg(F.count_if("broken").alias("n"), F.min(F.when(F.col("broken"), F.col("date"))).alias("first"))


def checked(bars: DataFrame) -> DataFrame:
    """``bars``, or an error that names the rules it breaks."""
    broken = violations(bars).where(F.col("n") > 0).orderBy("rule").collect()
    if broken or bars.isEmpty():
        raise ValueError("; ".join(f"{r['rule']}: {r['n']} from {r['first']}" for r in broken) or "no bars")
    return bars


def append_tail(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old bars before the first new date of their symbol, then the new ones."""
    first = new.groupBy("symbol").agg(F.min("date").alias("_first"))
    kept = old.join(F.broadcast(first), "symbol", "left").where(F.col("_first").isNull() | (F.col("date") < F.col("_first"))).drop("_first")
    return kept.unionByName(new)
