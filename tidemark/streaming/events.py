"""Bars over a stream of events, and means that are carried from batch to batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    """Event files as a stream; times become instants, which watermarks need."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def window_bars(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """(symbol, start, open, high, low, close, volume) by event type and window; with ``late`` a watermark closes windows. Works on streams and tables."""
    if late:
        events = events.withWatermark("ts", late)
    at = F.struct("ts", "event_id")
    bars = events.groupBy(F.col("event_type").alias("symbol"), F.window("ts", width).alias("w")).agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count(F.lit(1)).alias("volume"))
    return bars.select("symbol", F.col("w.start").alias("start"), "open", "high", "low", "close", "volume")


def running_ewma(values: DataFrame, span: int = 20) -> DataFrame:
    """(symbol, n, ewma): the exponentially weighted mean of ``values(symbol, ts, value)``, kept as state across batches."""
    alpha = 2 / (span + 1)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean = state.get if state.exists else (0, 0.0)
        for batch in batches:
            for v in batch.sort_values("ts")["value"]:
                mean = v if n == 0 else mean + alpha * (v - mean)
                n += 1
        state.update((n, float(mean)))
        yield pd.DataFrame({"symbol": [key[0]], "n": [n], "ewma": [mean]})

    return values.groupBy("symbol").applyInPandasWithState(update, "symbol string, n long, ewma double", "n long, mean double", "update", GroupStateTimeout.NoTimeout)
