"""A sink that takes a batch twice without effect: day partitions with the numbers of the batches that went into them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def current(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table at ``path``; none of its rows before the first batch."""
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not name.getFileSystem(spark._jsc.hadoopConfiguration()).exists(name):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def upsert_days(path: str, keys: Sequence[str], day: str = "day", merge: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``: puts a batch's rows into the day partitions of the table at ``path``, and rewrites no others.

    Without ``merge`` a row replaces the stored row of its ``keys``, of equal keys in a batch the last in
    order of all columns. With it, rows of equal keys from stored and new rows are merged by
    ``merge``, say into sums: then every partition remembers the last batch it has taken, and a batch
    that is replayed after a crash skips the partitions that hold it already and takes the others. A
    commit replaces partitions one by one, each by a rename; a store whose renames can be cut short needs a table format of its own.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        kinds = batch.select(*[c for c in batch.columns if c != day], day).schema
        stored_kinds = kinds.fromJson(kinds.jsonValue()).add("_batch", "long")
        stored_kinds = type(kinds)([*[f for f in stored_kinds if f.name not in (day, "_batch")], stored_kinds["_batch"], stored_kinds[day]])
        names = [f.name for f in kinds]
        batch = batch.select(*names).persist()
        try:
            old = current(spark, path, stored_kinds)
            days = batch.select(day).distinct()
            done = old.where(F.col("_batch") >= number).select(day).distinct()
            open_days = days.join(done, day, "left_anti")
            new = batch.join(open_days, day, "left_semi").select(*names)
            if new.isEmpty():
                return
            kept = old.join(open_days, day, "left_semi").select(*names)
            if merge is None:
                newest = new.groupBy(*keys, day).agg(F.max(F.struct(*names)).alias("_r")).select("_r.*")
                rows = kept.join(newest.select(*keys, day), [*keys, day], "left_anti").unionByName(newest)
            else:
                rows = merge(kept.unionByName(new)).select(*names)
            out = rows.withColumn("_batch", F.lit(number).cast("long")).select(*[f.name for f in stored_kinds])
            # the old partitions are read while new files are written beside them; only then are they replaced
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)
        finally:
            batch.unpersist()

    return put


def write_days(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], day: str = "day", merge: Callable[[DataFrame], DataFrame] | None = None) -> DataStreamWriter:
    """A writer of ``stream`` into day partitions that can be stopped and resumed at ``checkpoint``."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(upsert_days(path, keys, day, merge)).outputMode("update")


def ingest_files(spark: SparkSession, source: str, schema, path: str, checkpoint: str, keys: Sequence[str], day: str = "day", merge: Callable[[DataFrame], DataFrame] | None = None, files_at_once: int = 100, prepare: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """Take all Parquet files under ``source`` (a folder or a glob) that ``checkpoint`` hasn't seen into the day table at ``path``; how many batches that took."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(source)
    query = write_days(prepare(stream) if prepare else stream, path, checkpoint, keys, day, merge).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(1 for p in query.recentProgress if p["numInputRows"] > 0)
