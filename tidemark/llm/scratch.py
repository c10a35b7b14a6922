"""Where intermediate tables go: the folder that the session names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder. Where none is set, one is made if all tasks run in this process (tests); else it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path


class Workspace:
    """Intermediate tables of one call, as Parquet in the shared folder.

    Writing cuts lineage: a lost executor costs a re-read instead of a recomputation. A table
    is dropped after its last use, and ``result`` drops all that are left.
    """

    def __init__(self, spark: SparkSession):
        self._spark, self.name, self._paths = spark, uuid.uuid4().hex, {}
        self._root = f"{shared_dir(spark)}/tidemark-{self.name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back; a table of the same name must have been dropped before."""
        if name in self._paths:
            raise ValueError(f"{name} is in use")
        path = self._paths[name] = f"{self._root}/{name}-{uuid.uuid4().hex[:8]}"
        with shuffles_dropped(self._spark):
            df.write.parquet(path)
        return self._spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self._spark._jvm.org.apache.hadoop.fs.Path(self._paths.pop(name))
            path.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(path, True)

    def result(self, df: DataFrame) -> DataFrame:
        """``df``, written; every other table goes."""
        out = self.keep(df, "result")
        del self._paths["result"]
        self.drop(*list(self._paths))
        return out


@contextmanager
def _held(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for what runs inside; the session's own comes back after."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def small_batches(spark: SparkSession, rows: int = 1000) -> AbstractContextManager[None]:
    """Python workers get at most ``rows`` long texts at once in the jobs that run inside."""
    return _held(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shuffles_dropped(spark: SparkSession) -> AbstractContextManager[None]:
    """Shuffle files of a query that runs inside go as it ends, not when the driver happens to collect its garbage."""
    return _held(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back; it stays there, as a result that is read later."""
    return Workspace(df.sparkSession).keep(df, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
