"""Intermediate tables in the folder that the session names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession


#: What this process has stored, by session, input and name: the fingerprint of the input files, and the folder.
_STORED: dict[tuple[str, str, str], tuple[str, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder. Where none is set, one is made if all tasks run in this process (tests); else it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def stored_at(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back, which cuts its plan and lineage."""
    return stored_at(df, f"{shared_dir(df.sparkSession)}/tidemark-{uuid.uuid4().hex}/{name}")


def fingerprint(spark: SparkSession, source: str, tables: Sequence[str]) -> str:
    """Names, sizes and times of the files of some tables."""
    found = []
    for table in tables:
        store, place = _file_system(spark, f"{source}/{table}.parquet")
        files = store.listFiles(place, True) if store.exists(place) else None
        while files is not None and files.hasNext():
            status = files.next()
            found.append(f"{status.getPath()} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


def stored_once(spark: SparkSession, source: str, name: str, tables: Sequence[str], make: Callable[[], DataFrame]) -> DataFrame:
    """``make()`` as ``stored`` leaves it; later calls read what the first one wrote, as long as it is there and the files of ``tables`` are the same. What is out of date is deleted."""
    key = (spark.sparkContext.applicationId, source, name)
    now = fingerprint(spark, source, tables)
    seen, path = _STORED.get(key, (None, None))
    if path is not None:
        store, place = _file_system(spark, path)
        if seen == now and store.exists(spark._jvm.org.apache.hadoop.fs.Path(place, "_SUCCESS")):
            return spark.read.parquet(path)
        store.delete(place, True)
    path = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}/{name}"
    out = stored_at(make(), path)
    _STORED[key] = (now, path)
    return out
