"""Folders that driver and executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


@functools.lru_cache(maxsize=1)
def _local_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="docweave-")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``; only a local session, as in tests, may leave that unset."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = _local_folder()
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def mounted(path: str) -> str:
    """The path of a shared folder for plain file calls; ValueError if it is in a store that only Spark reads."""
    bare = path.removeprefix("file:")
    if bare == path and "://" in path:
        raise ValueError(f"{path} is not a mounted folder")
    return "/" + bare.lstrip("/") if bare != path else path


def written(df: DataFrame, name: str) -> DataFrame:
    """A table written to a shared folder and read back: what is costly runs once, and outlives any executor."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    held = df.sparkSession.read.schema(df.schema).parquet(path)
    held.written_to = path
    return held


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that :func:`written` wrote, once nothing reads it any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def bound_batches(spark: SparkSession, rows: int = 64, size: int = 32 << 20) -> None:
    """Bound what one Arrow batch of files holds, by rows and by bytes."""
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if now <= 0 or now > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def store(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) of a mounted folder or of a store that Arrow knows, for tasks that write files themselves."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri("file://" + mounted(path) if path.startswith("file:") else path)
    return fs.LocalFileSystem(), path.rstrip("/")
