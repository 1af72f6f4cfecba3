"""Helpers shared by the corpus operators."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a regular expression for Java and RE2.
WS = r"[\x20\x09-\x0D]+"

#: A key is hot when it holds more than one row in HOT_KEYS; so fewer than HOT_KEYS keys are hot, whatever the data.
HOT_KEYS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.lru_cache(maxsize=1)
def _local_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="docweave-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session, as in tests, may leave it unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _local_folder()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: short lineage that outlives any executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    held = spark.read.schema(df.schema).parquet(path)
    held.written_to = path
    return held


def discard(*written: DataFrame) -> None:
    """Delete tables that :func:`materialize` wrote, once nothing reads them any more."""
    for df in written:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def arrow_rows(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what one Arrow batch holds, by rows and by bytes; wide texts otherwise make batches of any size."""
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if now <= 0 or now > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def whole_row(df: DataFrame):
    """All columns of a row as one struct, so that no helper column can clash with them; ``.select("__row.*")`` opens it."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row")


def join_by_hot_key(rows: DataFrame, facts: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``facts`` (one row per key, ``size`` = rows of that key) without skew.

    Keys with more than ``total / HOT_KEYS`` rows are fewer than HOT_KEYS by counting, so their facts are broadcast
    under that bound and their rows stay where they are. All other rows meet in a sort-merge join, where no key
    has more than that share.
    """
    hot = facts.where(F.col(size) * HOT_KEYS > F.lit(total))
    names = [c for c in facts.columns if c != key]
    mark = F.broadcast(hot.withColumnRenamed(key, "__key"))
    at_hot = rows.join(mark, rows[key] == F.col("__key")).drop("__key")
    others = rows.join(F.broadcast(hot.select(F.col(key).alias("__key"))), rows[key] == F.col("__key"), "left_anti")
    cool = facts.where(F.col(size) * HOT_KEYS <= F.lit(total))
    return at_hot.unionByName(others.join(cool.hint("merge"), key).select(*rows.columns, *names))
