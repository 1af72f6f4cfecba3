"""Documents as they arrive. Nothing here depends on other documents, so there is neither state nor watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from docweave.sources.images import is_image

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def incoming_files(spark: SparkSession, folder: str, files_at_once: int = 1000) -> DataFrame:
    """Image files that appear below a folder."""
    from pyspark.sql import functions as F

    files = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", str(files_at_once)).load(folder)
    return files.where(is_image(F.col("path")))


def incoming_tokens(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Token tables (Parquet) that appear in a folder; a document's tokens must come in one file."""
    return spark.readStream.schema(schema).parquet(folder)


def run_stream(source: DataFrame, process: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Process each batch and append its result to ``out`` as Parquet, a folder per batch so that a retry replaces it.

    once: take what is there and end; else go on until the query's ``stop()``, which ends after the batch in hand.
    """
    def each(batch: DataFrame, number: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
