"""Images from folders; lists in SQLite are in :mod:`docweave.sources.sqlite`."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators import kernels
from docweave.sources.sqlite import images_from_sqlite, resolve_path, sqlite_path

SUFFIX = r"(?i)\.(jpe?g|png|bmp|tiff?|gif)$"


def is_image(path: Column) -> Column:
    return path.rlike(SUFFIX)


def _require(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path) or not fs.getFileStatus(path).isDirectory():
        raise FileNotFoundError(folder)


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of all image files below a folder, by path. FileNotFoundError if the folder is not there."""
    _require(spark, folder)
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(is_image(F.col("path"))).select("path", "length").orderBy("path")


def image_files(spark: SparkSession, folder: str | Sequence[str]) -> DataFrame:
    """(path, content) of all image files below a folder, or of the files named, not decoded."""
    if isinstance(folder, str):
        _require(spark, folder)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder if isinstance(folder, str) else list(folder))
    return files.where(is_image(F.col("path"))).select("path", "content")


def bare_path(path: Column) -> Column:
    """A local path without its scheme, as readers differ in how they write that."""
    return F.regexp_replace(path, "^file:/+", "/")


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, height, width, channels, data, orientation, error): pixels as stored, blue, green, red.

    Files that cannot be decoded stay, with an error. The orientation of photos is given, not applied; see ``upright``.
    """
    _require(spark, folder)
    rows = spark.read.format("image").option("recursiveFileLookup", "true").load(folder).select("image.*").withColumnRenamed("origin", "path")
    rows = rows.where(is_image(F.col("path")))
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(F.col("path").rlike(r"(?i)\.jpe?g$"))

    @F.pandas_udf("int")
    def turn(content: pd.Series) -> pd.Series:
        return content.map(lambda b: kernels.orientation(bytes(b)))

    turns = raw.select(F.regexp_replace("path", "^file:/+", "/").alias("__p"), turn("content").alias("orientation"))
    out = rows.join(turns, F.regexp_replace(rows["path"], "^file:/+", "/") == F.col("__p"), "left").drop("__p")
    bad = F.col("height") < 1
    return out.select(
        "path", "height", "width", F.col("nChannels").alias("channels"), "data", F.coalesce("orientation", F.lit(1)).alias("orientation"),
        F.when(bad, F.lit("ERROR: cannot identify image file")).alias("error"),
    )


def pixels(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """Height x width x 3 bytes; gray images are repeated, transparency is left out."""
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(x, 3, axis=2) if channels == 1 else x[..., :3]


def measure(images: DataFrame) -> DataFrame:
    """(path, error, width, ... brightness): measured values of images, one image at a time; a failure is a row."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                out = {"path": r.path, "error": r.error}
                if not isinstance(r.error, str):
                    out["error"] = None
                    try:
                        out |= kernels.measure(pixels(r.height, r.width, r.channels, r.data))
                    except Exception as e:  # noqa: BLE001  one bad image must not end the batch
                        out["error"] = f"ERROR: {e}"
                rows.append(out)
            yield pd.DataFrame(rows).reindex(columns=names)

    names = ["path", "error", "width", "height", "sharpness", "contrast", "eta", "char_height", "density", "reflection", "brightness"]
    schema = "path string, error string, width int, height int, sharpness double, contrast double, eta double, char_height double, density double, reflection double, brightness double"
    return images.select("path", "height", "width", "channels", "data", "error").mapInPandas(run, schema)


__all__ = ["SUFFIX", "bare_path", "image_files", "images_from_sqlite", "is_image", "list_images", "measure", "pixels", "read_images", "resolve_path", "sqlite_path"]
