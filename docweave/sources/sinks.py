"""Results to files."""

from __future__ import annotations

import csv
import io
import json
import os
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from docweave.operators.encode import encode
from docweave.operators.gates import blank_failed
from docweave.sources.shared import store, written

ORDER = ("image", "status", "numero_document", "nom", "prenom", "date_naissance", "lieu_naissance", "sexe", "nationalite", "adresse", "date_delivrance", "date_expiration")


def rank(status: Column) -> Column:
    """Successes first."""
    return F.when(status == "SUCCESS", 0).otherwise(1)


def result_columns(results: DataFrame) -> list[str]:
    """Columns of a result file: image and status, and fields that any success has; known ones in their order."""
    fields = [c for c in results.columns if c not in ("image", "status")]
    ok = F.col("status") == "SUCCESS"
    held = results.agg(*[F.count(F.when(ok, F.col(c))).alias(c) for c in fields]).first()
    there = {c for c in fields if held and held[c]} | {"image", "status"}
    return [c for c in ORDER if c in there] + sorted(there - set(ORDER))


def ordered(results: DataFrame) -> DataFrame:
    """Successes, then the others without their fields; each by image."""
    return blank_failed(results).orderBy(rank(F.col("status")), "image")


def union_rows(success: DataFrame, failed: DataFrame) -> DataFrame:
    """All rows of both, in no order; columns that one side lacks are null there."""
    return blank_failed(success.unionByName(failed, allowMissingColumns=True))


def union_results(success: DataFrame, failed: DataFrame) -> DataFrame:
    return ordered(success.unionByName(failed, allowMissingColumns=True))


def number_lines(rows: DataFrame, *order: Column | str, name: str = "line") -> DataFrame:
    """rows with their number, from 1, in an order; ties are broken by all columns that can be ordered, and equal rows in any way.

    Two passes and no task that sees all rows: ranges of the order are dealt out, sorted and written with each row's place in its
    range; then the ranges' counts, one number each, become offsets. Nulls come first.
    """
    ties = [F.col(f"`{f.name}`") for f in rows.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    keys = [F.col(c) if isinstance(c, str) else c for c in order] + ties
    parts = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()  # the partition's number above 33 bits, the place in it below
    held = written(parts.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("__row"), F.shiftright(at, 33).alias("__part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("__at")), "lines")
    before, offsets = 0, []
    for part, n in held.groupBy("__part").count().orderBy("__part").collect():  # a row a partition
        offsets.append((part, before))
        before += n
    known = F.broadcast(rows.sparkSession.createDataFrame(offsets, "__part long, __before long"))
    return held.join(known, "__part").select("__row.*", (F.col("__before") + F.col("__at") + 1).alias(name))


# ---------------------------------------------------------------- CSV in order


@dataclass
class Part(WriterCommitMessage):
    """What a task has written: its place in the order, the file, rows and bytes."""

    place: int
    file: str
    rows: int
    size: int


class OrderedCsvWriter(DataSourceArrowWriter):
    """Each task writes a part; the first one begins with the mark and the header. On commit, parts get names in their order."""

    def __init__(self, folder: str, names: Sequence[str], overwrite: bool):
        self.folder, self.names, self.overwrite, self.job = folder, list(names), overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        where, folder = store(self.folder)
        at = TaskContext.get()
        file = f"{folder}/_temporary-{self.job}/{at.partitionId():05d}-{at.taskAttemptId()}"
        where.create_dir(os.path.dirname(file))
        rows = size = 0
        with where.open_output_stream(file) as out:
            if at.partitionId() == 0:
                size += out.write(self._lines([self.names], "utf-8-sig"))
            for batch in iterator:
                rows += batch.num_rows
                size += out.write(self._lines(zip(*[["" if v is None else v for v in c.to_pylist()] for c in batch.columns], strict=True), "utf-8"))
        return Part(at.partitionId(), file, rows, size)

    @staticmethod
    def _lines(rows, encoding: str) -> bytes:
        out = io.StringIO(newline="")
        csv.writer(out, delimiter=";").writerows(rows)
        return out.getvalue().encode(encoding)

    def commit(self, messages: list[Part | None]) -> None:
        where, folder = store(self.folder)
        if self.overwrite:
            for f in where.get_file_info(fs.FileSelector(folder)):
                if f.base_name.startswith("part-") or f.base_name in ("_ORDER.json", "_SUCCESS"):
                    where.delete_file(f.path)
        parts = sorted((m for m in messages if m is not None and m.size), key=lambda m: m.place)
        for k, m in enumerate(parts):
            where.move(m.file, f"{folder}/part-{k:05d}.csv")
        listed = [{"file": f"part-{k:05d}.csv", "rows": m.rows, "bytes": m.size} for k, m in enumerate(parts)]
        for name, body in (("_ORDER.json", json.dumps(listed).encode()), ("_SUCCESS", b"")):
            with where.open_output_stream(f"{folder}/{name}") as out:
                out.write(body)
        where.delete_dir(f"{folder}/_temporary-{self.job}")

    def abort(self, messages: list[Part | None]) -> None:
        where, folder = store(self.folder)
        if where.get_file_info(f"{folder}/_temporary-{self.job}").type != fs.FileType.NotFound:
            where.delete_dir(f"{folder}/_temporary-{self.job}")


class OrderedCsv(DataSource):
    """``df.write.format("ordered_csv").save(folder)``: parts which, put together in their order, are one CSV file.

    Semicolons, lines ended by CR LF, quotes where needed and doubled inside, one header and one mark of UTF-8. Rows are
    taken as they are dealt out and sorted: by ranges, so that parts are in order. The folder is mounted, or in a store that
    Arrow's file systems reach. A failed job leaves what was there before.
    """

    @classmethod
    def name(cls) -> str:
        return "ordered_csv"

    def writer(self, schema, overwrite: bool) -> OrderedCsvWriter:
        return OrderedCsvWriter(self.options["path"], [f.name for f in schema.fields], overwrite)


def write_csv(results: DataFrame, path: str, rows_per_file: int = 1_000_000) -> bool:
    """Result rows in their order as :class:`OrderedCsv`, a part for so many rows; missing values are empty.

    Nothing is written without rows.
    """
    rows = results.count()
    if not rows:
        return False
    spark, names = results.sparkSession, result_columns(results)
    spark.dataSource.register(OrderedCsv)
    keys = ["__r", *dict.fromkeys(["image", *names])]
    out = blank_failed(results).select(*[F.col(c).cast("string") for c in names]).withColumn("__r", rank(F.col("status")))
    out = out.repartitionByRange(-(-rows // rows_per_file), *keys).sortWithinPartitions(*keys).select(*names)
    out.write.format("ordered_csv").mode("overwrite").save(path)
    return True


# ---------------------------------------------------------------- counts, errors, debugging


def status_counts(results: DataFrame) -> DataFrame:
    return results.groupBy(F.when(F.col("status") == "SUCCESS", "SUCCESS").otherwise("FAILED").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def observed(results: DataFrame, name: str = "results") -> tuple[DataFrame, Observation]:
    """Results that count themselves while they are written: rows and successes, without another pass."""
    seen = Observation(name)
    return results.observe(seen, F.count(F.lit(1)).alias("images"), F.count_if(F.col("status") == "SUCCESS").alias("successes")), seen


def dead_letters(results: DataFrame, path: str) -> DataFrame:
    """Append the rows of ``Engine.results`` that ended in an error to a Parquet table (path, image, error, at), and return it.

    Its paths can be given to ``Engine.run`` again.
    """
    dead = results.where(F.startswith("status", F.lit("ERROR"))).select("path", "image", F.col("status").alias("error"), F.current_timestamp().alias("at"))
    dead.write.mode("append").parquet(path)
    return results.sparkSession.read.schema(dead.schema).parquet(path)


def dump_image(image: np.ndarray, path: str, folder: str) -> str:
    """Write one image as ``{stem}_preprocessed{suffix}`` to a folder, mounted or in a store, and return the file.

    The file appears under its name when it is whole.
    """
    where, top = store(folder)
    stem, suffix = os.path.splitext(path.rsplit("/", 1)[-1])
    to = f"{top}/{stem}_preprocessed{suffix or '.png'}"
    where.create_dir(top)
    part = f"{top}/_{uuid.uuid4().hex}"
    with where.open_output_stream(part) as out:
        out.write(encode(image, suffix))
    where.move(part, to)
    return to


def dump_images(images: DataFrame, folder: str) -> DataFrame:
    """Write (path, height, width, data) as image files, see :func:`dump_image`; returns (path, file). For debugging."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(r.path, dump_image(np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3), r.path, folder)) for r in b.itertuples(index=False)]
            yield pd.DataFrame(out, columns=["path", "file"])

    return images.select("path", "height", "width", "data").mapInPandas(run, "path string, file string")


__all__ = [
    "ORDER", "OrderedCsv", "dead_letters", "dump_image", "dump_images", "number_lines", "observed", "ordered", "rank", "result_columns", "status_counts", "union_results", "union_rows", "write_csv",
]
