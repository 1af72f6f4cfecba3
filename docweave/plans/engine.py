"""From images, or from recognised tokens, to one row per document: one lazy plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.config import DEFAULT, EngineConfig
from docweave.functions import dictionary as d
from docweave.operators import gates, layout, quality
from docweave.operators.extract import extract_fields, widen
from docweave.operators.matching import LabelMatcher
from docweave.operators.ocr import FunctionBackend, OcrBackend, post_process, see_files
from docweave.sources import images as image_source
from docweave.sources import shared


def extract_documents(tokens: DataFrame, config: EngineConfig = DEFAULT, post: bool = True, labels: LabelMatcher | None = None) -> DataFrame:
    """(doc_id, status, failure_code, ten fields) from tokens: one row for each document that has tokens.

    A document's tokens are brought together once, by doc_id; layout, zones and values then need no other exchange than
    by doc_id, which Spark reuses. labels: a matcher of labels in place of the configuration's own, see ``matching.matcher``.
    """
    nested = layout.nest(post_process(tokens, config) if post else tokens)
    wide = widen(extract_fields(layout.build_lines(nested, config.line_tolerance), config, labels))
    rows = nested.where(F.size("items") > 0).select("doc_id").join(wide, "doc_id", "left")  # the nested rows' exchange again, not the tokens
    columns = {f: F.col(f) for f in d.FIELDS}
    open_label = F.size(gates.labels_without_value(F.col("seen"), columns)) > 0
    status, code = gates.outcome(columns, open_label)
    return rows.select("doc_id", status.alias("status"), code.alias("failure_code"), *d.FIELDS)


class Engine:
    """Run the whole way over a folder: quality gate, recognition, extraction, one result row per image."""

    def __init__(self, spark: SparkSession, backend: OcrBackend, config: EngineConfig = DEFAULT, labels: LabelMatcher | None = None):
        self.spark, self.backend, self.config, self.labels = spark, backend, config, labels
        self.held: list[str] = []

    def release(self) -> None:
        """Delete the tables of images seen; what was made of them must be written by then."""
        while self.held:
            shared.discard(self.spark, self.held.pop())

    def see(self, files: DataFrame) -> DataFrame:
        """Files decoded, measured, judged and read in one pass, written to a shared folder: recognition runs once.

        Columns of ``ocr.SEEN``, with scores, status and reasons. An image that cannot be decoded or read has an error; all
        others go on.
        """
        shared.bound_batches(self.spark)
        backend = self.backend if isinstance(self.backend, FunctionBackend) else None
        seen = shared.written(see_files(files, backend, self.config), "seen")
        self.held.append(seen.written_to)
        return quality.combine(quality.scores(seen), self.config)

    def run(self, folder: str | Sequence[str]) -> DataFrame:
        """(image, status, failure_code, score, reasons, ten fields), successes first, then by image. folder: or a list of files."""
        rows = self.results(image_source.image_files(self.spark, folder))
        return rows.drop("path").orderBy(F.when(F.col("status") == "SUCCESS", 0).otherwise(1), "image")

    def results(self, files: DataFrame) -> DataFrame:
        """The rows of :meth:`run` with their path, in no order, from files (path, content)."""
        judged = self.see(files)
        good = gates.quality_gate(judged.where("error IS NULL AND read_error IS NULL"))
        if isinstance(self.backend, FunctionBackend):
            tokens = good.select(F.col("path").alias("doc_id"), F.explode("tokens").alias("t")).select("doc_id", "t.*")
        else:
            tokens = self.backend.tokens(good).withColumn("doc_id", F.col("path"))
        found = extract_documents(tokens, self.config, labels=self.labels).withColumnRenamed("status", "found_status")
        rows = judged.withColumn("doc_id", F.col("path")).join(found, "doc_id", "left")
        failed = F.coalesce("error", "read_error")
        passed = F.col("status").isin("ACCEPTED", "WARNING") & failed.isNull()
        status = F.when(failed.isNotNull(), failed).when(~passed, F.col("status")).otherwise(F.coalesce("found_status", F.lit("FAILED")))
        code = F.when(passed, F.when(F.col("found_status").isNull(), gates.UNCLEAR).otherwise(F.col("failure_code")))
        return gates.blank_failed(rows.select(
            "path", gates.base_name(F.col("path")).alias("image"), status.alias("status"), code.alias("failure_code"), "score", "reasons", *d.FIELDS
        ))
