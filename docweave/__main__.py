"""Command line: results of a folder of document images as CSV, with a summary.

    python -m docweave --folder /scans --tokens /tokens.parquet --out /results
    python -m docweave --folder /scans --recogniser my_ocr:make --cpu --fast --out /results
    spark-submit --py-files docweave.zip docweave/__main__.py --folder ...
"""

from __future__ import annotations

import argparse
import importlib
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.config import EngineConfig
from docweave.operators.ocr import ON_CPU, ON_GPU, FunctionBackend, TokenTableBackend, resource_profile
from docweave.plans.engine import Engine, extract_documents
from docweave.sources.images import image_files
from docweave.sources.sinks import dead_letters, observed, write_csv


def arguments(argv: Sequence[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser("docweave", description="Fields of document images, or of tokens that were recognised in them.")
    parser.add_argument("--folder", help="folder of images; without it only the tokens are read")
    parser.add_argument("--tokens", help="Parquet table of recognised tokens: path, ord, text, confidence, box, type (doc_id in place of path without --folder)")
    parser.add_argument("--recogniser", help="module:function that makes a recogniser in each worker, in place of --tokens; it is given RecogniserOptions")
    parser.add_argument("--out", required=True, help="folder for the CSV parts")
    parser.add_argument("--dead-letters", help="folder for a table of the images that ended in an error")
    parser.add_argument("--workers", type=int, help="threads of a local session; a cluster's own settings hold otherwise")
    parser.add_argument("--cpu", action="store_true", help="recognise on cores rather than on a GPU")
    parser.add_argument("--fast", action="store_true", help="recognise images as they are, without preprocessing")
    parser.add_argument("--rows-per-file", type=int, default=1_000_000, help="rows of a CSV part at most, about")
    parser.add_argument("--show", type=int, default=5, help="rows of the result to print")
    return parser.parse_args(argv)


def summary(results: DataFrame, images: int, successes: int, seconds: float, show: int) -> str:
    """Counts, seconds in all and an image, and the first rows."""
    lines = [
        f"images: {images}", f"successes: {successes}", f"failures: {images - successes}",
        f"seconds: {seconds:.1f} in all, {seconds / max(1, images):.3f} an image",
    ]
    for row in results.orderBy(F.when(F.col("status") == "SUCCESS", 0).otherwise(1), "image").limit(show).collect():
        lines.append("  " + "; ".join(f"{k}={v}" for k, v in row.asDict().items() if v is not None))
    return "\n".join(lines)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> str:
    args = arguments(argv)
    if spark is None:
        builder = SparkSession.builder.appName("docweave")
        spark = (builder.master(f"local[{args.workers}]") if args.workers else builder).getOrCreate()
    if bool(args.tokens) == bool(args.recogniser) or args.recogniser and not args.folder:
        raise SystemExit("give --tokens, or --recogniser with --folder")
    began = time.perf_counter()
    config = EngineConfig(fast_mode=args.fast)
    if args.recogniser:
        module, name = args.recogniser.split(":")
        options = ON_CPU if args.cpu else ON_GPU
        local = spark.sparkContext.master.startswith("local")
        backend = FunctionBackend(getattr(importlib.import_module(module), name), config, options, None if local else resource_profile(options))
        results = Engine(spark, backend, config).results(image_files(spark, args.folder))
    elif args.folder:
        results = Engine(spark, TokenTableBackend(spark.read.parquet(args.tokens), config), config).results(image_files(spark, args.folder))
    else:
        rows = extract_documents(spark.read.parquet(args.tokens), config)
        results = rows.withColumn("image", F.col("doc_id").cast("string")).withColumnRenamed("doc_id", "path")
    if args.dead_letters:
        dead_letters(results, args.dead_letters)
    results = results.drop("path", "score", "reasons")
    results, seen = observed(results.drop("failure_code"))
    results = results.persist()
    try:
        results.write.format("noop").mode("overwrite").save()
        write_csv(results, args.out, args.rows_per_file)
        said = summary(results, seen.get["images"], seen.get["successes"], time.perf_counter() - began, args.show)
    finally:
        results.unpersist()
    print(said)
    return said


if __name__ == "__main__":
    main()
