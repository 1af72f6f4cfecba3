"""Recognition of text in images, by exchangeable back ends. No model is part of this library."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.resource import ExecutorResourceRequests, ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave import schemas
from docweave.config import DEFAULT, EngineConfig
from docweave.operators import kernels, quality
from docweave.operators.decode import decode
from docweave.sources.images import bare_path
from docweave.sources.sinks import dump_image

#: What a recogniser gives for an image: text, confidence, box of four corners.
Found = list[tuple[str, float, list[list[float]]]]

#: What a worker's failure to start makes of each of its images.
NOT_STARTED = "ERROR: Worker non initialisé"


@dataclass(frozen=True)
class RecogniserOptions:
    """Settings for whoever makes a recogniser.

    gpu: share of a GPU that a task holds, 0 for none; cpus: cores of a task.
    """

    language: str
    side: int
    batch: int
    drop_score: float
    gpu: float
    cpus: int


# Settings on a GPU, three workers to each, and on cores.
ON_GPU = RecogniserOptions("fr", 736, 16, 0.5, 1 / 3, 1)
ON_CPU = RecogniserOptions("fr", 736, 8, 0.5, 0.0, 2)


def resource_profile(options: RecogniserOptions, executor_cores: int = 8, gpu_script: str = "") -> ResourceProfile:
    """What the recognition stage needs of executors and tasks; other stages go on with the session's own.

    gpu_script: the discovery script of the cluster. A local session cannot have any.
    """
    tasks = TaskResourceRequests().cpus(options.cpus)
    executors = ExecutorResourceRequests().cores(executor_cores)
    if options.gpu:
        tasks = tasks.resource("gpu", options.gpu)
        executors = executors.resource("gpu", 1, gpu_script)
    return ResourceProfileBuilder().require(tasks).require(executors).build


class OcrBackend(Protocol):
    """A recogniser for the one pass over the files, or a table of tokens."""

    config: EngineConfig


class TokenTableBackend:
    """Tokens that were recognised before: a table of path, ord, text, confidence, box, type."""

    def __init__(self, table: DataFrame, config: EngineConfig = DEFAULT):
        self.table, self.config = table, config

    def tokens(self, images: DataFrame) -> DataFrame:
        """The table's tokens of the images given (path), whose paths may have another scheme for local files."""
        known = images.select(F.col("path").alias("__path"), bare_path(F.col("path")).alias("__bare"))
        return self.table.join(known, bare_path(self.table["path"]) == F.col("__bare")).withColumn("path", F.col("__path")).drop("__path", "__bare")


class FunctionBackend:
    """A recogniser that each worker makes once: ``make`` gives a function from an image to what it finds.

    Images are set upright, preprocessed and shrunk first. With colour masks, keys and values are recognised apart and
    marked so. options: given to ``make``; without them it takes no argument. profile: resources of the recognition stage, see
    :func:`resource_profile`. A worker whose ``make`` fails gives error rows; with fail_fast it ends the job.
    """

    def __init__(self, make: Callable[..., Callable[[np.ndarray], Found]], config: EngineConfig = DEFAULT, options: RecogniserOptions | None = None, profile: ResourceProfile | None = None, fail_fast: bool = False):
        self.make, self.config, self.options, self.profile, self.fail_fast = make, config, options, profile, fail_fast

    def starter(self) -> Callable[[], Callable[[np.ndarray], Found]]:
        """What each worker calls once; it carries neither this object nor its profile."""
        make, options = self.make, self.options
        return make if options is None else lambda: make(options)


def tokens_of(image: np.ndarray, read: Callable[[np.ndarray], Found], config: EngineConfig) -> list[dict[str, Any]]:
    """Tokens of a preprocessed image, in the order found; keys go before values with colour masks."""
    passes = zip(("key", "value"), kernels.colour_masks(image), strict=True) if config.colour_masks else [("unknown", image)]
    out: list[dict[str, Any]] = []
    for kind, part in passes:
        for text, confidence, box in read(part) or []:
            corners = [[float(x) for x in corner] for corner in box]
            out.append({"ord": len(out), "text": None if text is None else str(text), "confidence": None if confidence is None else float(confidence), "box": corners, "type": kind})
    return out


_METRICS = [c.split()[0] for c in schemas.METRICS.split(", ")]
_SEEN = ["path", "error", *_METRICS, "read_error", "tokens"]
#: One row an image: why it could not be decoded or measured; its values; why it could not be read; its tokens, null if it was not read.
SEEN = f"path string, error string, {schemas.METRICS}, read_error string, tokens array<{schemas.TOKEN_STRUCT}>"


def see(path: str, content: bytes, read: Callable[[np.ndarray], Found] | str | None, config: EngineConfig) -> dict[str, Any]:
    """One image: decoded, measured, and if it is good enough turned upright, preprocessed and read. Any failure is part of the row.

    read: a recogniser, none, or why there is none.
    """
    out: dict[str, Any] = {"path": path}
    try:
        image = decode(content)
        out |= kernels.measure(image)
    except Exception as e:  # noqa: BLE001  one bad image must not end the batch
        return out | {"error": f"ERROR: {e}"}
    if isinstance(read, str):
        return out | {"read_error": read}
    status, sharpness, contrast = quality.judge(out, config)
    if read is None or status == "REJECTED":
        return out
    try:
        image = kernels.upright(image, kernels.orientation(content))
        image = kernels.preprocess(image, sharpness, contrast, config)
        if config.debug_dir and not config.fast_mode:
            dump_image(image, path, config.debug_dir)
        image = kernels.fit_side(image, config.ocr_max_side)
        return out | {"tokens": tokens_of(image, read, config)}
    except Exception as e:  # noqa: BLE001
        return out | {"read_error": f"ERROR: {e}"}


def see_files(files: DataFrame, backend: FunctionBackend | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """SEEN rows of files (path, content), in one pass: pixels never leave the worker that decodes them.

    Without a back end images are measured only.
    """
    start, fail_fast, profile = (backend.starter(), backend.fail_fast, backend.profile) if backend is not None else (None, False, None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read: Callable[[np.ndarray], Found] | str | None = None
        if start is not None:
            try:
                read = start()
            except Exception:
                if fail_fast:
                    raise
                read = NOT_STARTED
        for b in batches:
            rows = [see(p, bytes(c), read, config) for p, c in zip(b["path"], b["content"], strict=True)]
            yield pd.DataFrame([[r.get(c) for c in _SEEN] for r in rows], columns=_SEEN, dtype=object)

    return files.select("path", "content").mapInPandas(run, SEEN, profile=profile)


def post_process(tokens: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Tokens with common errors put right, then corrected to known phrases."""
    from docweave.functions.text import correct_keyword, fix_common_errors

    return tokens.withColumn("text", correct_keyword(fix_common_errors(F.col("text")), config.correction_score))
