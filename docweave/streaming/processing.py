"""A folder worked through slice by slice: results appear as they are done, work can be stopped and taken up again."""

from __future__ import annotations

import contextlib
import threading
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from docweave.plans.engine import Engine
from docweave.sources.sinks import observed
from docweave.streaming.incoming import incoming_files


@contextlib.contextmanager
def tagged(spark: SparkSession, tag: str) -> Iterator[None]:
    """Jobs started inside, by this thread, carry a tag, by which :func:`interrupt` ends them and no others."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag)


def interrupt(spark: SparkSession, tag: str) -> None:
    spark.sparkContext.cancelJobsWithTag(tag)


@dataclass
class Progress:
    """What is done so far. slices, images, successes: published ones; files: handed to slices, by the query's own reports."""

    slices: int = 0
    images: int = 0
    successes: int = 0
    files: int = 0
    seconds: float = 0.0
    state: str = "new"
    error: str | None = None
    lock: threading.Lock = field(default_factory=threading.Lock, repr=False)


class _Reports(StreamingQueryListener):
    """Reports of one query, by its name: rows taken, time spent, end."""

    def __init__(self, name: str, progress: Progress):
        self.name, self.progress = name, progress

    def onQueryStarted(self, event) -> None:  # noqa: N802
        if event.name == self.name:
            self.progress.state = "running"

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if p.name == self.name:
            with self.progress.lock:
                self.progress.files += p.numInputRows
                self.progress.seconds += p.batchDuration / 1000

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


class Processing:
    """Process the images below a folder, ``files`` at a time, into ``out``: Parquet, a folder per slice.

    A slice's folder gets its name when its rows are whole, so readers never see half of one. What is done is known by
    the checkpoint beside it: another ``Processing`` with the same ``out`` goes on where one was stopped or failed.
    """

    def __init__(self, engine: Engine, folder: str, out: str, files: int = 200, on_slice: Callable[[Progress], None] | None = None):
        self.engine, self.folder, self.out, self.files, self.on_slice = engine, folder, out.rstrip("/"), files, on_slice
        self.spark, self.tag, self.progress = engine.spark, f"docweave-{uuid.uuid4().hex}", Progress()
        self.query: StreamingQuery | None = None
        self.stopping = False
        self.reports = _Reports(self.tag, self.progress)

    def start(self, once: bool = True) -> Processing:
        """Begin in the background. once: take what is there and end; else wait for more until :meth:`stop`."""
        self.spark.streams.addListener(self.reports)
        writer = incoming_files(self.spark, self.folder, self.files).writeStream.queryName(self.tag).foreachBatch(self._slice)
        writer = writer.option("checkpointLocation", f"{self.out}/_checkpoint")
        self.query = (writer.trigger(availableNow=True) if once else writer).start()
        return self

    def _slice(self, batch: DataFrame, number: int) -> None:
        if self.stopping:
            raise InterruptedError("stopped")
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        part, whole = path(f"{self.out}/_part-{uuid.uuid4().hex}"), path(f"{self.out}/slice={number}")
        fs = part.getFileSystem(self.spark._jsc.hadoopConfiguration())
        try:
            with tagged(self.spark, self.tag):
                results, seen = observed(self.engine.results(batch.select("path", "content")))
                results.write.parquet(part.toString())
                count = seen.get
            fs.delete(whole, True)  # of a try that failed after publishing
            fs.rename(part, whole)
        finally:
            fs.delete(part, True)
            self.engine.release()
        with self.progress.lock:
            self.progress.slices += 1
            self.progress.images += count["images"]
            self.progress.successes += count["successes"]
        if self.on_slice:
            self.on_slice(self.progress)

    def stop(self, now: bool = False) -> None:
        """End after the slice at hand, or now: its jobs are interrupted by their tag. What is published stays."""
        self.stopping = True
        if now:
            interrupt(self.spark, self.tag)

    def wait(self, seconds: float | None = None) -> Progress:
        """Until the end, or so long. The state is then done, stopped, failed (with the error) or running."""
        try:
            over = self.query.awaitTermination(seconds) if seconds else self.query.awaitTermination() or True
            self.progress.state = "running" if not over else "stopped" if self.stopping else "done"
        except Exception as e:  # noqa: BLE001  the query's own error, which a stop causes too
            self.progress.state = "stopped" if self.stopping else "failed"
            self.progress.error = None if self.stopping else str(e)
            over = True
        if over:
            self.spark.streams.removeListener(self.reports)
        return self.progress

    def results(self) -> DataFrame:
        """All published rows."""
        return self.spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*.parquet").parquet(f"{self.out}/slice=*")
