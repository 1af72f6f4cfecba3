"""Exact de-duplication against a persistent digest index, bucketed and sorted by digest."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import WS, join_by_hot_key, materialize, new_path, whole_row


def digest(text) -> F.Column:
    """SHA-256 (32 bytes) of a text whose runs of ASCII white space count as one space; null counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), WS, " "), 256))


class DigestIndex:
    """Digests seen so far, in runs: tables bucketed and sorted by digest, with one file a bucket.

    Columns: digest, keep_id (smallest id of the batch that brought it), n_first (rows with that id), group_size (rows
    of that batch), batch (its name). The files live in a folder that all executors share, so the index outlives the
    session: open the same ``path`` again and go on. A batch is joined with each run in turn; as a run has one sorted file a
    bucket, its side needs neither shuffle nor sort. EVERY runs of like size are merged into one, so there are few runs and
    each digest is written again a logarithmic number of times.

    A run is written aside and then renamed, so a job that fails leaves none or all of it. A batch that its caller has named can be
    given again after a failure: its own digests do not count as seen, and those already there are not appended twice. A
    batch without a name is new each time, so documents delivered again are dropped.
    """

    SCHEMA = "digest BINARY, keep_id BIGINT, n_first BIGINT, group_size BIGINT, batch STRING"
    #: Runs of like size that are merged.
    EVERY = 8

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark = spark
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")  # else the order of files is not used
        self.fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        kept = [int(n[8:]) for n in self._names(path) if n.startswith("buckets-")]  # fixed when the index is made
        self.buckets = kept[0] if kept else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.root = f"{path}/buckets-{self.buckets}"
        self.fs.mkdirs(self._path(self.root))
        self.tables: dict[str, str] = {}

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _names(self, path: str) -> list[str]:
        where = self._path(path)
        return [s.getPath().getName() for s in self.fs.listStatus(where)] if self.fs.exists(where) else []

    def runs(self) -> list[tuple[int, int]]:
        """First and last number of the batches in each run, in order; runs that were merged into a longer one do not count."""
        found = [tuple(map(int, n[4:].split("-"))) for n in self._names(self.root) if n.startswith("run-")]
        return sorted(r for r in found if not any(o != r and o[0] <= r[0] and r[1] <= o[1] for o in found))

    def _open(self, folder: str, schema: str) -> DataFrame:
        if folder not in self.tables:
            self.tables[folder] = f"digest_run_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {self.tables[folder]} ({schema}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{folder}'")
        return self.spark.table(self.tables[folder])

    def _run(self, run: tuple[int, int]) -> DataFrame:
        return self._open(f"{self.root}/run-{run[0]}-{run[1]}", self.SCHEMA)

    def deal(self, groups: DataFrame) -> DataFrame:
        """Groups of a batch, written as runs are: bucketed, and sorted in one file a bucket. All joins with runs start from there."""
        folder = new_path(self.spark, "digest-groups")
        self._write(groups, folder)
        return self._open(folder, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in groups.schema.fields))

    def table(self) -> DataFrame:
        """All digests; each is there once."""
        rows = self.spark.createDataFrame([], self.SCHEMA)
        for run in self.runs():
            rows = rows.unionByName(self._run(run))
        return rows

    def new_groups(self, groups: DataFrame, batch: str = "") -> DataFrame:
        """Dealt groups of a batch that no other batch has brought: a sort-merge anti-join with each run."""
        left = groups
        for run in self.runs():
            left = left.join(self._run(run).where(F.col("batch") != batch).select("digest").hint("merge"), "digest", "left_anti")
        return left

    def append(self, groups: DataFrame, batch: str) -> None:
        """Publish the groups of a batch as a run; those of the same batch that are there already are left as they are."""
        missing = groups
        for run in self.runs():
            missing = missing.join(self._run(run).where(F.col("batch") == batch).select("digest").hint("merge"), "digest", "left_anti")
        at = max((hi for _, hi in self.runs()), default=0) + 1
        self._publish(missing.select("digest", "keep_id", "n_first", "group_size", F.lit(batch).alias("batch")), (at, at))
        last = self.runs()[-self.EVERY :]
        while len(last) == self.EVERY and len({hi - lo for lo, hi in last}) == 1:
            rows = self.spark.read.schema(self.SCHEMA).parquet(*[f"{self.root}/run-{lo}-{hi}" for lo, hi in last])
            self._publish(rows, (last[0][0], last[-1][1]))
            for lo, hi in last:
                self.fs.delete(self._path(f"{self.root}/run-{lo}-{hi}"), True)
            last = self.runs()[-self.EVERY :]

    def _write(self, rows: DataFrame, folder: str) -> None:
        name = f"digest_aside_{uuid.uuid4().hex}"
        dealt = rows.repartition(self.buckets, "digest")
        dealt.write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option("path", folder).saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # its files stay

    def _publish(self, rows: DataFrame, run: tuple[int, int]) -> None:
        aside = f"{self.root}/_aside-{uuid.uuid4().hex}"
        self._write(rows, aside)
        if not self.fs.rename(self._path(aside), self._path(f"{self.root}/run-{run[0]}-{run[1]}")):
            raise OSError(f"run {run} of {self.root} cannot be published")


def batch_groups(digests: DataFrame) -> DataFrame:
    """Groups of a batch (doc_id, digest): digest, keep_id, n_first, group_size.

    Copies are summed by (digest, id) before the shuffle, then by digest: a hot digest costs a task one row per
    map task, not its rows.
    """
    per_id = digests.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per_id.groupBy("digest").agg(
        F.min("doc_id").alias("keep_id"),
        F.min_by("n", "doc_id").alias("n_first"),
        F.sum("n").alias("group_size"),
    ).withColumn("n_first", F.coalesce("n_first", "group_size"))


def batch_name() -> str:
    return uuid.uuid4().hex


def exact_groups(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """One row per document: doc_id, digest, keep_id, n_first, group_size, kept.

    With an index that holds digests, a document that an earlier batch has brought is not kept, and its keep_id is of
    that batch; group_size counts rows of the batch at hand. Nulls: a null text counts as empty; a null doc_id comes
    after all others and stays only if no other row has the text. Repeated rows (same doc_id, same text) are all marked
    as kept, as they are the same document; :func:`deduplicate` returns one of them. An empty table gives an empty
    result. Other columns are not read. batch: the caller's name for the batch, the same when it is tried again; see
    :class:`DigestIndex`.
    """
    digests = materialize(docs.select("doc_id", digest(F.col("text")).alias("digest")), "digests")
    if index is None:
        index = DigestIndex(docs.sparkSession, new_path(docs.sparkSession, "digest-index"))
    groups = index.deal(batch_groups(digests))
    batch = batch or batch_name()
    index.append(materialize(index.new_groups(groups, batch), "digest-fresh") if index.runs() else groups, batch)
    # an index has each digest once
    known = index.table().select("digest", F.col("keep_id").alias("__keep"), (F.col("batch") == batch).alias("fresh"))
    facts = groups.join(known.hint("merge"), "digest").select("digest", F.col("__keep").alias("keep_id"), "n_first", "group_size", "fresh")
    total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    rows = join_by_hot_key(digests, facts, "digest", "group_size", total)  # hot keys are counted in this batch
    return rows.withColumn("kept", F.col("fresh") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).drop("fresh")


def deduplicate(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """The documents that stay, whole and with all their columns; of fully repeated rows, one.

    With an index that already holds digests, documents it has seen are dropped and the others are appended; a batch of
    the same name given again returns the same rows. Null texts count as empty, a null doc_id comes last. An empty table gives
    an empty result; columns of any name pass through.
    """
    spark = docs.sparkSession
    digests = docs.select("doc_id", digest(F.col("text")).alias("digest"))
    index, batch = index or DigestIndex(spark, new_path(spark, "digest-index")), batch or batch_name()
    groups = index.deal(batch_groups(digests))
    fresh = materialize(index.new_groups(groups, batch), "digest-fresh") if index.runs() else groups
    index.append(fresh, batch)
    marked = docs.select(whole_row(docs), F.col("doc_id").alias("id"), digest(F.col("text")).alias("digest"))
    # by digest and id together: no key has more rows than one document was repeated
    keep = fresh.select(F.col("digest").alias("keep_digest"), "keep_id", "n_first").hint("merge")
    held = marked.join(keep, (F.col("digest") == F.col("keep_digest")) & F.col("id").eqNullSafe(F.col("keep_id")))
    once = held.where("n_first = 1").select("__row")
    if not fresh.where("n_first > 1").isEmpty():
        once = once.unionByName(held.where("n_first > 1").dropDuplicates(["id", "digest"]).select("__row"))
    return once.select("__row.*")


def op5(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return exact_groups(docs).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
