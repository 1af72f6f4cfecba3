"""Image lists in SQLite, read by executors: a data source that plans ranges of rows."""

from __future__ import annotations

import json
import os
import sqlite3
from collections.abc import Iterator, Sequence
from contextlib import closing
from dataclasses import dataclass
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from docweave.functions.text import strip

#: Rows of a range, and ranges of a database at most.
ROWS, MOST_RANGES = 200_000, 4096
_BATCH = 10_000
_SCHEMA = pa.schema({"database": pa.string(), "value": pa.string()})


def database_path(url: str) -> str:
    """The file of a URL: ``sqlite:///x`` and ``sqlite://x`` are x, anything else is itself."""
    return url.strip().removeprefix("sqlite:///" if url.strip().startswith("sqlite:///") else "sqlite://")


def sqlite_path(url: Column) -> Column:
    return F.regexp_replace(url, "^sqlite:///?", "")


def resolve_path(path: Column, folder: str, known: Column) -> Column:
    """Absolute as it is; relative to the database's folder if that file is known; else unchanged."""
    return F.when(F.startswith(path, F.lit("/")), path).when(known, F.concat(F.lit(folder.rstrip("/") + "/"), path)).otherwise(path)


def _open(database: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(database)}?mode=ro", uri=True)


def _name(identifier: str) -> str:
    return "`" + identifier.replace("`", "``") + "`"  # a wrong name in double quotes would be a string


@dataclass
class Span(InputPartition):
    """Rows of one database: those with low <= place < high. sql has two parameters, or none if it cannot be cut."""

    database: str
    sql: str
    bounds: tuple[int, ...]


def plan(database: str, query: str | None, table: str, column: str, rows: int = ROWS) -> list[Span]:
    """Ranges of a table's rowid, or of a query's row numbers; an empty list if there are no rows.

    A range of rowid is found by the table's own tree, so each task reads its share of the file only. A query's tasks
    all run the query, and each returns its share of the rows. What cannot be part of another query (PRAGMA) and tables
    without rowid are one range.
    """
    with closing(_open(database)) as db:
        if query is None:
            ranged = f"SELECT {_name(column)} FROM {_name(table)} WHERE rowid >= ? AND rowid < ?"
            try:
                low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_name(table)}").fetchone()
                db.execute(ranged, (0, 0))
                return _spans(database, ranged, low, high, rows)
            except sqlite3.OperationalError as e:
                if "rowid" not in str(e):
                    raise
            query = f"SELECT {_name(column)} FROM {_name(table)}"
        bare = query.strip().rstrip(";")
        first = db.execute(bare).fetchone()  # a wrong query fails here, as it stands
        if first is None:
            return []
        try:
            n = db.execute(f"SELECT count(*) FROM ({bare})").fetchone()[0]
        except sqlite3.OperationalError:
            return [Span(database, bare, ())]
        numbered = f'SELECT * FROM (SELECT q.*, row_number() OVER () AS "__place" FROM ({bare}) q) WHERE "__place" >= ? AND "__place" < ?'
        return _spans(database, numbered, 1, n, rows)


def _spans(database: str, sql: str, low: int | None, high: int | None, rows: int) -> list[Span]:
    if low is None or high is None:
        return []
    step = max(rows, -(-(high - low + 1) // MOST_RANGES))
    return [Span(database, sql, (a, min(a + step, high + 1))) for a in range(low, high + 1, step)]


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.databases = json.loads(options["databases"])
        self.query, self.table, self.column, self.rows = options.get("query"), options.get("table", "images"), options.get("column", "path"), int(options.get("rows", ROWS))

    def partitions(self) -> Sequence[InputPartition]:
        return [s for d in self.databases for s in plan(d, self.query, self.table, self.column, self.rows)] or [Span("", "", ())]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        if not partition.database:
            return
        with closing(_open(partition.database)) as db:
            cursor = db.execute(partition.sql, partition.bounds)
            while got := cursor.fetchmany(_BATCH):
                values = [None if r[0] is None else str(r[0]) for r in got]
                yield pa.RecordBatch.from_arrays([pa.array([partition.database] * len(got)), pa.array(values, pa.string())], schema=_SCHEMA)


class SqliteSource(DataSource):
    """``spark.read.format("sqlite_rows")``: (database, value), value being the first column of each row as a string.

    Options: databases (JSON list of files that all executors see), then either query, or table and column; rows (of a
    range). No database is ever read by one task as a whole, unless it has fewer rows than a range.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite_rows"

    def schema(self) -> str:
        return "database string, value string"

    def reader(self, schema) -> SqliteReader:
        return SqliteReader(self.options)


def read_sqlite(spark: SparkSession, urls: Sequence[str], query: str | None = None, table: str = "images", column: str = "path", rows: int = ROWS) -> DataFrame:
    """(database, value) of all databases. FileNotFoundError without the file, ValueError for a wrong query or no rows."""
    databases = [os.path.abspath(database_path(u)) for u in urls]
    some = False
    for d in databases:
        if not os.path.isfile(d):
            raise FileNotFoundError(f"no SQLite file: {d}")
        try:
            some = bool(plan(d, query, table, column, rows)) or some
        except sqlite3.DatabaseError as e:
            raise ValueError(f"query failed: {e}") from e
    if not some:
        raise ValueError("the query gives no rows")
    spark.dataSource.register(SqliteSource)
    options = {"databases": json.dumps(databases), "table": table, "column": column, "rows": str(rows)} | ({} if query is None else {"query": query})
    return spark.read.format("sqlite_rows").options(**options).load()


def tidy(path: Column) -> Column:
    """Without doubled slashes, ``.`` steps and a slash at the end."""
    out = F.regexp_replace(path, r"/(\.?/)+", "/")
    return F.regexp_replace(F.regexp_replace(out, r"^(\./)+", ""), r"(?<=.)/\.?$", "")


def listing_of(paths: DataFrame) -> DataFrame:
    """(path): everything in the folders of the paths given, each folder listed once, by the executors."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for folder in b["folder"]:
                try:
                    with os.scandir(folder or "/") as entries:
                        held = []
                        for e in entries:
                            if not e.is_symlink() or os.path.exists(e.path):
                                held.append(f"{folder}/{e.name}")
                            if len(held) == _BATCH:
                                yield pd.DataFrame({"path": held})
                                held = []
                        yield pd.DataFrame({"path": held}, dtype=object)
                except OSError:
                    continue

    folders = paths.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).distinct()
    return folders.mapInPandas(run, "path string")


def existing(asked: DataFrame, listing: DataFrame | None = None, here: str | None = None) -> DataFrame:
    """(path) of asked (database, value) that exist, resolved; repeats stay.

    Values are stripped, blank and null ones skipped. An absolute path counts if it is there. A relative one is looked up
    beside the database, then below ``here`` (the driver's working folder), in which case it stays as it is. listing: (path) of
    known files, for stores that are not mounted; without it the folders named are listed.
    """
    here = here or os.getcwd()
    path = strip(F.col("value"))
    rows = asked.select(F.regexp_replace("database", "/[^/]*$", "").alias("beside"), tidy(path).alias("path"), (path != "").alias("some")).where("some")
    fixed = F.startswith("path", F.lit("/"))
    rows = rows.select("path", fixed.alias("fixed"), F.when(fixed, F.col("path")).otherwise(F.concat("beside", F.lit("/"), "path")).alias("near"), F.concat(F.lit(here.rstrip("/") + "/"), "path").alias("below"))
    if listing is None:
        listing = listing_of(rows.select(F.explode(F.array("near", F.when(~F.col("fixed"), F.col("below")))).alias("path")).where("path IS NOT NULL"))
    known = listing.select(F.regexp_replace("path", "^file:/+", "/").alias("known")).distinct()
    there = rows.join(known, F.col("near") == F.col("known"), "left_semi").select(F.col("near").alias("path"))
    rest = rows.where(~F.col("fixed")).join(known, F.col("near") == F.col("known"), "left_anti")
    return there.unionByName(rest.join(known, F.col("below") == F.col("known"), "left_semi").select("path"))


def images_from_sqlite(spark: SparkSession, url: str | Sequence[str], query: str | None = None, listing: DataFrame | None = None, table: str = "images", column: str = "path") -> DataFrame:
    """(path): the first column of a query, or a column of a table, stripped, only paths that exist, by path; repeats stay.

    url: of one database or of several. See :func:`read_sqlite` and :func:`existing`. FileNotFoundError also if none of
    the files is there.
    """
    asked = read_sqlite(spark, [url] if isinstance(url, str) else url, query, table, column)
    found = existing(asked, listing).orderBy("path")
    if found.isEmpty():
        raise FileNotFoundError("none of the images is there")
    return found


def write_databases(rows: DataFrame, folder: str, column: str = "path") -> DataFrame:
    """(database): one SQLite file a task, each with a table ``images`` of its rows; the folder is mounted everywhere.

    A file gets its name when it is whole, so a task that failed and ran again leaves one.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        os.makedirs(folder, exist_ok=True)
        at = TaskContext.get()
        to = os.path.join(folder, f"part-{at.partitionId():05d}.db")
        with closing(sqlite3.connect(f"{to}.{at.taskAttemptId()}")) as db, db:
            db.execute("PRAGMA journal_mode = OFF")
            db.execute(f"CREATE TABLE images (id INTEGER PRIMARY KEY, {_name(column)} TEXT)")
            for b in batches:
                db.executemany("INSERT INTO images VALUES (NULL, ?)", ((None if v is None else v,) for v in b["path"].tolist()))
        os.replace(f"{to}.{at.taskAttemptId()}", to)
        yield pd.DataFrame({"database": [to]})

    return rows.select(F.col(column).alias("path")).mapInPandas(run, "database string")
