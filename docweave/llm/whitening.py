"""Embedding whitening by a compensated covariance: outer products in double-double, divide-and-conquer eigenvectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import arrow_rows, discard, materialize
from docweave.llm.double_double import add, eigen, outer_sums, two_sum

SCALE, OFFSET = 64.0, 1_000_000
#: Whole numbers are held within these bounds, so that a double has them exactly.
MOST = 2.0**52
#: Matrices of so many tasks are merged into one at a time; so many at most come to the driver.
MERGED = 64


def finite(vector: Column) -> Column:
    """Whether a vector is there and has only finite entries."""
    inf = F.lit(float("inf"))
    good = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < inf))
    return F.coalesce(vector.isNotNull() & good, F.lit(False))


def fixed(vector: Column, scale: float = SCALE, offset: int = OFFSET) -> Column:
    """Entries as whole numbers floor(scale * c) + offset; beyond 2**52 in size they stay at that bound."""
    whole = lambda c: F.floor(F.greatest(F.lit(-MOST), F.least(F.lit(MOST), c * F.lit(scale)))).cast("long") + F.lit(offset)
    return F.transform(vector, whole)


def fit_list(df: DataFrame, key: str, vector: str, scale: float = SCALE, offset: int = OFFSET) -> tuple[DataFrame, int]:
    """((key, x) as a written table, length): vectors as whole numbers, without those that :func:`fit` leaves out."""
    wide = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("v")).where(finite(F.col("v")) & (F.size("v") > 0))
    whole = materialize(wide.select("key", fixed(F.col("v"), scale, offset).alias("x")), "whole-vectors")
    length = whole.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = length.d if length else 0
    return whole.where(F.size("x") == d), d


def rows_of(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """The vectors of a batch as rows of whole numbers."""
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def sums(whole: DataFrame, d: int) -> tuple[int, list[int]]:
    """(rows, exact sum of each dimension). Halves of the numbers are summed apart, so no sum can overflow."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for b in batches:
            x = rows_of(b, d)
            n += len(x)
            high += (x >> 26).sum(axis=0)
            low += (x & (1 << 26) - 1).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"at": np.arange(d, dtype=np.int32), "n": np.full(d, n, np.int64), "high": high, "low": low})

    parts = whole.select("x").mapInArrow(run, "at int, n long, high long, low long").groupBy("at")
    got = parts.agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low")]).orderBy("at").collect()
    return (int(got[0].n) if got else 0), [(int(r.high) << 26) + int(r.low) for r in got]


def centred(x: np.ndarray, mean: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """x - mean in double-double; x and the high part of the mean are exact."""
    s, e = two_sum(x.astype(np.float64), -mean[0])
    return two_sum(s, e - mean[1])


def scatter(whole: DataFrame, d: int, size: int, values: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sum over all rows of the outer product of ``values(rows)`` (double-double, ``size`` wide) with itself.

    Each task sends one matrix, as high and low parts. Matrices are merged on the cluster, MERGED at a time, in rounds,
    until the driver can take the few that are left; the order is by task, so reruns agree.
    """
    schema = "part long, high array<double>, low array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size)), np.zeros((size, size))
        for b in batches:
            total = add(total, outer_sums(*values(rows_of(b, d))))
        yield pa.RecordBatch.from_pylist(
            [{"part": TaskContext.get().partitionId(), "high": total[0].ravel(), "low": total[1].ravel()}],
            pa.schema({"part": pa.int64(), "high": pa.list_(pa.float64()), "low": pa.list_(pa.float64())}),
        )

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part")
        total = np.zeros(size * size), np.zeros(size * size)
        for high, low in zip(group["high"], group["low"], strict=True):
            total = add(total, (high, low))
        return pd.DataFrame({"part": [group["part"].iloc[0] // MERGED], "high": [total[0]], "low": [total[1]]})

    parts = materialize(whole.select("x").mapInArrow(run, schema), "scatter")
    while parts.count() > MERGED:
        fewer = materialize(parts.groupBy(F.floor(F.col("part") / MERGED)).applyInPandas(merge, schema), "scatter")
        discard(parts)
        parts = fewer
    total = np.zeros(size * size), np.zeros(size * size)
    for r in sorted(parts.collect(), key=lambda r: r.part):
        total = add(total, (np.array(r.high), np.array(r.low)))
    discard(parts)
    return total[0].reshape(size, size), total[1].reshape(size, size)


@dataclass(frozen=True)
class Whitening:
    """A fitted transform. n, sums: rows and exact sums of the whole numbers; components: unit columns, by falling eigenvalue."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    components: np.ndarray
    trace: float
    covariance: tuple[np.ndarray, np.ndarray]

    @property
    def mean(self) -> tuple[np.ndarray, np.ndarray]:
        exact = [Fraction(s, self.n) for s in self.sums]
        high = np.array([float(m) for m in exact])
        return high, np.array([float(m - Fraction(h)) for m, h in zip(exact, high.tolist(), strict=True)])

    def project(self, x: np.ndarray) -> np.ndarray:
        """Rows of whole numbers, whitened."""
        high, low = centred(x, self.mean)
        return (high + low) @ (self.components / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int]:
        """Exact sums over the dimensions of (n * x - sum)**2."""
        base = np.array([s // self.n for s in self.sums], np.int64)
        rest = [s - self.n * b for s, b in zip(self.sums, base.tolist(), strict=True)]  # 0 <= rest < n
        near = x - base
        if (float(np.abs(near).max(initial=0)) + 1) ** 2 * float(self.n) ** 2 * len(base) < 2.0**62:
            return ((self.n * near - np.array(rest, np.int64)) ** 2).sum(axis=1).tolist()
        return [sum((self.n * v - r) ** 2 for v, r in zip(row, rest, strict=True)) for row in near.tolist()]


def fit(whole: DataFrame, d: int, most: int = 32) -> Whitening | None:
    """Fit on all rows of a :func:`fit_list`; None if there is no row or all rows are equal.

    One pass sums the dimensions exactly; a second one adds up outer products of centred rows in double-double. At most
    ``most`` components are kept, none whose eigenvalue is zero within rounding.
    """
    n, total = sums(whole, d) if d else (0, [])
    if not n:
        return None
    start = Whitening(n, tuple(total), np.ones(0), np.ones((d, 0)), 0.0, (np.zeros(0), np.zeros(0)))
    mean = start.mean
    high, low = scatter(whole, d, d, lambda x: centred(x, mean))
    values, vectors = eigen((high + low) / n)
    live = min(most, int((values > d * np.finfo(float).eps * max(values[0], 0.0)).sum())) if values[0] > 0 else 0
    if not live:
        return None
    return Whitening(n, tuple(total), values[:live], vectors[:, :live], float(np.trace(high + low) / n), (high, low))


def identity_error(whole: DataFrame, d: int, model: Whitening) -> float:
    """Largest entry, in size, of the whitened rows' covariance minus the identity, measured over all rows."""
    k = len(model.values)
    high, low = scatter(whole, d, k, lambda x: ((y := model.project(x)), np.zeros_like(y)))
    return float(np.abs((high + low) / model.n - np.eye(k)).max())


def whiten(whole: DataFrame, d: int, model: Whitening) -> DataFrame:
    """(key, deviation, whitened): a row per vector. A deviation beyond a long is null."""
    kind = whole.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = rows_of(b, d)
            y = model.project(x)
            far = pa.array([v if v < 1 << 63 else None for v in model.deviations(x)], pa.int64())
            flat = pa.ListArray.from_arrays(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32), y.ravel())
            yield pa.RecordBatch.from_arrays([b.column("key"), far, flat], ["key", "deviation", "whitened"])

    return whole.select("key", "x").mapInArrow(run, f"key {kind}, deviation long, whitened array<double>")


def whiten_table(df: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = 32, scale: float = SCALE, offset: int = OFFSET) -> DataFrame:
    """A row per kept vector and component: key, component (from 1), n, deviation, whitened, explained, identity_error.

    Left out: rows whose vector is null or empty, or holds a null or a number that is not finite; rows of another length
    than the most common one (the longer of equals), as they have no place in the same covariance. A null key is kept;
    repeated rows count each. Entries become whole numbers floor(scale * c) + offset. Components whose eigenvalue is zero within
    rounding are not returned, so an empty table, a single row, or equal rows give an empty result. Other columns are
    not read.
    """
    spark = df.sparkSession
    arrow_rows(spark, 4096)
    whole, d = fit_list(df, key, vector, scale, offset)
    model = fit(whole, d, most)
    kind = whole.schema["key"].dataType.simpleString()
    if model is None:
        return spark.createDataFrame([], f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = identity_error(whole, d, model)
    share = F.array(*[F.lit(float(v / model.trace)) for v in model.values])
    rows = whiten(whole, d, model).select("key", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        F.col("key").alias(key), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def op11(spark: SparkSession, embeddings: DataFrame) -> DataFrame:
    return whiten_table(embeddings)
