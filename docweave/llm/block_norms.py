"""Centroid clustering with block-norm screening: norms of segments bound distances before any is computed exactly."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import arrow_rows, materialize

#: Entries stay within these bounds, so that every squared distance of up to MOST_DIMENSIONS entries fits a long.
MOST = 1 << 23
MOST_DIMENSIONS = 1 << 14
#: Segments of a vector whose norms are its compressed form.
SEGMENTS = 8
#: A bound counts only beyond this share of itself, which is far above its rounding error.
SLACK = 1e-9


def finite(vector: Column) -> Column:
    inf = F.lit(float("inf"))
    return F.coalesce(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < inf)), F.lit(False))


def whole_vectors(df: DataFrame, key: str, vector: str, length: int, scale: float) -> DataFrame:
    """(key, x): vectors of the length given, without nulls and numbers that are not finite, as whole numbers."""
    bound = F.lit(float(MOST))
    whole = lambda c: F.floor(F.greatest(-bound, F.least(bound, c * F.lit(scale)))).cast("int")
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("v")).where((F.size("v") == length) & finite(F.col("v")))
    return rows.select("key", F.transform("v", whole).alias("x"))


def cuts(length: int, segments: int = SEGMENTS) -> np.ndarray:
    """Where each segment begins: as equal as they can be."""
    return np.unique(np.arange(segments) * length // segments)


def block_norms(x: np.ndarray, segments: int = SEGMENTS) -> np.ndarray:
    """Norm of each segment of each row; squares are summed as whole numbers."""
    return np.sqrt(np.add.reduceat(x.astype(np.int64) ** 2, cuts(x.shape[1], segments), axis=1).astype(np.float64))


def compressed(rows: DataFrame, length: int, segments: int = SEGMENTS) -> DataFrame:
    """(key, x, norms), the norms of the segments computed once, for all rounds."""
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            norms = block_norms(_matrix(b, "x", length), segments)
            flat = pa.ListArray.from_arrays(np.arange(0, norms.size + 1, norms.shape[1], dtype=np.int32), norms.ravel())
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("x"), flat], ["key", "x", "norms"])

    return rows.mapInArrow(run, f"key {kind}, x array<int>, norms array<double>")


def _matrix(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def nearest(x: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance, exact distances computed) of each row; of equal distances the smaller number counts.

    By Cauchy-Schwarz, (|x_s| - |c_s|)**2 summed over the segments s is never above the squared distance. The centroid with the
    least bound is measured first; all whose bound is above that distance are pruned, the others are measured exactly.
    """
    x, c = x.astype(np.int64), centroids.astype(np.int64)
    at = np.arange(len(x))
    bounds = ((norms[:, None, :] - block_norms(c)[None, :, :]) ** 2).sum(axis=2)
    first = bounds.argmin(axis=1)
    best, distance = first.copy(), ((x - c[first]) ** 2).sum(axis=1)
    open_ = bounds * (1 - SLACK) - 1e-6 <= distance[:, None]  # equal bounds stay: a smaller number may tie
    open_[at, first] = False
    measured = len(x) + int(open_.sum())
    for k in range(len(c)):
        rows = np.flatnonzero(open_[:, k] & (bounds[:, k] * (1 - SLACK) - 1e-6 <= distance))  # it may have come nearer since
        here = ((x[rows] - c[k]) ** 2).sum(axis=1)
        wins = (here < distance[rows]) | (here == distance[rows]) & (k < best[rows])
        best[rows[wins]], distance[rows[wins]] = k, here[wins]
    return best, distance, measured


def first_centroids(rows: DataFrame, k: int, seed: int = 1) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of ``seed:key``, in that order; a null key comes last, ties are by vector."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    got = rows.select(mark.alias("mark"), "x").orderBy(F.asc_nulls_last("mark"), "x").limit(k).collect()
    return np.array([r.x for r in got], np.int64)


def step(held: DataFrame, centroids: np.ndarray, length: int) -> np.ndarray:
    """Centroids after one round: exact floors of the means; an empty cluster's stays.

    Each task sends its sums once, a row per cluster, so a cluster that holds most rows is no hot key.
    """
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, length), np.int64)
        for b in batches:
            x = _matrix(b, "x", length)
            cluster = nearest(x, _matrix(b, "norms", len(cuts(length))), centroids)[0]
            n += np.bincount(cluster, minlength=k)
            np.add.at(total, cluster, x)
        yield pa.RecordBatch.from_pydict({"cluster": np.repeat(np.arange(k, dtype=np.int32), length), "at": np.tile(np.arange(length, dtype=np.int32), k), "n": np.repeat(n, length), "total": total.ravel()})

    parts = held.select("x", "norms").mapInArrow(run, "cluster int, at int, n long, total long")
    out = centroids.copy()
    for r in parts.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).where("n > 0").collect():
        out[r.cluster, r["at"]] = int(r.total) // int(r.n)
    return out


def assign(held: DataFrame, centroids: np.ndarray, length: int) -> DataFrame:
    """(key, cluster, distance): nearest centroid of each row and the squared distance from it."""
    kind = held.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cluster, distance, _ = nearest(_matrix(b, "x", length), _matrix(b, "norms", len(cuts(length))), centroids)
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["key", "cluster", "distance"])

    return held.select("key", "x", "norms").mapInArrow(run, f"key {kind}, cluster int, distance long")


def cluster(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 16, rounds: int = 3, length: int = 64, scale: float = 64.0, seed: int = 1) -> DataFrame:
    """A row per kept vector: key, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly ``length`` entries, none null or not finite; entries become floor(scale * c), within
    2**23 in size. With fewer than k vectors there are as many clusters as vectors; repeated rows are vectors of their own. An
    empty table gives an empty result. A null key is kept and sorts last. Other columns are not read. What comes to the
    driver is of fixed size: k centroids, and k sums a dimension.
    """
    if length > MOST_DIMENSIONS:
        raise ValueError(f"at most {MOST_DIMENSIONS} entries")
    spark = df.sparkSession
    arrow_rows(spark, 4096)
    held = materialize(compressed(whole_vectors(df, key, vector, length, scale), length), "block-norms")
    centroids = first_centroids(held, k, seed)
    kind = held.schema["key"].dataType.simpleString()
    if not len(centroids):
        return spark.createDataFrame([], f"`{key}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = step(held, centroids, length)
    rows = materialize(assign(held, centroids, length), "clusters")
    spent = {r.cluster: int(r.total) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    pick = lambda values: F.get(F.array(*map(F.lit, values)), F.col("cluster"))
    return rows.select(
        F.col("key").alias(key), "cluster", "distance", pick([spent.get(c, 0) for c in range(len(centroids))]).cast("long").alias("cluster_inertia"),
        F.lit(sum(spent.values())).cast("long").alias("inertia"),
        pick([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]).alias("centroid_sha256"),
    )


def op12(spark: SparkSession, embeddings: DataFrame) -> DataFrame:
    return cluster(embeddings)


def _rounds_sql(rounds: int = 3) -> str:
    """The same with all distances, in DuckDB."""
    near = """
n{r} AS (SELECT id, x, c.k, list_sum(list_transform(range(1, 65), lambda i: (x[i] - c.c[i]) * (x[i] - c.c[i])))::BIGINT AS distance FROM v, c{r} c),
a{r} AS (SELECT id, any_value(x) AS x, arg_min(k, (distance, k)) AS k, min(distance) AS distance FROM n{r} GROUP BY id),"""
    step_ = """
s{r} AS (SELECT k, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{r}, unnest(range(1, 65)) AS u(i) GROUP BY k, i),
m{r} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{r} GROUP BY k),
c{q} AS (SELECT c{r}.k, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (k)),"""
    return "".join(near.format(r=r) + (step_.format(r=r, q=r + 1) if r < rounds else "") for r in range(rounds + 1)).rstrip(",")


OP12_SQL = f"""
WITH w AS (SELECT vec_id, list_transform(embedding, lambda e: e::DOUBLE) AS e FROM embeddings WHERE len(embedding) = 64),
v AS (SELECT row_number() OVER () AS id, vec_id, list_transform(e, lambda c: floor(64 * c)::BIGINT) AS x FROM w WHERE len(list_filter(e, lambda c: c IS NOT NULL AND isfinite(c))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS k, x AS c FROM v ORDER BY k LIMIT 16),{_rounds_sql()},
i AS (SELECT k, sum(distance)::BIGINT AS spent FROM a3 GROUP BY k)
SELECT v.vec_id, a3.k::INT AS cluster, a3.distance, i.spent AS cluster_inertia, (SELECT sum(spent)::BIGINT FROM i) AS inertia, sha256(array_to_string(c3.c, ',')) AS centroid_sha256
FROM a3 JOIN v USING (id) JOIN i ON i.k = a3.k JOIN c3 ON c3.k = a3.k
"""
