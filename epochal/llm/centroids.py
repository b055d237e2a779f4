"""Clustering by centroids with annulus search.

Centroids are sorted by norm.  A vector's distance to the centroid nearest in norm bounds its distance to the nearest one,
and by the triangle inequality a centroid whose norm differs by more than that bound is farther.  Two binary searches
give the centroids in that annulus (its radii rounded outwards, so that ties at the boundary stay in); their distances
are compared exactly, in integers, ties going to the smaller number.

Vectors are turned into integers and written once, narrow; every round is one scan of that table.  A task sends one row
of counts and sums, which are added up on executors; only centroids (``k`` vectors) are kept by the driver and broadcast.

Vectors that are null, of another length than ``length``, or with null or non-finite components are left out; components of 2^27
or more in size (after scaling) are an error.  A null id counts as an empty one where a centroid is chosen.  Repeated
ids and rows each count; equal ids are told apart by their vectors.  With fewer than ``k`` vectors there are as many
centroids.  An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialise
from .vectors import array_of, grouped, matrix, means, totals, whole


class Annuli:
    """Centroids in order of norm."""

    def __init__(self, centroids: np.ndarray):
        squares = (centroids * centroids).sum(1)
        self.number = np.lexsort((np.arange(len(centroids)), squares))
        self.centroids = centroids[self.number]
        self.norms = np.sqrt(squares[self.number].astype(float))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest centroid of each row."""
        norm = np.sqrt((x * x).sum(1).astype(float))
        right = np.searchsorted(self.norms, norm).clip(0, len(self.norms) - 1)
        left = (right - 1).clip(0)
        first = np.where(np.abs(self.norms[left] - norm) < np.abs(self.norms[right] - norm), left, right)
        gap = x - self.centroids[first]
        best = np.einsum("ij,ij->i", gap, gap)
        cluster = self.number[first]
        bound = np.sqrt(best.astype(float))
        slack = 1e-9 * (1 + norm + bound)
        low = np.searchsorted(self.norms, norm - bound - slack, "left")
        high = np.searchsorted(self.norms, norm + bound + slack, "right")
        for j in range(int(low.min(initial=0)), int(high.max(initial=0))):
            at = np.flatnonzero((low <= j) & (j < high) & (first != j))
            gap = x[at] - self.centroids[j]
            d = np.einsum("ij,ij->i", gap, gap)
            closer = (d < best[at]) | ((d == best[at]) & (self.number[j] < cluster[at]))
            best[at[closer]] = d[closer]
            cluster[at[closer]] = self.number[j]
        return cluster, best


def _sums(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """(count, sums) of the vectors nearest to each centroid."""
    shared = rows.sparkSession.sparkContext.broadcast(Annuli(centroids))
    k, length = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, 1 + length), np.int64)
        for b in batches:
            x = matrix(b.column(0), length)
            total += grouped(x, shared.value.nearest(x)[0], k)
        if total.any():
            yield pa.RecordBatch.from_arrays([array_of(total.reshape(1, -1))], ["s"])

    return totals(rows.select("x").mapInArrow(run, "s array<long>"), k * (1 + length)).reshape(k, 1 + length)


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of each row (id, x)."""
    shared = rows.sparkSession.sparkContext.broadcast(Annuli(centroids))
    length = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cluster, distance = shared.value.nearest(matrix(b.column(1), length))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])

    return rows.select("id", "x").mapInArrow(run, "id long, cluster int, distance long")


def fit(rows: DataFrame, k: int = 16, rounds: int = 3, seed: str = "1:") -> np.ndarray:
    """Centroids after ``rounds``; they start as the ``k`` vectors whose ids have the smallest hashes."""
    draw = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    centroids = np.array([r["x"] for r in rows.orderBy(draw, "x").limit(k).collect()], np.int64)  # ``k`` rows
    for _ in range(rounds if len(centroids) else 0):
        centroids = means(_sums(rows, centroids), centroids)
    return centroids


def op11_centroids(embeddings: DataFrame, k: int = 16, rounds: int = 3, length: int = 64, scale: int = 64) -> DataFrame:
    """Every kept vector's cluster and squared distance, and their sums over its cluster and over all."""
    spark = embeddings.sparkSession
    fine, x = whole("embedding", length, scale)
    rows = materialise(embeddings.where(fine).select(F.col("vec_id").cast("long").alias("id"), x.alias("x")), "vectors")
    centroids = fit(rows, k, rounds)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    out = materialise(assigned(rows, centroids), "assigned")
    forget(rows)
    sums = {r["cluster"]: r["s"] for r in out.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # ``k`` rows
    told = [(c, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    table = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(table), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


_NEAR = """
a{r} AS MATERIALIZED (SELECT n, arg_min(num, d * 65536 + num) AS cluster, min(d)::BIGINT AS distance
  FROM (SELECT v.n, c.num, list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(v.x, c.x)])::HUGEINT AS d FROM v, c{r} c) GROUP BY 1),"""
_MEAN = """
s{n} AS (SELECT cluster, p, sum(y)::BIGINT AS s, count(*) AS m FROM (SELECT a.cluster, unnest(v.x) AS y, unnest(range(64)) AS p FROM v JOIN a{r} a ON a.n = v.n) GROUP BY 1, 2),
f{n} AS (SELECT cluster, list((s - ((s % m) + m) % m) // m ORDER BY p) AS x FROM s{n} GROUP BY 1),
c{n} AS MATERIALIZED (SELECT c.num, coalesce(f.x, c.x) AS x FROM c{r} c LEFT JOIN f{n} f ON f.cluster = c.num),"""

#: Every vector against every centroid, round by round.
OP11_SQL = (
    """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, [floor(64 * y::DOUBLE)::BIGINT FOR y IN embedding] AS x FROM embeddings
  WHERE len(embedding) = 64 AND len([y FOR y IN embedding IF y IS NOT NULL AND isfinite(y)]) = 64),
h AS (SELECT x, row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), x) - 1 AS num FROM v),
c0 AS MATERIALIZED (SELECT num, x FROM h WHERE num < 16),"""
    + "".join(_NEAR.format(r=r) + _MEAN.format(r=r, n=r + 1) for r in range(3))
    + _NEAR.format(r=3).rstrip(",")
    + """
SELECT v.vec_id, a.cluster::INTEGER AS cluster, a.distance, (sum(a.distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia, (sum(a.distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM v JOIN a3 a ON a.n = v.n JOIN c3 c ON c.num = a.cluster
"""
)
