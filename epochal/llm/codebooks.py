"""Vector code compression: product codes whose nearest entries are found in vantage-point trees.

Vectors are cut into equal parts, and each part position has a codebook of entries.  Over the entries of a position stands
a vantage-point tree: a node's entry splits the rest at their median distance from it, and keeps the least and the
greatest distance of each half.  A batch descends together: at a node the exact integer distance to its entry
is taken, then each row visits the half that it lies nearer to, and the other one only if that half's distances could still hold an
entry as near as the best so far.  Bounds are rounded outwards and compared non-strictly, so that ties are
visited; what decides is the integer distance, then the lower index.

Vectors are turned into integers and written once, narrow; each round is one scan.  A task sends one row of counts
and sums, added up on executors; the driver keeps and broadcasts the codebooks only (``entries`` x ``length`` numbers).

Vectors that are null, empty, of another length than ``length``, or with null or non-finite components are left out; components
of 2^27 or more in size (after scaling) are an error.  Null ids come last where entries are chosen, equal ids
are told apart by their vectors; repeated rows each count.  With fewer vectors than ``entries`` the codebooks have as
many.  Null labels are one group.  An empty table gives no rows; other columns are not read.
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

SLACK = 1e-9


class Tree:
    """A vantage-point tree over the rows of ``entries``; nodes of up to ``leaf`` entries are compared outright."""

    def __init__(self, entries: np.ndarray, leaf: int = 4):
        self.entries, self.leaf = entries, leaf
        self.root = self._build(np.arange(len(entries)))

    def _build(self, at: np.ndarray):
        if len(at) <= self.leaf:
            return at
        gap = self.entries[at] - self.entries[at[0]]
        far = np.sqrt(np.einsum("ij,ij->i", gap, gap).astype(float))
        order = np.argsort(far[1:], kind="stable") + 1
        halves = [h for h in np.array_split(order, 2) if len(h)]
        # Each half with its range of distances from the vantage entry.
        return at[0], [(far[h].min(), far[h].max(), self._build(at[h])) for h in halves]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each row, of equal ones the lower index."""
        best, index = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int64)
        self._visit(self.root, x, np.arange(len(x)), best, index)
        return index, best

    def _meet(self, entry: int, x: np.ndarray, rows: np.ndarray, best: np.ndarray, index: np.ndarray) -> np.ndarray:
        gap = x[rows] - self.entries[entry]
        d = np.einsum("ij,ij->i", gap, gap)
        closer = (d < best[rows]) | ((d == best[rows]) & (entry < index[rows]))
        best[rows[closer]] = d[closer]
        index[rows[closer]] = entry
        return d

    def _visit(self, node, x: np.ndarray, rows: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        if not len(rows):
            return
        if isinstance(node, np.ndarray):
            for e in node.tolist():
                self._meet(e, x, rows, best, index)
            return
        entry, halves = node
        d = np.sqrt(self._meet(entry, x, rows, best, index).astype(float))
        # How far each row lies outside each half's ring.
        off = np.stack([np.maximum(0, np.maximum(low - d, d - high)) for low, high, _ in halves])
        first = off.argmin(0)
        slack = SLACK * (1 + d)
        for turn in (True, False):
            for i, (_, _, below) in enumerate(halves):
                mine = np.flatnonzero((first == i) == turn)
                reach = np.sqrt(best[rows[mine]].astype(float))
                could = off[i][mine] <= reach * (1 + SLACK) + slack[mine]
                self._visit(below, x, rows[mine[could]], best, index)


class Trees:
    """A tree a part position over codebooks (parts, entries, width)."""

    def __init__(self, books: np.ndarray):
        self.books, self.trees = books, [Tree(b) for b in books]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, squared distances), a column a part."""
        parts, _, width = self.books.shape
        found = [t.nearest(x[:, p * width : (p + 1) * width]) for p, t in enumerate(self.trees)]
        return np.stack([f[0] for f in found], 1).reshape(len(x), parts), np.stack([f[1] for f in found], 1).reshape(len(x), parts)


def _sums(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    shared = rows.sparkSession.sparkContext.broadcast(Trees(books))
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, 1 + width), np.int64)
        for b in batches:
            x = matrix(b.column(0), parts * width)
            codes, _ = shared.value.nearest(x)
            for p in range(parts):
                total[p] += grouped(x[:, p * width : (p + 1) * width], codes[:, p], entries)
        if total.any():
            yield pa.RecordBatch.from_arrays([array_of(total.reshape(1, -1))], ["s"])

    return totals(rows.select("x").mapInArrow(run, "s array<long>"), parts * entries * (1 + width)).reshape(parts, entries, 1 + width)


def fit(rows: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> np.ndarray:
    """Codebooks (parts, entries, width) after ``rounds``; they start as the parts of the ``entries`` smallest ids."""
    first = np.array([r["x"] for r in rows.orderBy(F.asc_nulls_last("id"), "x").limit(entries).collect()], np.int64)  # ``entries`` rows
    if not len(first):
        return np.zeros((parts, 0, 0), np.int64)
    books = first.reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        sums = _sums(rows, books)
        books = np.stack([means(s, b) for s, b in zip(sums, books, strict=True)])
    return books


def coded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(id, label, code, error) of each row (id, label, x); the code in hexadecimal, two digits a part (up to 256 entries)."""
    shared = rows.sparkSession.sparkContext.broadcast(Trees(books))
    length = books.shape[0] * books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, errors = shared.value.nearest(matrix(b.column(2), length))
            text = pa.array([c.tobytes().hex() for c in codes.astype(np.uint8)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), text, pa.array(errors.sum(1))], ["id", "label", "code", "error"])

    return rows.select("id", "label", "x").mapInArrow(run, "id long, label long, code string, error long")


def op13_codes(embeddings: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, length: int = 64, scale: int = 256, few: int = 1 << 18) -> DataFrame:
    """Every kept vector's code and error, and the errors' sum over its label.

    The sums are broadcast where there are at most ``few`` labels (counted); beyond, they are joined by shuffle."""
    if length % parts or entries > 256:
        raise ValueError("parts must divide the length, and a code digit pair holds 256 entries")
    spark = embeddings.sparkSession
    fine, x = whole("embedding", length, scale)
    rows = materialise(embeddings.where(fine).select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), x.alias("x")), "vectors")
    books = fit(rows, parts, entries, rounds)
    if not books.size:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    out = materialise(coded(rows, books), "coded")
    forget(rows)
    sums = materialise(out.groupBy("label").agg(F.sum("error").alias("label_error")), "labels")
    sums = sums.withColumnRenamed("label", "_label")
    small = F.broadcast(sums) if sums.count() <= few else sums
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return out.join(small, F.col("label").eqNullSafe(F.col("_label"))).select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


_NEAR = """
a{r} AS MATERIALIZED (SELECT n, p, (min(d * 64 + e) % 64)::BIGINT AS e, (min(d * 64 + e) // 64)::BIGINT AS d
  FROM (SELECT v.n, v.p, c.e, list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(v.x, c.x)])::HUGEINT AS d FROM v JOIN c{r} c ON c.p = v.p) GROUP BY 1, 2),"""
_MEAN = """
s{n} AS (SELECT p, e, w, sum(y)::BIGINT AS s, count(*) AS m FROM (SELECT v.p, a.e, unnest(v.x) AS y, unnest(range(4)) AS w FROM v JOIN a{r} a ON a.n = v.n AND a.p = v.p) GROUP BY 1, 2, 3),
f{n} AS (SELECT p, e, list((s - ((s % m) + m) % m) // m ORDER BY w) AS x FROM s{n} GROUP BY 1, 2),
c{n} AS MATERIALIZED (SELECT c.p, c.e, coalesce(f.x, c.x) AS x FROM c{r} c LEFT JOIN f{n} f ON f.p = c.p AND f.e = c.e),"""

#: Every part against every entry of its position, round by round.
OP13_SQL = (
    """
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, [floor(256 * y::DOUBLE)::BIGINT FOR y IN embedding]) AS n, vec_id, label, [floor(256 * y::DOUBLE)::BIGINT FOR y IN embedding] AS x
  FROM embeddings WHERE len(embedding) = 64 AND len([y FOR y IN embedding IF y IS NOT NULL AND isfinite(y)]) = 64),
v AS MATERIALIZED (SELECT n, p, x[4 * p + 1:4 * p + 4] AS x FROM (SELECT n, x, unnest(range(16)) AS p FROM k)),
c0 AS MATERIALIZED (SELECT p, n - 1 AS e, x FROM v WHERE n <= 64),"""
    + "".join(_NEAR.format(r=r) + _MEAN.format(r=r, n=r + 1) for r in range(2))
    + _NEAR.format(r=2)
    + """
o AS (SELECT n, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY 1),
b AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS h FROM c2)
SELECT k.vec_id, o.code, o.error, (sum(o.error) OVER (PARTITION BY k.label))::BIGINT AS label_error, b.h AS codebooks_sha256 FROM k JOIN o ON o.n = k.n, b
"""
)
