"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has a bit for each positive component, cut into ``SEGMENTS`` segments.  A code
within radius r of a query has a segment within r / SEGMENTS of the query's, so after all
segments were probed at distances 0, 1, ... s, every code within SEGMENTS * (s + 1) - 1
bits has been seen and its whole distance verified.  The radius grows by rounds over the whole table:
a round probes one more radius for the queries that are still open, in every shard, and merges what the shards
verified; a query is closed when its kth verified distance is covered.  So the radius
is that of the kth neighbour in the whole table, not in a shard, and nothing is compared that no
segment brought up.

A task indexes its rows ``shard`` at a time, whatever its partition holds.  Of rows with one code in a
shard the k + 1 smallest ids can matter.  Queries (a stated set) go in blocks of at most ``block`` rows,
whose codes and bounds are broadcast; a block's answers are written before the next begins.
Ties go to the smaller id; a row is not its own neighbour.  Null ids, null vectors and vectors of another
length than ``bits`` are left out; NaN and null components count as not positive.  Equal vectors are each
found, repeated rows once.  An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import append, forget, materialise

SEGMENTS, WIDTH = 4, 16


def codes(rows: DataFrame, id_col: str, vector: str, bits: int = 64) -> DataFrame:
    """(id, code): sign bits packed into a long; shorter codes fill up with zeros."""
    packed = F.aggregate(
        F.transform(F.col(vector), lambda v, i: F.when((v > 0) & ~F.isnan(v), F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))).otherwise(F.lit(0).cast("long"))),
        F.lit(0).cast("long"),
        lambda a, x: a.bitwiseOR(x),
    )
    return rows.where(F.col(id_col).isNotNull() & (F.size(vector) == bits)).select(F.col(id_col).cast("long").alias("id"), packed.alias("code"))


_RINGS: dict[int, np.ndarray] = {}


def ring(radius: int) -> np.ndarray:
    """All WIDTH-bit values with ``radius`` bits set."""
    if radius not in _RINGS:
        _RINGS[radius] = np.array([sum(1 << b for b in c) for c in combinations(range(WIDTH), radius)], np.int64)
    return _RINGS[radius]


@dataclass
class Open:
    """Queries of a block that are not closed: distinct codes, and the distance a new neighbour may have at most."""

    code: np.ndarray
    bound: np.ndarray


class Shard:
    """Multi-index over a shard's rows; of equal codes the ids that can matter."""

    def __init__(self, ids: np.ndarray, code: np.ndarray, k: int):
        order = np.lexsort((ids, code))
        ids, code = ids[order], code[order]
        new = np.concatenate(([True], code[1:] != code[:-1]))
        place = np.arange(len(code))
        nth = place - np.maximum.accumulate(np.where(new, place, 0))
        # A query wants k neighbours besides itself: k + 1 smallest ids of a code do.
        self.ids, self.codes = ids[nth <= k], code[nth <= k]
        self.index = []
        for s in range(SEGMENTS):
            seg = ((self.codes >> np.uint64(WIDTH * s)) & np.uint64((1 << WIDTH) - 1)).astype(np.int64)
            by = np.argsort(seg, kind="stable")
            self.index.append((by, np.searchsorted(seg[by], np.arange((1 << WIDTH) + 1))))

    def probe(self, code: np.uint64, radii: range) -> np.ndarray:
        """Rows with a segment at one of ``radii`` from the code's."""
        found = []
        for i, (by, starts) in enumerate(self.index):
            own = int((int(code) >> (WIDTH * i)) & ((1 << WIDTH) - 1))
            for s in radii:
                lo, n = starts[p := ring(s) ^ own], starts[p + 1]
                n = n - lo
                lo, n = lo[n > 0], n[n > 0]
                if len(n):
                    found.append(by[np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))])
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def nearest(self, code: np.uint64, radii: range, k: int, bound: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the k + 1 nearest that ``radii`` bring up, within ``bound`` bits."""
        at = self.probe(code, radii)
        dist = np.bitwise_count(self.codes[at] ^ code).astype(np.int64)
        at, dist = at[dist <= bound], dist[dist <= bound]
        best = np.lexsort((self.ids[at], dist))[: k + 1]
        return self.ids[at[best]], dist[best]


FOUND = "code long, id long, distance int"


def _round(rows: DataFrame, todo: Open, radii: range, k: int, shard: int) -> DataFrame:
    """(code, id, distance): each shard's best for each open code at ``radii``."""
    shared = rows.sparkSession.sparkContext.broadcast(todo)
    names = ["code", "id", "distance"]

    def answers(ids: list[np.ndarray], codes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        index, out, size = Shard(np.concatenate(ids), np.concatenate(codes).view(np.uint64), k), [], 0
        for c, bound in zip(shared.value.code, shared.value.bound.tolist(), strict=True):
            near, dist = index.nearest(c, radii, k, bound)
            if len(near):
                out.append((np.full(len(near), c, np.uint64).view(np.int64), near, dist.astype(np.int32)))
                size += len(near)
            if size > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, codes, n = [], [], 0
        for b in batches:
            ids.append(b.column(0).to_numpy())
            codes.append(b.column(1).to_numpy())
            n += b.num_rows
            if n >= shard:
                yield from answers(ids, codes)
                ids, codes, n = [], [], 0
        if n:
            yield from answers(ids, codes)

    return rows.select("id", "code").mapInArrow(run, FOUND)


def search_block(rows: DataFrame, n: int, codes: np.ndarray, k: int, shard: int, first: int = 2) -> DataFrame:
    """(code, id, distance): the k + 1 nearest of each of ``codes`` (distinct) among the ``n`` rows.

    The first round takes radii 0 to ``first``, each later one a radius more."""
    todo, best, radii = Open(codes, np.full(len(codes), 64)), None, range(first + 1)
    nth = F.row_number().over(Window.partitionBy("code").orderBy("distance", "id"))
    while True:
        new = _round(rows, todo, radii, k, shard)
        new = new if best is None else new.unionByName(best)
        then = materialise(new.distinct().withColumn("_n", nth).where(F.col("_n") <= k + 1).drop("_n"), "nearest")
        forget(best)
        best, covered = then, SEGMENTS * radii.stop - 1
        # One row a query of the block.
        held = best.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("d")).toPandas()
        full = held["n"].to_numpy() >= k + 1
        last = held["d"].to_numpy(dtype=np.int64)
        done = (full & (last <= covered)) | (held["n"].to_numpy() >= n) | (covered >= SEGMENTS * WIDTH)
        bound = dict(zip(held["code"].to_numpy(dtype=np.int64)[~done].tolist(), np.where(full, last, 64)[~done].tolist(), strict=True))
        closed = set(held["code"].to_numpy(dtype=np.int64)[done].tolist())
        left = [c for c in todo.code.view(np.int64).tolist() if c not in closed]
        if not left or covered >= SEGMENTS * WIDTH:
            return best
        todo = Open(np.array(left, np.int64).view(np.uint64), np.array([bound.get(c, 64) for c in left]))
        radii = range(radii.stop, radii.stop + 1)


def top_k(rows: DataFrame, is_query, k: int = 10, block: int = 1 << 21, shard: int = 1 << 18) -> DataFrame:
    """Exact k nearest of every row of ``rows`` (id, code) for which ``is_query`` (of id) holds.

    Returns (query_id, rank, neighbor_id, distance).  A block's codes and bounds take 16 bytes each, so a
    broadcast has at most 32 MB; the table is scanned two or three times a block."""
    spark = rows.sparkSession
    rows = materialise(rows.repartition(spark.sparkContext.defaultParallelism, "id").distinct(), "codes")
    n, asked = rows.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    blocks = max(1, -(-asked * 5 // (block * 4)))  # room for uneven hashing
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbor_id"))
    made = None
    for i in range(blocks):
        mine = rows.where(is_query & (F.pmod(F.xxhash64("code", F.lit("block")), F.lit(blocks)) == i))
        codes = mine.select("code").distinct().toPandas()["code"].to_numpy(dtype=np.int64)  # bounded by the block
        near = search_block(rows, n, codes.view(np.uint64), k, shard)
        pairs = mine.select(F.col("id").alias("query_id"), "code").join(near, "code").where("query_id <> id")
        pairs = pairs.select("query_id", F.col("id").alias("neighbor_id"), "distance").withColumn("rank", rank)
        part = pairs.where(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", "distance")
        if blocks == 1:
            return part
        made = append(part, made, "topk")
    return made


def op8_topk(embeddings: DataFrame, k: int = 10) -> DataFrame:
    """Queries: every row whose id is divisible by 100, against all rows."""
    return top_k(codes(embeddings, "vec_id", "embedding"), F.col("id") % 100 == 0, k)
