"""Linear filters from designs of many columns: products of columns are summed as matrices, a batch at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochal.functions.shared import rows_of

#: Bytes of partial matrices that a task holds before it hands them on.
HELD = 64 << 20


def products(rows: DataFrame, key: str, x: str, response: str, weight: str | None = None, held: int = HELD) -> DataFrame:
    """(key, r, s): row ``r`` of the matrix of products of the columns of ``x``, the response and a constant 1, summed over a key's rows
    (times ``weight``).  Each batch is one matrix product a key; a task adds them up and hands on a row a key and matrix row; those meet
    by key and matrix row and are added as they stream by, so that a key with most of the rows is spread over as many tasks as it has columns.

    Rows with a null in ``x``, response or weight take no part; ``x`` has one length over all rows."""
    kind = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, _k string, r int, s array<double>"
    names = [key, "_k", "r", "s"]
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    narrow = rows.select(F.col(key), F.coalesce(F.to_json(F.struct(key)), F.lit("")).alias("_k"), F.col(x).cast("array<double>").alias("_x"), F.col(response).cast("double").alias("_y"), w.alias("_w"))
    narrow = narrow.where(F.col("_x").isNotNull() & ~F.exists("_x", lambda v: v.isNull()) & F.col("_y").isNotNull() & F.col("_w").isNotNull())

    def told(sums: dict) -> Iterator[pa.RecordBatch]:
        for k, (first, m) in sums.items():
            n = len(m)
            values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * n), pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays([first.take(pa.array(np.zeros(n, np.int64))), pa.array([k] * n), pa.array(np.arange(n, dtype=np.int32)), values], names)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, size = {}, 0
        for b in batches:
            if not b.num_rows:
                continue
            a = np.column_stack((rows_of(b.column(2)), b.column(3).to_numpy(), np.ones(b.num_rows)))
            scaled = a * b.column(4).to_numpy()[:, None]
            coded = b.column(1).dictionary_encode()
            which = coded.indices.to_numpy()
            for i, k in enumerate(coded.dictionary.to_pylist()):
                at = np.flatnonzero(which == i)
                m = a[at].T @ scaled[at]
                if k in sums:
                    sums[k] = sums[k][0], sums[k][1] + m
                else:
                    sums[k] = b.column(0).slice(int(at[0]), 1), m
                    size += m.nbytes
            if size > held:
                yield from told(sums)
                sums, size = {}, 0
        yield from told(sums)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of one key and matrix row, added up."""
        now, first, total = None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            ks, rs, values = b.column(1).to_pylist(), b.column(2).to_pylist(), rows_of(b.column(3))
            for i, at in enumerate(zip(ks, rs, strict=True)):
                if at == now:
                    total = total + values[i]
                    continue
                if now is not None:
                    yield pa.RecordBatch.from_arrays([first, pa.array([now[0]]), pa.array([now[1]], pa.int32()), pa.array([total.tolist()], pa.list_(pa.float64()))], names)
                now, first, total = at, b.column(0).slice(i, 1), values[i]
        if now is not None:
            yield pa.RecordBatch.from_arrays([first, pa.array([now[0]]), pa.array([now[1]], pa.int32()), pa.array([total.tolist()], pa.list_(pa.float64()))], names)

    parts = narrow.mapInArrow(partial, schema).repartition("_k", "r").sortWithinPartitions("_k", "r")
    return parts.mapInArrow(added, schema)


def solved(sums: DataFrame, key: str, ridge: float = 0.0, intercept: bool = False) -> DataFrame:
    """(key, w, intercept, n, r2) from :func:`products`: the weights with the least squared error plus ``ridge`` times their squares; of the least norm
    where many do.  A key's matrix (columns squared) is solved in one task."""
    kind = sums.schema[key].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        order = np.argsort(t["r"].to_numpy())
        m = rows_of(t["s"])[order]
        p = len(m) - 2
        a, b, yy, n = m[:p, :p], m[:p, p], m[p, p], m[p + 1, p + 1]
        mean_x, mean_y = m[:p, p + 1] / n, m[p, p + 1] / n
        if intercept:
            a, b = a - n * np.outer(mean_x, mean_x), b - n * mean_x * mean_y
        w = np.linalg.lstsq(a + ridge * np.eye(p), b, rcond=None)[0]
        left = yy - n * mean_y**2 if intercept else yy
        r2 = float((2 * w @ b - w @ a @ w) / left) if left > 0 else None
        return pa.table({key: t[key].slice(0, 1), "w": pa.array([w.tolist()], pa.list_(pa.float64())), "intercept": pa.array([float(mean_y - w @ mean_x) if intercept else 0.0]), "n": pa.array([float(n)]), "r2": pa.array([r2], pa.float64())})

    return sums.groupBy(key).applyInArrow(run, f"`{key}` {kind}, w array<double>, intercept double, n double, r2 double")


def least_squares(rows: DataFrame, key: str, response: str, x: str = "x") -> DataFrame:
    """(key, w): weights that fit the response best from ``x``; the least norm where many do."""
    return solved(products(rows, key, x, response), key).select(key, "w")
