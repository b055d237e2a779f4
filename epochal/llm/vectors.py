"""Integer vectors and sums over all of them, for the operators that cluster or compress vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components this large or larger are an error: 64 squared differences of them would not fit a long.
MOST = 1 << 27


def whole(vector: str, length: int, scale: int) -> tuple[Column, Column]:
    """(which rows hold ``length`` finite components, their floor(``scale`` * x) as ints)."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    large = F.raise_error(F.lit(f"a component times {scale} is {MOST} or more in size")).cast("int")
    return F.coalesce((F.size(v) == length) & fine, F.lit(False)), F.transform(v, lambda x: F.when(F.abs(x * scale) < MOST, F.floor(x * scale).cast("int")).otherwise(large))


def matrix(column: pa.Array, length: int) -> np.ndarray:
    """A column of lists of ``length`` as rows of int64."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, length)


def array_of(rows: np.ndarray) -> pa.Array:
    """Rows of integers as a column of lists."""
    flat = pa.array(np.ascontiguousarray(rows, dtype=np.int64).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), flat)


def totals(parts: DataFrame, width: int, tasks: int = 16) -> np.ndarray:
    """Sum over rows of ``s`` (``width`` longs, a row a task that made it): ``tasks`` tasks add up what they are dealt, and the
    driver their rows, so that it gets ``tasks`` x ``width`` numbers however many rows there are."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                s = matrix(b.column(0), width).sum(0)
                total = s if total is None else total + s
        if total is not None:
            yield pa.RecordBatch.from_arrays([array_of(total[None, :])], ["s"])

    rows = parts.select("s").repartition(tasks).mapInArrow(add, "s array<long>").collect()
    return np.sum([r["s"] for r in rows], axis=0, dtype=np.int64) if rows else np.zeros(width, np.int64)


def grouped(x: np.ndarray, group: np.ndarray, k: int) -> np.ndarray:
    """(count, sum of each component) of each of ``k`` groups of rows."""
    order = np.argsort(group, kind="stable")
    starts = np.searchsorted(group[order], np.arange(k + 1))
    out = np.zeros((k, 1 + x.shape[1]), np.int64)
    out[:, 0] = np.diff(starts)
    some = np.flatnonzero(out[:, 0])
    if len(some):
        out[some, 1:] = np.add.reduceat(x[order], starts[:-1][some])
    return out


def means(sums: np.ndarray, before: np.ndarray) -> np.ndarray:
    """floor(sum / count) of each group; a group without rows keeps what it had."""
    n = sums[:, :1]
    return np.where(n > 0, np.floor_divide(sums[:, 1:], np.maximum(n, 1)), before)
