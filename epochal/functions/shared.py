"""Tables in the folder that all executors share, sums over tasks, and row numbers without one task for all rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder of our own, but only if driver and executors are one process."""
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return _OWN.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="epochal-"))


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a Parquet table of the shared folder: its lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    p, fs = _path(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Delete tables of :func:`written` that nothing reads again."""
    for t in tables:
        if path := getattr(t, "_written", None):
            p, fs = _path(t.sparkSession, path)
            fs.delete(p, True)


def rows_of(column: pa.ChunkedArray | pa.Array, kind=float) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def summed(parts: DataFrame, tasks: int = 16) -> np.ndarray | None:
    """Sum over rows of ``s``, an array of doubles of one length (a row a task that made it): ``tasks`` tasks add up what they
    are dealt, the driver adds their rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                s = rows_of(b.column(0)).sum(0)
                total = s if total is None else total + s
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["s"])

    tasks = min(tasks, parts.sparkSession.sparkContext.defaultParallelism)
    rows = parts.select("s").repartition(tasks).mapInArrow(add, "s array<double>").collect()
    return np.sum([r["s"] for r in rows], axis=0) if rows else None


def numbered(df: DataFrame, order: list, name: str, tag: str = "numbered") -> DataFrame:
    """``df`` with ``name``: 0, 1, ... in the order of ``order``.  Rows are sorted by ranges, counted a range, and numbered within
    it, so that no task holds them all; one row a range is broadcast."""
    sorted_ = written(df.orderBy(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), tag)
    first = sorted_.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_low"))
    first = first.select("_part", "_low", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    # Within a range the ids of ``_at`` have no gaps.
    out = sorted_.join(F.broadcast(first), "_part").withColumn(name, F.col("_before") + F.col("_at") - F.col("_low")).drop("_part", "_at", "_low", "_before")
    out._written = sorted_._written
    return out
