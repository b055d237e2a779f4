"""Readers and writers of plain tables, and of recordings where their library is present."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    r = spark.read.format(kind).options(**options)
    return (r.schema(schema) if schema else r).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", overwrite: bool = False, by: list[str] | None = None) -> None:
    """A table that exists is an error unless ``overwrite``."""
    w = df.write.format(kind).mode("overwrite" if overwrite else "errorifexists")
    (w.partitionBy(*by) if by else w).save(path)


def recordings(spark: SparkSession, paths: DataFrame, datasets: list[str]) -> DataFrame:
    """(path, dataset, shape, values) of named HDF5 datasets, one file a task; needs h5py on the executors."""
    import h5py  # noqa: F401  (fails here, not in the tasks, where it is absent)

    def run(batches):
        import io

        import h5py
        import pandas as pd

        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                with h5py.File(io.BytesIO(content)) as f:
                    rows = [(p, d, list(f[d].shape), f[d][()].ravel().astype(float).tolist()) for d in datasets if d in f]
                yield pd.DataFrame(rows, columns=["path", "dataset", "shape", "values"])

    return paths.select("path", "content").mapInPandas(run, "path string, dataset string, shape array<long>, values array<double>")
