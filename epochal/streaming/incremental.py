"""Structured Streaming: incremental population, run pairing, event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def populate_new_files(spark: SparkSession, folder: str, schema: str, target: str, checkpoint: str, key: list[str], compute) -> None:
    """Process files that came since the last call (``availableNow``); rows whose key is in the target are skipped."""

    def batch(df: DataFrame, _: int) -> None:
        rows = compute(df)
        p = spark._jvm.org.apache.hadoop.fs.Path(target)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            rows = rows.join(spark.read.parquet(target).select(*key), key, "left_anti")
        rows.dropDuplicates(key).write.mode("append").parquet(target)

    q = spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def pair_runs(stream: DataFrame, key: str, schema: str = "user_id long, started timestamp, ended timestamp") -> DataFrame:
    """Starts paired with the next end of the same key across batches; state is one timestamp a key.
    Rows: (key, ts, kind) with kind ``start`` or ``end``."""
    import pandas as pd

    def run(k, batches, state):
        began = state.get[0] if state.exists else None
        rows = []
        for pdf in batches:
            for ts, kind in sorted(zip(pdf["ts"], pdf["kind"], strict=True)):
                if kind == "start":
                    began = ts
                elif began is not None:
                    rows.append((k[0], began, ts))
                    began = None
        state.update((began,))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return stream.groupBy(key).applyInPandasWithState(run, schema, "began timestamp", "append", "NoTimeout")


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums of event-time windows (works on streams and tables)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str, step: str) -> DataFrame:
    return events.groupBy(F.window("ts", width, step).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "n")


def sessions(events: DataFrame, key: str, gap: str) -> DataFrame:
    return events.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("session_start"), "n")
