"""Stimulus logs: lines to events, events to paired runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parse_lines(lines: DataFrame) -> DataFrame:
    """(path, line_no, ts, level, body): timestamp (15 characters), level (8), JSON-like body with single quotes."""
    body = F.regexp_replace(F.substring("line", 25, 1 << 20), "'", '"')
    return lines.select("path", "line_no", F.try_to_timestamp(F.substring("line", 1, 15), F.lit("yyyyMMdd HHmmss")).alias("ts"), F.trim(F.substring("line", 17, 8)).alias("level"), body.alias("body"))


def pair(events: DataFrame, key: str, order: list[str], time: str, is_start: Column, is_end: Column) -> DataFrame:
    """Runs (key, started, ended): each start with the first end before the next start; ends without a start are dropped."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    e = events.where(is_start | is_end).withColumns({"_s": is_start, "_e": is_end})
    e = e.withColumn("run", F.sum(F.col("_s").cast("int")).over(w)).where("run > 0")
    return e.groupBy(key, "run").agg(F.min(F.when(F.col("_s"), F.col(time))).alias("started"), F.min(F.when(F.col("_e"), F.col(time))).alias("ended"))


def attached(runs: DataFrame, parameters: DataFrame, key: str, time: str) -> DataFrame:
    """Parameter lines (key, time, name, value) with the run they belong to: the one that had ended last when they were written;
    lines before any end have none and are left out.  One running window a key, no range join."""
    end = runs.where("ended is not null").select(key, F.col("ended").alias(time), F.col("run").alias("_r"), F.lit(0).alias("_side"))
    both = parameters.withColumn("_side", F.lit(1)).unionByName(end, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("run", F.last("_r", ignorenulls=True).over(w)).where("_side = 1 and run is not null").select(*parameters.columns, "run")


def error_count(events: DataFrame, key: str, level: str = "level") -> DataFrame:
    return events.groupBy(key).agg(F.count_if(F.col(level) == "ERROR").alias("errors"))
