"""Groups of linked keys, by rounds over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochal.functions.shared import dropped, written


def followed(pointers: DataFrame, most: int = 64) -> DataFrame:
    """(node, root) from (node, parent), a forest: every pointer skips to its parent's parent until none can, so the rounds grow with
    the logarithm of the depth.  Roots themselves are not listed."""
    now = written(pointers.select("node", F.col("parent").alias("root")), "pointers")
    for _ in range(most):
        up = now.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        step = written(now.join(up, "root", "left").select("node", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "pointers")
        dropped(now)
        now = step
        if step.where("_moved").isEmpty():
            out = step.drop("_moved")
            out._written = step._written
            return out
    raise ValueError("the pointers form a ring")


def linked(edges: DataFrame, most: int = 64) -> DataFrame:
    """(node, root): for every node of the undirected edges (u, v) the smallest node it reaches.

    Each round a node hands the smallest neighbour to its larger neighbours, and then hangs on it (large and small stars), until
    each node hangs on one that hangs on none: a number of rounds in the logarithm of the longest path.
    Aggregations combine on the map side; joins are on the node alone, where Spark may split a hot one."""
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    for _ in range(most):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
        then = written(small.where("u <> v").distinct(), "links")
        dropped(now)
        now = then
        single = now.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        if single.where("n > 1").isEmpty() and now.join(now.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
    else:
        raise RuntimeError("the links did not settle")
    out = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return out.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
