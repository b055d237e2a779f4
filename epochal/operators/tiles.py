"""Label images larger than a task: tiles are labelled alone, and what meets across their borders is linked by rounds.

A component goes by its smallest pixel (x, then y).  Within a tile components are found in numpy; pixels on the sides of tiles then meet
their neighbours by equal coordinates, which gives links between tiles' components, as many as border pixels at most; linked
ones take the smallest pixel that they reach.  A tile must fit a task, an image need not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochal.operators.buckets import _placed
from epochal.operators.graphs import linked

HALF, ALL = [(1, 0), (0, 1)], [(1, 0), (0, 1), (1, 1), (1, -1)]


def components(label: np.ndarray, diagonal: bool = False) -> np.ndarray:
    """Of each pixel the index (in the flattened image) of the first pixel of its component; of pixels labelled 0 their own."""
    n, index = label.size, np.arange(label.size).reshape(label.shape)
    a, b = [], []
    for dx, dy in ALL if diagonal else HALF:
        one = (slice(0, label.shape[0] - dx), slice(max(0, -dy), label.shape[1] - max(0, dy)))
        two = (slice(dx, label.shape[0]), slice(max(0, dy), label.shape[1] - max(0, -dy)))
        same = (label[one] == label[two]) & (label[one] != 0)
        a.append(index[one][same])
        b.append(index[two][same])
    a, b, root = np.concatenate(a), np.concatenate(b), np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        then = root.copy()
        np.minimum.at(then, a, low)
        np.minimum.at(then, b, low)
        np.minimum.at(then, root[a], low)
        np.minimum.at(then, root[b], low)
        then = then[then]
        if (then == root).all():
            return root
        root = then


def connected(m: DataFrame, key: str, label: str, diagonal: bool = False, tile: int = 1024) -> DataFrame:
    """``masks.connected`` by tiles: (key, x, y, component), components of a key numbered from 1 in the order of their first pixels, 0 the background.
    A pixel that stands twice counts once, with its largest label."""
    kind = m.schema[key].dataType.simpleString()
    pixels = m.groupBy(key, F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y")).agg(F.coalesce(F.max(F.col(label).cast("long")), F.lit(0)).alias("_l"))
    at = pixels.withColumns({"_tx": F.floor(F.col("x") / tile), "_ty": F.floor(F.col("y") / tile)})

    def alone(t: pa.Table) -> pa.Table:
        x, y, v = t["x"].to_numpy(), t["y"].to_numpy(), t["_l"].to_numpy()
        x0, y0 = x.min(), y.min()
        image = np.zeros((x.max() - x0 + 1, y.max() - y0 + 1), np.int64)
        image[x - x0, y - y0] = v
        root = components(image, diagonal)[(x - x0) * image.shape[1] + (y - y0)]
        rx, ry = (root // image.shape[1] + x0).astype(np.int32), (root % image.shape[1] + y0).astype(np.int32)
        return pa.table({key: t[key], "x": t["x"], "y": t["y"], "_l": t["_l"], "_rx": rx, "_ry": ry})

    tiled = at.where("_l <> 0").groupBy(key, "_tx", "_ty").applyInArrow(alone, f"`{key}` {kind}, x int, y int, _l long, _rx int, _ry int")
    node = F.struct(F.col(key).alias("k"), F.col("_rx").alias("x"), F.col("_ry").alias("y"))
    side = lambda c: F.pmod(F.col(c), F.lit(tile)).isin(0, tile - 1)
    border = tiled.where(side("x") | side("y")).select(key, "x", "y", "_l", node.alias("u"))
    steps = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in (ALL if diagonal else HALF)]))
    moved = border.select(key, (F.col("x")).alias("_x"), F.col("y").alias("_y"), "_l", F.col("u").alias("v"), steps.alias("_s"))
    moved = moved.select(key, (F.col("_x") + F.col("_s.dx")).alias("x"), (F.col("_y") + F.col("_s.dy")).alias("y"), "_l", "v")
    edges = border.join(moved, [key, "x", "y", "_l"]).where("u <> v").select("u", "v").distinct()
    roots = linked(edges).select(F.col("node").alias("_n"), "root")
    found = tiled.withColumn("_n", node).join(roots, "_n", "left").select(key, "x", "y", F.coalesce("root", "_n").alias("_root"))
    firsts = found.select(key, "_root").distinct().select(key, "_root", F.col("_root.x").alias("_fx"), F.col("_root.y").alias("_fy"))
    numbers = _placed(firsts, key, ["_fx", "_fy"], F.floor(F.col("_fx") / tile)).select(key, "_root", F.col("_i").alias("component"))
    named = found.join(numbers, [key, "_root"]).select(key, "x", "y", "component")
    return pixels.select(key, "x", "y").join(named, [key, "x", "y"], "left").select(key, "x", "y", F.coalesce("component", F.lit(0)).cast("int").alias("component"))


def largest_parts(m: DataFrame, key: str, label: str, diagonal: bool = False, tile: int = 1024, least: int = 1) -> DataFrame:
    """(key, x, y, label): of each label the largest connected part (of equal ones the first), if it has ``least`` pixels; all else is 0."""
    c = connected(m, key, label, diagonal, tile).where("component > 0")
    one = m.groupBy(key, F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y")).agg(F.max(label).alias(label))
    pixels = one.join(c, [key, "x", "y"], "left")
    sizes = pixels.where("component > 0").groupBy(key, label, "component").agg(F.count(F.lit(1)).alias("_n"))
    best = sizes.groupBy(key, label).agg(F.max(F.struct("_n", (-F.col("component")).alias("_c"))).alias("_b")).where(F.col("_b._n") >= least)
    best = best.select(key, label, (-F.col("_b._c")).alias("_best"))
    kept = pixels.join(best, [key, label], "left")
    return kept.select(key, "x", "y", F.when(F.col("component") == F.col("_best"), F.col(label)).otherwise(F.lit(0)).alias(label))
