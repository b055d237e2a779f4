"""Making, comparing and cleaning label images; resizing and turning images. Long form: (x, y, v) or
(x, y, label), one row a pixel."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochal.functions.scalars import corr

FOUR = [(-1, 0), (1, 0), (0, -1), (0, 1)]


def circle(pixels: DataFrame, cx: float, cy: float, radius: float) -> DataFrame:
    """Adds ``inside``: whether a pixel's distance from the centre is within the radius."""
    dx, dy = F.col("x") - F.lit(float(cx)), F.col("y") - F.lit(float(cy))
    return pixels.withColumn("inside", dx * dx + dy * dy <= F.lit(float(radius) ** 2))


def clear_artifact_columns(m: DataFrame, n: int, label: str = "label") -> DataFrame:
    """Labels of the first ``n`` columns (x) become 0."""
    return m.withColumn(label, F.when(F.col("x") < n, F.lit(0)).otherwise(F.col(label)))


def line_threshold(image: DataFrame, q: float = 0.7, least: float = 0.1) -> DataFrame:
    """Per line (y), a percentile of the values, not below ``least``."""
    return image.groupBy("y").agg(F.greatest(F.percentile("v", F.lit(q)), F.lit(float(least))).alias("threshold"))


def _neighbours(m: DataFrame, label: str) -> DataFrame:
    """(x, y, other): the labels of the four neighbours of each pixel, by sending each pixel to them."""
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in FOUR])
    sent = m.where(F.col(label) != 0).select(F.explode(steps).alias("s"), "x", "y", F.col(label).alias("other"))
    return sent.select((F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"), "other")


def neighbour_labels(m: DataFrame, label: str = "label") -> DataFrame:
    """Pairs of different labels that touch."""
    return m.where(F.col(label) != 0).join(_neighbours(m, label), ["x", "y"]).where(F.col(label) != F.col("other")).select(label, "other").distinct()


def remove_isolated(m: DataFrame, label: str = "label") -> DataFrame:
    """Pixels without a neighbour of their own label become 0."""
    same = _neighbours(m, label).withColumnRenamed("other", label).distinct().withColumn("_k", F.lit(True))
    return m.join(same, ["x", "y", label], "left").withColumn(label, F.when(F.col("_k"), F.col(label)).otherwise(F.lit(0))).drop("_k")


def suggestions(predicted: DataFrame, present: DataFrame, most: float, label: str = "label") -> DataFrame:
    """Predicted labels whose largest intersection over union with any present one is below ``most``."""
    p, q = predicted.where(F.col(label) != 0), present.where(F.col(label) != 0).withColumnRenamed(label, "_o")
    size_p, size_q = p.groupBy(label).agg(F.count(F.lit(1)).alias("_p")), q.groupBy("_o").agg(F.count(F.lit(1)).alias("_q"))
    both = p.join(q, ["x", "y"]).groupBy(label, "_o").agg(F.count(F.lit(1)).alias("_n")).join(size_p, label).join(size_q, "_o")
    worst = both.groupBy(label).agg(F.max(F.col("_n") / (F.col("_p") + F.col("_q") - F.col("_n"))).alias("iou"))
    return size_p.join(worst, label, "left").select(label, F.col("_p").alias("pixels"), F.coalesce("iou", F.lit(0.0)).alias("iou")).where(F.col("iou") < most)


def add_labels(present: DataFrame, new: DataFrame, label: str = "label") -> DataFrame:
    """Adds the new labels (numbered on from the present ones) whose pixels neither lie on nor touch a
    present label. New labels are taken as disjoint."""
    taken = present.where(F.col(label) != 0).select("x", "y").union(_neighbours(present, label).select("x", "y")).distinct()
    n = new.where(F.col(label) != 0)
    hit = n.join(taken, ["x", "y"], "left_semi").select(label).distinct()
    top = present.agg(F.coalesce(F.max(label), F.lit(0)).alias("_t"))  # one row
    kept = n.join(hit, label, "left_anti").crossJoin(F.broadcast(top)).select("x", "y", (F.col(label) + F.col("_t")).alias("_l"))
    return present.join(kept, ["x", "y"], "left").withColumn(label, F.coalesce("_l", label)).drop("_l")


def compare(a: DataFrame, b: DataFrame, most: int, label: str = "label") -> DataFrame:
    """One row (verdict, dx, dy): ``same``; ``shifted`` by the least move within ``most`` that matches
    every labelled pixel that stays in the frame both ways; else ``different``."""
    r = F.sequence(F.lit(-most), F.lit(most))
    frame = a.agg(F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1"))  # one row
    shifts = F.broadcast(frame.select("*", F.explode(r).alias("dx")).select("*", F.explode(r).alias("dy")))  # (2 most + 1) squared rows

    def moved(m: DataFrame, name: str, back: bool) -> DataFrame:
        """Labelled pixels at their place in ``a`` for every move, where both places lie in the frame."""
        d = m.where(F.col(label) != 0).crossJoin(shifts)
        sign = -1 if back else 1
        u, v = F.col("x") + sign * F.col("dx"), F.col("y") + sign * F.col("dy")
        d = d.where(u.between(F.col("_x0"), F.col("_x1")) & v.between(F.col("_y0"), F.col("_y1")))
        place = (u.alias("x"), v.alias("y")) if back else ("x", "y")
        return d.select("dx", "dy", *place, F.col(label).alias(name))

    both = moved(a, "_a", False).join(moved(b, "_b", True), ["dx", "dy", "x", "y"], "full")
    bad = both.groupBy("dx", "dy").agg(F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("bad"))
    best = bad.agg(F.min_by(F.struct("dx", "dy", "bad"), F.struct("bad", F.abs("dx") + F.abs("dy"), "dx", "dy")).alias("r")).select("r.*")
    best = best.fillna(0)  # no labelled pixels at all
    verdict = F.when(F.col("bad") > 0, "different").when((F.col("dx") == 0) & (F.col("dy") == 0), "same").otherwise("shifted")
    return best.select(verdict.alias("verdict"), "dx", "dy")


def _sampled(image: DataFrame, places: DataFrame, order: int, fill: float | None) -> DataFrame:
    """Values of an image at real places (ox, oy, sx, sy): the nearest pixel (order 0) or the four around
    them (order 1), ``fill`` outside; null where the nearest pixel is missing or null."""
    near = (F.floor(F.col("sx") + 0.5).cast("int"), F.floor(F.col("sy") + 0.5).cast("int"))
    pix = image.select(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.col("v").cast("double").alias("v"))
    if order == 0:
        got = places.select("ox", "oy", near[0].alias("x"), near[1].alias("y")).join(pix, ["x", "y"], "left")
        return got.select(F.col("ox").alias("x"), F.col("oy").alias("y"), "v")
    fx, fy = F.col("sx") - F.floor("sx"), F.col("sy") - F.floor("sy")
    four = F.array(*[F.struct((F.floor("sx") + i).cast("int").alias("x"), (F.floor("sy") + j).cast("int").alias("y"), ((fx if i else 1 - fx) * (fy if j else 1 - fy)).alias("w")) for i in (0, 1) for j in (0, 1)])
    low = image.agg(F.min("v").cast("double").alias("_low"), F.max("v").cast("double").alias("_high"))  # one row
    each = places.select("ox", "oy", near[0].alias("nx"), near[1].alias("ny"), F.explode(four).alias("p")).select("ox", "oy", "nx", "ny", "p.*")
    got = each.join(pix.withColumn("_in", F.lit(True)), ["x", "y"], "left").crossJoin(F.broadcast(low))
    outside = F.col("_low") if fill is None else F.lit(float(fill))
    value = F.when(F.col("_in"), F.coalesce("v", "_low")).otherwise(outside)
    centre = F.max(F.when((F.col("x") == F.col("nx")) & (F.col("y") == F.col("ny")), F.col("v")))
    g = got.groupBy("ox", "oy").agg(F.sum(F.col("w") * value).alias("v"), centre.alias("c"), F.first("_low").alias("a"), F.first("_high").alias("b"))
    return g.select(F.col("ox").alias("x"), F.col("oy").alias("y"), F.when(F.col("c").isNotNull(), F.greatest("a", F.least("b", "v"))).alias("v"))


def _grid(image: DataFrame, nx: int, ny: int, sx: Column, sy: Column) -> DataFrame:
    g = image.sparkSession.range(nx * ny).select((F.col("id") / ny).cast("int").alias("ox"), (F.col("id") % ny).cast("int").alias("oy"))
    return g.select("ox", "oy", sx.alias("sx"), sy.alias("sy"))


def resize(image: DataFrame, shape: tuple[int, int], to: tuple[int, int], order: int = 0) -> DataFrame:
    """Image of ``shape`` at another size; pixel centres map to pixel centres, edges blend with 0
    (order 1), missing pixels stay missing."""
    at = lambda c, a, b: (F.col(c) + 0.5) * F.lit(a / b) - 0.5
    return _sampled(image, _grid(image, *to, at("ox", shape[0], to[0]), at("oy", shape[1], to[1])), order, 0.0)


def rescale(image: DataFrame, shape: tuple[int, int], scale: tuple[float, float], order: int = 0) -> DataFrame:
    """Resize to the next whole size above ``shape`` times ``scale``."""
    return resize(image, shape, tuple(math.ceil(n * s) for n, s in zip(shape, scale, strict=True)), order)


def rotate(image: DataFrame, shape: tuple[int, int], degrees: float, order: int = 1) -> DataFrame:
    """Image turned counter-clockwise about its centre (x down, y right), on a frame that holds it all;
    null where there is no source pixel."""
    a = math.radians(degrees)
    c, s = round(math.cos(a), 12), round(math.sin(a), 12)
    nx, ny = (math.ceil(round(abs(c) * shape[i] + abs(s) * shape[1 - i], 6)) for i in (0, 1))
    dx, dy = F.col("ox") - F.lit((nx - 1) / 2), F.col("oy") - F.lit((ny - 1) / 2)
    sx, sy = dx * c + dy * s + F.lit((shape[0] - 1) / 2), dy * c - dx * s + F.lit((shape[1] - 1) / 2)
    return _sampled(image, _grid(image, nx, ny, F.round(sx, 9), F.round(sy, 9)), order, None)


def brightness_index(image: DataFrame, m: DataFrame, label: str = "label") -> DataFrame:
    """Mean brightness of each label, scaled to 0..1 over labels."""
    g = m.where(F.col(label) != 0).join(image, ["x", "y"]).groupBy(label).agg(F.avg("v").alias("b"))
    r = g.agg(F.min("b").alias("lo"), F.max("b").alias("hi"))  # one row
    return g.crossJoin(F.broadcast(r)).select(label, F.coalesce(F.try_divide(F.col("b") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)).alias("brightness"))


def cross_correlation(a: DataFrame, b: DataFrame, most: int) -> DataFrame:
    """Correlation of two images over their overlap for every move of ``b`` within ``most``."""
    r = F.sequence(F.lit(-most), F.lit(most))
    s = b.select(F.explode(r).alias("dx"), "x", "y", F.col("v").alias("w")).select("dx", F.explode(r).alias("dy"), "x", "y", "w")
    s = s.select("dx", "dy", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), "w")
    return a.join(s, ["x", "y"]).groupBy("dx", "dy").agg(corr("v", "w").alias("corr"))


def grow(stack: DataFrame, key: str, q: float = 0.7, least_corr: float = 0.1, most: int = 25, most_x: int = 5, most_y: int = 5, least: int = 3, border: int = 1, only_seeds: bool = False) -> DataFrame:
    """Seeded region growing of one recording (key) at a time; ``stack`` has (key, x, y, series).

    The map of each pixel's mean correlation with its eight neighbours gives a threshold a line (y); pixels
    at or above it are seeds, taken from the highest. A region takes, best first, four-neighbours whose
    series correlate with the seed's at or above the threshold of their line, within the size limits.
    A recording is one frame's pixels, bounded by the scan."""
    import numpy as np
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = pdf["x"].min(), pdf["y"].min()
        nx, ny = int(pdf["x"].max() - x0) + 1, int(pdf["y"].max() - y0) + 1
        z = np.zeros((nx, ny, len(pdf["series"].iloc[0])))
        z[pdf["x"] - x0, pdf["y"] - y0] = np.stack(pdf["series"].to_numpy())
        z -= z.mean(-1, keepdims=True)
        z /= np.maximum(np.linalg.norm(z, axis=-1, keepdims=True), 1e-300)
        inner = np.zeros((nx, ny), bool)
        inner[border : nx - border, border : ny - border] = True
        near = np.zeros((nx, ny))
        for dx in (-1, 0, 1):
            for dy in (-1, 0, 1):
                if (dx or dy) and inner.any():
                    near[inner] += np.einsum("xyt,xyt->xy", z, np.roll(z, (-dx, -dy), (0, 1)))[inner] / 8
        line = np.ones(ny)
        if inner.any():
            span = slice(border, ny - border)
            line[span] = np.percentile(near[border : nx - border, span], 100 * q, axis=0)
        line = np.maximum(line, least_corr)
        free = inner & (near >= line) if only_seeds else inner.copy()
        label, n = np.zeros((nx, ny), int), 0
        for seed in sorted(map(tuple, np.argwhere(inner & (near >= line))), key=lambda p: (-near[p], p)):
            if label[seed] or not free[seed]:
                continue
            open_, waiting, region = free.copy(), [(1.0, seed)], []
            while waiting and len(region) < most:
                best = max(range(len(waiting)), key=lambda i: waiting[i][0])
                c, p = waiting.pop(best)
                if not open_[p]:
                    continue
                open_[p] = False
                if c < line[p[1]]:
                    continue
                region.append(p)
                for axis, limit in ((0, most_x), (1, most_y)):
                    lo, hi = min(r[axis] for r in region), max(r[axis] for r in region)
                    if hi - lo >= limit - 1:
                        view = open_ if axis == 0 else open_.T
                        view[:lo] = False
                        view[hi + 1 :] = False
                for dx, dy in FOUR:
                    w = (p[0] + dx, p[1] + dy)
                    if 0 <= w[0] < nx and 0 <= w[1] < ny and open_[w]:
                        waiting.append((float(z[seed] @ z[w]), w))
            if len(region) >= least:
                n += 1
                at = tuple(np.array(region).T)
                label[at], free[at] = n, False
        return pd.DataFrame({key: pdf[key], "x": pdf["x"], "y": pdf["y"], "label": label[pdf["x"] - x0, pdf["y"] - y0]})

    return stack.groupBy(key).applyInPandas(run, f"{key} long, x int, y int, label int")


def around_seed(image: DataFrame, seed: tuple[int, int], radius: float, score: Column, least: float) -> DataFrame:
    """Candidate pixels within a radius whose score reaches ``least``; ``masks.connected`` keeps the
    component of the seed."""
    near = circle(image, *seed, radius).where("inside").drop("inside")
    return near.withColumn("label", F.when(score >= F.lit(float(least)), F.lit(1)).otherwise(F.lit(0)))
