"""Label images in long form: one row a pixel (x, y, label), optionally keyed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epochal.functions.scalars import corr


def overlap(a: DataFrame, b: DataFrame, on: list[str], la: str, lb: str) -> DataFrame:
    """Pixels shared by each pair of labels."""
    return a.join(b, on).groupBy(la, lb).agg(F.count(F.lit(1)).alias("n"))


def iou(a: DataFrame, b: DataFrame, on: list[str], la: str, lb: str) -> DataFrame:
    """Intersection over union of each pair of labels that meet."""
    na = a.groupBy(la).agg(F.count(F.lit(1)).alias("_na"))
    nb = b.groupBy(lb).agg(F.count(F.lit(1)).alias("_nb"))
    o = overlap(a, b, on, la, lb).join(na, la).join(nb, lb)
    return o.select(la, lb, (F.col("n") / (F.col("_na") + F.col("_nb") - F.col("n"))).alias("iou"))


def remove_small(m: DataFrame, label: str, least: int) -> DataFrame:
    """Labels of fewer than ``least`` pixels become 0: counts are made with map-side combine and joined back."""
    n = m.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    return m.join(n, label).withColumn(label, F.when(F.col("_c") < least, F.lit(0)).otherwise(F.col(label))).drop("_c")


def relabel_dense(m: DataFrame, label: str) -> DataFrame:
    """Labels 1, 2, 3, ... in order (0 stays): ranked over distinct labels, not pixels."""
    ids = m.where(F.col(label) != 0).select(label).distinct().withColumn("_d", F.row_number().over(Window.orderBy(label)))
    return m.join(ids, label, "left").withColumn("dense", F.coalesce("_d", F.lit(0))).drop("_d")


NEIGHBOURS = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx, dy) != (0, 0)]


def neighbour_correlation(stack: DataFrame, frame: str = "f") -> DataFrame:
    """Mean correlation of each pixel's series with its eight neighbours'; rows (x, y, frame, v)."""
    return neighbour_correlation_by(stack.withColumn("_k", F.lit(0)), "_k", frame).drop("_k")


def neighbour_correlation_by(stack: DataFrame, key: str, frame: str = "f") -> DataFrame:
    """The same for every key. Each sample is sent to four of its neighbours and met by an equi-join; the correlation of a pair counts
    for both."""
    shifts = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in NEIGHBOURS if (dx, dy) > (0, 0)])
    sent = stack.select(F.explode(shifts).alias("s"), key, "x", "y", frame, F.col("v").alias("w"))
    sent = sent.select(key, (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"), frame, "w", "s")
    c = stack.join(sent, [key, "x", "y", frame]).groupBy(key, "x", "y", "s").agg(corr("v", "w").alias("c"))
    other = F.struct((F.col("x") - F.col("s.dx")).alias("x"), (F.col("y") - F.col("s.dy")).alias("y"))
    both = c.select(key, "c", F.explode(F.array(F.struct("x", "y"), other)).alias("p")).select(key, "c", "p.x", "p.y")
    return both.groupBy(key, "x", "y").agg(F.avg(F.when(~F.isnan("c"), F.col("c"))).alias("corr"))


def best_shift(a: DataFrame, b: DataFrame, most: int) -> DataFrame:
    """(dx, dy) within ``most`` that gives the least mean squared difference of images (x, y, v)."""
    r = F.sequence(F.lit(-most), F.lit(most))
    s = b.select(F.explode(r).alias("dx"), "x", "y", F.col("v").alias("w")).select("dx", F.explode(r).alias("dy"), "x", "y", "w")
    s = s.select("dx", "dy", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), "w")
    d = F.col("v") - F.col("w")
    score = a.join(s, ["x", "y"]).groupBy("dx", "dy").agg(F.avg(d * d).alias("mse"))
    return score.groupBy().agg(F.min_by(F.struct("dx", "dy", "mse"), F.struct("mse", F.abs(F.col("dx")), F.abs(F.col("dy")), "dx", "dy")).alias("r")).select("r.*")


def centres(m: DataFrame, label: str) -> DataFrame:
    return m.where(F.col(label) != 0).groupBy(label).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count(F.lit(1)).alias("pixels"))


def shifted(m: DataFrame, dx: int, dy: int, width: int, height: int, fill: int = 0, label: str = "label") -> DataFrame:
    """Image moved by (dx, dy); what comes in from outside is ``fill``."""
    moved = m.select((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), label)
    grid = m.select("x", "y").where((F.col("x") < width) & (F.col("y") < height))
    return grid.join(moved, ["x", "y"], "left").fillna(fill, [label])


def to_negative(m: DataFrame, label: str = "label") -> DataFrame:
    """Format with background 1 and negative labels."""
    return m.withColumn(label, F.when(F.col(label) == 0, F.lit(1)).otherwise(-F.col(label)))


def to_positive(m: DataFrame, label: str = "label") -> DataFrame:
    """Format with background 0: the largest value is background."""
    return m.withColumn(label, F.when(F.col(label) >= 0, F.lit(0)).otherwise(-F.col(label)))


def connected(m: DataFrame, key: str, label: str, diagonal: bool = False) -> DataFrame:
    """Connected components of equal labels, by flood fill of one image (key) at a time in numpy;
    images are bounded by the recording's frame size."""
    steps = NEIGHBOURS if diagonal else [(-1, 0), (1, 0), (0, -1), (0, 1)]

    def run(pdf):
        at = {(x, y): v for x, y, v in zip(pdf["x"], pdf["y"], pdf[label], strict=True) if v}
        seen, n = {}, 0
        for p in sorted(at):
            if p in seen:
                continue
            n += 1
            todo = [p]
            seen[p] = n
            while todo:
                x, y = todo.pop()
                for dx, dy in steps:
                    q = (x + dx, y + dy)
                    if q not in seen and at.get(q) == at[p]:
                        seen[q] = n
                        todo.append(q)
        return pdf.assign(component=[seen.get((x, y), 0) for x, y in zip(pdf["x"], pdf["y"], strict=True)])[[key, "x", "y", "component"]]

    return m.groupBy(key).applyInPandas(run, f"{key} long, x int, y int, component int")


def block_mean(image: DataFrame, k: int) -> DataFrame:
    return image.groupBy(F.floor(F.col("x") / k).alias("x"), F.floor(F.col("y") / k).alias("y")).agg(F.avg("v").alias("v"))


def pixel_repeat(image: DataFrame, k: int) -> DataFrame:
    r = F.sequence(F.lit(0), F.lit(k - 1))
    one = image.select("v", "y", F.col("x"), F.explode(r).alias("a")).select("v", "y", (F.col("x") * k + F.col("a")).alias("x"))
    return one.select("v", "x", "y", F.explode(r).alias("b")).select("x", (F.col("y") * k + F.col("b")).alias("y"), "v")
