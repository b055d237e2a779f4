"""Response indices, tuning, receptive fields: grouped aggregates over long-form responses."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochal.functions.scalars import corr


def contrast(a: Column, b: Column) -> Column:
    """(a - b) / (a + b), 0 where the sum is tiny."""
    return F.when(F.abs(a + b) < 1e-9, F.lit(0.0)).otherwise((a - b) / (a + b))


def _mean_in(t: str, v: Column, lo: int, hi: int) -> Column:
    return F.avg(F.when((F.col(t) >= lo) & (F.col(t) < hi), v))


def on_off_index(s: DataFrame, key: str, on: tuple[int, int], off: tuple[int, int], base: int) -> DataFrame:
    """Rectified mean responses above the median baseline of each repeat, contrasted, averaged over repeats."""
    med = F.percentile(F.when(F.col("t") < base, F.col("v")), F.lit(0.5)).over(Window.partitionBy(key, "rep"))
    r = s.withColumn("_x", F.greatest(F.col("v") - med, F.lit(0.0)))
    g = r.groupBy(key, "rep").agg(F.coalesce(_mean_in("t", F.col("_x"), *on), F.lit(0.0)).alias("a"), F.coalesce(_mean_in("t", F.col("_x"), *off), F.lit(0.0)).alias("b"))
    return g.groupBy(key).agg(F.avg(contrast(F.col("a"), F.col("b"))).alias("on_off"))


def polarity_index(avg: DataFrame, key: str, on: tuple[int, int], off: tuple[int, int]) -> DataFrame:
    x = F.greatest(F.col("average"), F.lit(0.0))
    g = avg.groupBy(key).agg(F.coalesce(_mean_in("t", x, *on), F.lit(0.0)).alias("a"), F.coalesce(_mean_in("t", x, *off), F.lit(0.0)).alias("b"))
    return g.select(key, contrast(F.col("a"), F.col("b")).alias("polarity"))


def tonic_release(avg: DataFrame, key: str, lo: int, hi: int) -> DataFrame:
    """Share of the area below the mean."""
    c = avg.withColumn("_c", F.col("average") - F.avg("average").over(Window.partitionBy(key))).where((F.col("t") >= lo) & (F.col("t") < hi))
    g = c.groupBy(key).agg(F.sum(F.when(F.col("_c") < 0, -F.col("_c")).otherwise(0.0)).alias("a"), F.sum(F.abs("_c")).alias("b"))
    return g.select(key, F.when(F.col("b") > 0, F.col("a") / F.col("b")).otherwise(F.lit(0.0)).alias("tonic"))


def plateau_index(avg: DataFrame, key: str, after: int, width: int) -> DataFrame:
    """Mean of ``width`` samples from ``after`` behind the peak (the first one), over the peak; -1 without."""
    w = Window.partitionBy(key)
    p = avg.withColumn("_p", F.min_by("t", F.struct(-F.col("average"), F.col("t"))).over(w)).withColumn("_m", F.max("average").over(w))
    g = p.groupBy(key).agg(F.max("_m").alias("m"), F.avg(F.when((F.col("t") >= F.col("_p") + after) & (F.col("t") < F.col("_p") + after + width), F.col("average"))).alias("a"))
    return g.select(key, F.when((F.col("m") > 0) & F.col("a").isNotNull(), F.col("a") / F.col("m")).otherwise(F.lit(-1.0)).alias("plateau"))


def percentile_contrast(avg: DataFrame, key: str, n: int) -> DataFrame:
    """95th percentiles of the first and last third of ``n`` samples, and their contrast."""
    p = lambda lo, hi: F.percentile(F.when((F.col("t") >= lo) & (F.col("t") < hi), F.col("average")), F.lit(0.95))
    g = avg.groupBy(key).agg(p(0, n // 3).alias("first_p95"), p(n - n // 3, n).alias("last_p95"))
    return g.select(key, "first_p95", "last_p95", contrast(F.col("first_p95"), F.col("last_p95")).alias("ratio"))


def vector_sum(r: DataFrame, key: str, direction: str, response: str, n_dirs: int, per: int = 1) -> DataFrame:
    """Selectivity (length of the vector sum, corrected for bin width) and preferred angle, of evenly spaced directions 0..n-1."""
    step = per * 2 * math.pi / n_dirs
    a = F.col(direction) * F.lit(step)
    g = r.groupBy(key).agg(F.sum(F.col(response) * F.cos(a)).alias("x"), F.sum(F.col(response) * F.sin(a)).alias("y"), F.sum(response).alias("s"))
    angle = F.atan2("y", "x") / per
    angle = F.when((F.lit(per) == 2) & (angle < 0), angle + F.lit(math.pi)).otherwise(angle)
    index = F.lit(step / (2 * math.sin(step / 2))) * F.hypot("x", "y") / F.col("s")
    return g.select(key, F.when(F.col("s") != 0, index).alias("si"), angle.alias("preferred"))


def direction_qi(r: DataFrame, key: str) -> DataFrame:
    """Largest over directions of var(mean response) / mean(var of repeats); rows (key, d, rep, t, v)."""
    m = r.groupBy(key, "d", "t").agg(F.avg("v").alias("m")).groupBy(key, "d").agg(F.var_pop("m").alias("a"))
    p = r.groupBy(key, "d", "rep").agg(F.var_pop("v").alias("x")).groupBy(key, "d").agg(F.avg("x").alias("b"))
    return m.join(p, [key, "d"]).groupBy(key).agg(F.max(F.when(F.col("b") != 0, F.col("a") / F.col("b"))).alias("qi"))


def first_harmonic(avg: DataFrame, key: str, period: int) -> DataFrame:
    a = F.col("t") * F.lit(2 * math.pi / period)
    g = avg.groupBy(key).agg(F.sum(F.col("average") * F.cos(a)).alias("x"), F.sum(F.col("average") * F.sin(a)).alias("y"), F.count(F.lit(1)).alias("n"))
    return g.select(key, (F.lit(2.0) * F.hypot("x", "y") / F.col("n")).alias("amplitude"), F.atan2("y", "x").alias("phase"))


def line_fit(s: DataFrame, key: str, x: str, y: str) -> DataFrame:
    return s.groupBy(key).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def sta(samples: DataFrame, key: str, stimulus: str, response: str, lags: int) -> DataFrame:
    """Spike-triggered average: w(lag) = sum of stimulus x response over sum of responses.
    Lags are window offsets of one sorted partition; there is no self-join."""
    w = Window.partitionBy(key).orderBy("i")
    each = F.array(*[F.struct(F.lit(k).alias("lag"), F.coalesce(F.lag(stimulus, k).over(w), F.lit(0.0)).alias("x")) if k else F.struct(F.lit(0).alias("lag"), F.col(stimulus).alias("x")) for k in range(lags)])
    d = samples.withColumn("_e", each).select(key, F.col(response).alias("y"), F.explode("_e").alias("e")).select(key, "y", "e.*")
    return d.groupBy(key, "lag").agg((F.sum(F.col("x") * F.col("y")) / F.sum("y")).alias("w"))


def predict(samples: DataFrame, rf: DataFrame, key: str, stimulus: str, lags: int, rectify: bool = False) -> DataFrame:
    """Response of a linear filter: weights become one array a key, samples get their lags by window."""
    w = Window.partitionBy(key).orderBy("i")
    arr = rf.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("lag", "w"))), lambda x: x["w"]).alias("_w"))  # ``lags`` items
    xs = F.array(*[F.coalesce(F.lag(stimulus, k).over(w), F.lit(0.0)) if k else F.col(stimulus) for k in range(lags)])
    y = F.aggregate(F.zip_with("_x", "_w", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return samples.withColumn("_x", xs).join(arr, key).withColumn("pred", F.greatest(y, F.lit(0.0)) if rectify else y).drop("_x", "_w")


def split(samples: DataFrame, train: float = 0.8, dev: float = 0.1) -> DataFrame:
    """Contiguous train, dev and test parts by share of each key's samples."""
    a, b = F.floor(F.col("n") * train), F.floor(F.col("n") * (train + dev))
    return samples.withColumn("part", F.when(F.col("i") <= a, "train").when(F.col("i") <= b, "dev").otherwise("test"))


def explained_variance(df: DataFrame, key: str, y: str, fit: str) -> DataFrame:
    v = F.var_pop(y)
    return df.groupBy(key).agg(F.when(v != 0, 1 - F.var_pop(F.col(y) - F.col(fit)) / v).alias("explained"), corr(y, fit).alias("cc"), F.avg((F.col(y) - F.col(fit)) * (F.col(y) - F.col(fit))).alias("mse"))


def permutation_p(r: DataFrame, key: str, direction: str, response: str, n_dirs: int, n: int = 100, seed: int = 1) -> DataFrame:
    """Share of seeded shuffles of directions whose vector sum exceeds the observed one.
    Shuffles are hash orders within the key, so reruns and lost tasks agree."""
    obs = vector_sum(r, key, direction, response, n_dirs).select(key, F.col("si").alias("obs"))
    x = r.select(key, F.col(direction).alias("d"), F.col(response).alias("y"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("shuffle"))
    h = F.xxhash64(F.lit(seed), "shuffle", "d", key)
    a = Window.partitionBy(key, "shuffle")
    x = x.withColumns({"_n": F.row_number().over(a.orderBy(h)), "_o": F.row_number().over(a.orderBy("d"))})
    moved = x.select(key, "shuffle", F.col("_n").alias("_o"), "y").join(x.select(key, "shuffle", "_o", "d"), [key, "shuffle", "_o"])
    null = vector_sum(moved.withColumn("_k", F.struct(key, "shuffle")), "_k", "d", "y", n_dirs).select(F.col(f"_k.{key}").alias(key), "si")
    return null.join(obs, key).groupBy(key).agg(F.avg(F.when(F.col("si") > F.col("obs"), 1.0).otherwise(0.0)).alias("p_value"))
