"""Time series in long form: one row a sample, keyed, with an index ``i`` from 1 and a value ``v``.

Everything here is windows and grouped aggregates over the key, so a key's samples are
sorted once and later steps reuse the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def indexed(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Adds ``i`` (place in the key), ``n`` (samples of the key) and ``v``."""
    w = Window.partitionBy(key)
    return df.withColumns({"i": F.row_number().over(w.orderBy(*order)), "n": F.count(F.lit(1)).over(w), "v": F.col(value).cast("double")})


def over(key: str):
    return Window.partitionBy(key)


def _ratio(a: Column, b: Column, other: float | None = 0.0) -> Column:
    return F.when(b == 0, F.lit(other)).otherwise(a / b)


def zscore(v: Column, w) -> Column:
    return _ratio(v - F.avg(v).over(w), F.stddev_pop(v).over(w))


def zero_one(v: Column, w) -> Column:
    return _ratio(v - F.min(v).over(w), F.max(v).over(w) - F.min(v).over(w))


def soft_zero_one(v: Column, w, dq: float = 5.0, clip: bool = True) -> Column:
    low, high = (F.percentile(v, F.lit(q / 100)).over(w) for q in (dq, 100 - dq))
    x = _ratio(v - low, high - low)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) if clip else x


def amp_one(v: Column, w) -> Column:
    return _ratio(v, F.max(F.abs(v)).over(w))


def std_one(v: Column, w) -> Column:
    return _ratio(v, F.stddev_pop(v).over(w))


NORMALISERS = {"zscore": zscore, "zero_one": zero_one, "soft_zero_one": soft_zero_one, "amp_one": amp_one, "std_one": std_one, "amp_std": std_one}


def normalise(df: DataFrame, key: str, kind: str, value: str = "v") -> DataFrame:
    return df.withColumn(kind, NORMALISERS[kind](F.col(value), over(key)))


def difference(df: DataFrame, key: str, positive: bool = False) -> DataFrame:
    """Step from the sample before (0 for the first), optionally rectified."""
    d = F.col("v") - F.coalesce(F.lag("v").over(over(key).orderBy("i")), F.col("v"))
    return df.withColumn("dv", F.greatest(d, F.lit(0.0)) if positive else d)


def robust_events(df: DataFrame, key: str, n_sigma: float = 1.0) -> DataFrame:
    """Local peaks above ``n_sigma`` times median(|v|) / 0.6745, else 0."""
    w = over(key).orderBy("i")
    sigma = F.percentile(F.abs(F.col("v")), F.lit(0.5)).over(over(key)) / F.lit(0.6745)
    peak = (F.col("v") > F.lag("v").over(w)) & (F.col("v") > F.lead("v").over(w)) & (F.col("v") >= sigma * n_sigma)
    return df.withColumn("peak", F.when(peak, F.col("v")).otherwise(F.lit(0.0)))


def baseline_subtract(df: DataFrame, key: str, start: str, most: int | None = None) -> DataFrame:
    """Minus the median of the samples before the one that precedes ``start`` (the last ``most`` of them, if given);
    unchanged without any."""
    before = F.col("i") < F.col(start) - 1
    if most is not None:
        before = before & (F.col("i") >= F.col(start) - 1 - most)
    base = F.percentile(F.when(before, F.col("v")), F.lit(0.5)).over(over(key))
    return df.withColumn("vb", F.col("v") - F.coalesce(base, F.lit(0.0)))


def standardise_baseline(df: DataFrame, key: str, start: str) -> DataFrame:
    sd = F.stddev_pop(F.when(F.col("i") < F.col(start) - 1, F.col("v"))).over(over(key))
    return df.withColumn("vs", _ratio(F.col("v"), sd, None))


def dff(df: DataFrame, key: str, low: float = 2.5, high: float = 80.0) -> DataFrame:
    a, b = (F.percentile("v", F.lit(q / 100)).over(over(key)) for q in (low, high))
    return df.withColumn("dff", F.when(b - a <= 0, F.col("v")).otherwise((F.col("v") - a) / (b - a)))


def non_negative(df: DataFrame, key: str) -> DataFrame:
    low = F.percentile("v", F.lit(0.025)).over(over(key))
    return df.withColumn("vp", F.greatest(F.col("v") - low, F.lit(0.0)))


def edge_repair(df: DataFrame, key: str, most: int = 3) -> DataFrame:
    """Up to ``most`` samples at each end that lie outside the range of the others take the
    value of the first sample inwards that does not."""
    w = over(key)
    inner = (F.col("i") > most) & (F.col("i") <= F.col("n") - most)
    low, high = F.min(F.when(inner, F.col("v"))).over(w), F.max(F.when(inner, F.col("v"))).over(w)
    df = df.withColumn("_out", (F.col("v") < low) | (F.col("v") > high))
    left = F.least(F.coalesce(F.min(F.when((F.col("i") <= most) & ~F.col("_out"), F.col("i"))).over(w), F.lit(most + 1)), F.lit(most + 1))
    right = F.greatest(F.coalesce(F.max(F.when((F.col("i") > F.col("n") - most) & ~F.col("_out"), F.col("i"))).over(w), F.col("n") - most), F.col("n") - most)
    df = df.withColumns({"_l": left, "_r": right})
    at = F.when(F.col("i") < F.col("_l"), F.col("_l")).when(F.col("i") > F.col("_r"), F.col("_r"))
    first = F.max(F.when(F.col("i") == F.col("_l"), F.col("v"))).over(w)
    last = F.max(F.when(F.col("i") == F.col("_r"), F.col("v"))).over(w)
    return df.withColumn("vr", F.when(at.isNull() | (F.col("n") <= 2 * most), F.col("v")).when(F.col("i") < F.col("_l"), first).otherwise(last)).drop("_out", "_l", "_r")


def mean_step(df: DataFrame, key: str, time: str) -> DataFrame:
    """Mean step of each key and the largest relative deviation from it."""
    d = df.withColumn("_d", F.col(time) - F.lag(time).over(over(key).orderBy("i"))).groupBy(key)
    return d.agg(F.avg("_d").alias("dt"), F.max("_d").alias("_x"), F.min("_d").alias("_m")).select(
        key, "dt", (F.greatest(F.col("_x") - F.col("dt"), F.col("dt") - F.col("_m")) / F.col("dt")).alias("rel_error")
    )


def block_mean(df: DataFrame, key: str, k: int) -> DataFrame:
    """Means of full blocks of ``k`` samples."""
    g = df.groupBy(key, F.floor((F.col("i") - 1) / k).alias("block")).agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("_c"))
    return g.where(F.col("_c") == k).drop("_c")


def repeat_up(df: DataFrame, key: str, k: int) -> DataFrame:
    """Each sample ``k`` times."""
    return df.select(key, "i", "v", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("sub"))


def linear_up(df: DataFrame, key: str, k: int) -> DataFrame:
    """``k`` points a step, linear between samples, held at the last."""
    nxt = F.coalesce(F.lead("v").over(over(key).orderBy("i")), F.col("v"))
    d = df.withColumn("_n", nxt).select(key, "i", "v", "_n", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("sub"))
    return d.select(key, "i", "sub", (F.col("v") + (F.col("_n") - F.col("v")) * F.col("sub") / F.lit(k)).alias("v"))


def resample(df: DataFrame, key: str, time: str, step: int) -> DataFrame:
    """Linear interpolation on a grid of whole ``step`` from the first sample, ends included."""
    w = over(key).orderBy("i")
    d = df.withColumns({"_t0": F.min(time).over(over(key)), "_t1": F.lead(time).over(w), "_v1": F.lead("v").over(w)})
    rel, nxt = F.col(time) - F.col("_t0"), F.col("_t1") - F.col("_t0")
    # Grid points in [t, next): each belongs to one bracket, so there is no join.
    lo, hi = F.ceil(rel / step), F.when(nxt.isNotNull(), F.ceil(nxt / step) - 1).otherwise(F.floor(rel / step))
    d = d.withColumns({"_lo": lo.cast("long"), "_hi": hi.cast("long")}).where("_lo <= _hi")
    d = d.select(key, F.explode(F.sequence("_lo", "_hi")).alias("g"), rel.alias("_r"), nxt.alias("_n"), "v", "_v1")
    part = (F.col("g") * step - F.col("_r")) / (F.col("_n") - F.col("_r"))
    return d.select(key, "g", F.when(F.col("_n").isNull(), F.col("v")).otherwise(F.col("v") + (F.col("_v1") - F.col("v")) * part).alias("v"))


def savgol_detrend(df: DataFrame, key: str, half: int, order: int) -> DataFrame:
    """Savitzky-Golay trend (weights of a local polynomial, edge values repeated) and what is left:
    a weighted sum over a window of 2 half + 1 samples, all in the JVM."""
    from epochal.functions.kernels import savgol_weights

    w = over(key).orderBy("i")
    first, last = F.first("v").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.last("v").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    d = df.withColumns({"_f": first, "_l": last})
    trend = F.lit(0.0)
    for k, c in zip(range(-half, half + 1), savgol_weights(half, order), strict=True):
        x = F.col("v") if k == 0 else F.lead("v", k).over(w) if k > 0 else F.lag("v", -k).over(w)
        trend = trend + F.lit(float(c)) * F.coalesce(x, F.col("_l") if k > 0 else F.col("_f"))
    d = d.withColumn("trend", trend)
    return d.withColumn("residual", F.col("v") - F.col("trend")).drop("_f", "_l")


def by_kernel(df: DataFrame, key: str, kernel, schema: str) -> DataFrame:
    """A numpy kernel over each key's samples in order (one key in memory at a time)."""

    def run(pdf):
        return kernel(pdf.sort_values("i"))

    return df.groupBy(key).applyInPandas(run, schema)


def clip_unit(df: DataFrame, key: str, bound: float = 7.0) -> DataFrame:
    return df.withColumn("vc", F.greatest(F.lit(-bound), F.least(F.lit(bound), std_one(F.col("v"), over(key)))))


def process(df: DataFrame, key: str, half: int = 0, order: int = 3, baseline: bool = False, positive: bool = False, standardise: int = 0, is_trigger: Column | None = None, cutoff: float = 0.0, fs: float = 1.0, baseline_most: int | None = None) -> DataFrame:
    """The preprocessing chain, in this order: edge repair, low-pass (``cutoff`` Hz at ``fs``), trend of
    2 ``half`` + 1 samples, baseline before the first trigger, no negatives, and the standard deviation
    of the baseline (1) or of all samples (2). ``baseline_most`` bounds the samples whose median is taken off, not
    those of the deviation. A step that is off leaves ``v`` as it is; ``resample`` and
    ``block_mean`` may follow."""
    from epochal.functions.kernels import lowpass

    columns = df.columns
    d = edge_repair(df, key).withColumn("v", F.col("vr")).drop("vr")
    if cutoff > 0:
        schema = d.schema

        def smooth(pdf):
            return pdf.assign(v=lowpass(pdf["v"].to_numpy(float), fs, cutoff))

        d = by_kernel(d, key, smooth, schema)
    if half > 0:
        d = savgol_detrend(d, key, half, order).withColumn("v", F.col("residual")).drop("residual", "trend")
    if is_trigger is not None:
        d = d.withColumn("_start", F.min(F.when(is_trigger, F.col("i"))).over(over(key)))
        if baseline:
            d = baseline_subtract(d, key, "_start", baseline_most).withColumn("v", F.col("vb")).drop("vb")
    elif baseline or standardise == 1:
        raise ValueError("a baseline needs triggers")
    if positive:
        d = non_negative(d, key).withColumn("v", F.col("vp")).drop("vp")
    if standardise == 1:
        d = standardise_baseline(d, key, "_start").withColumn("v", F.col("vs")).drop("vs")
    elif standardise == 2:
        d = d.withColumn("v", std_one(F.col("v"), over(key)))
    return d.select(*columns)
