"""As-of joins, epochs around triggers, averages and quality of repeats.

Samples carry ``i`` (index in the key).  Triggers are rows of the same or another table.
As-of joins are a union of both sides and one running window per key: linear, with no
non-equi join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epochal.functions.scalars import corr


def asof(targets: DataFrame, data: DataFrame, key: str, time: str, value: str, how: str = "backward", tolerance: float | None = None) -> DataFrame:
    """Each target with the nearest datum before it, after it, or on either side (the earlier of two
    equally near): columns ``m_time``, ``m_value``; null where none is within the tolerance."""
    both = targets.withColumns({"_side": F.lit(1), "_v": F.lit(None).cast("double"), "_t": F.lit(None).cast("long")}).unionByName(
        data.select(key, time, F.col(value).cast("double").alias("_v"), F.col(time).cast("long").alias("_t"), F.lit(0).alias("_side")), allowMissingColumns=True
    )
    datum = F.when(F.col("_side") == 0, F.struct(F.col("_t").alias("t"), F.col("_v").alias("v")))
    w = Window.partitionBy(key)
    # Data sort before targets of the same time looking back, and after them looking forward.
    back = F.last(datum, ignorenulls=True).over(w.orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0))
    fore = F.last(datum, ignorenulls=True).over(w.orderBy(F.col(time).desc(), "_side").rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumns({k: v for k, v in (("_b", back), ("_f", fore)) if how in ("nearest", {"_b": "backward", "_f": "forward"}[k])})
    if how == "nearest":
        near = F.when(F.col("_f").isNull() | (F.col(time) - F.col("_b.t") <= F.col("_f.t") - F.col(time)), F.col("_b")).otherwise(F.col("_f"))
        both = both.withColumn("_m", near)
    else:
        both = both.withColumn("_m", F.col("_b" if how == "backward" else "_f"))
    ok = F.lit(True) if tolerance is None else F.abs(F.col("_m.t") - F.col(time)) <= tolerance
    out = both.where("_side = 1")
    return out.select(*targets.columns, F.when(ok, F.col("_m.t")).alias("m_time"), F.when(ok, F.col("_m.v")).alias("m_value"))


def ffill_lookup(rows: DataFrame, dated: list[tuple], date: str, columns: list[str]) -> DataFrame:
    """Value of a small dated table that holds at each row's date: the last entry not after it that
    has a value.  The table is a literal, so this is an expression, not a join."""
    out = rows
    for n, c in enumerate(columns):
        known = sorted((d[0], d[n + 1]) for d in dated if d[n + 1] is not None)
        expr = F.lit(None).cast("double")
        for day, v in known:
            expr = F.when(F.col(date) >= F.lit(day).cast("date"), F.lit(float(v))).otherwise(expr)
        out = out.withColumn(c, expr)
    return out


def epoch_starts(samples: DataFrame, key: str, is_trigger, every: int = 1) -> DataFrame:
    """(key, start, k, rep): starts of epochs at every n-th trigger, length k the floored median step (of a lone
    epoch: to the end of the trace); every epoch that is not complete is dropped."""
    w = Window.partitionBy(key).orderBy("i")
    t = samples.where(is_trigger).select(key, F.col("i").alias("start"), "n", F.row_number().over(w).alias("_r")).where((F.col("_r") - 1) % every == 0)
    w = Window.partitionBy(key).orderBy("start")
    t = t.withColumn("_d", F.lead("start").over(w) - F.col("start"))
    step = F.floor(F.percentile("_d", F.lit(0.5)).over(Window.partitionBy(key))).cast("int")
    t = t.withColumn("k", F.coalesce(step, (F.col("n") - F.col("start") + 1).cast("int")))
    t = t.where(F.col("start") + F.col("k") - 1 <= F.col("n"))
    return t.select(key, "start", "k", F.row_number().over(w).alias("rep"))


def snippets(samples: DataFrame, starts: DataFrame, key: str) -> DataFrame:
    """(key, rep, t, v): samples of each epoch.  Epochs are unrolled to sample indices, so the
    join is an equi-join, and epochs may overlap."""
    want = starts.select(key, "rep", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("t"), "start").withColumn("i", F.col("start") + F.col("t"))
    return want.join(samples.select(key, "i", "v"), [key, "i"]).select(key, "rep", "t", "v")


def averages(s: DataFrame, key: str) -> DataFrame:
    """Mean over repeats; keys with fewer than two repeats are left out."""
    return s.groupBy(key, "t").agg(F.avg("v").alias("average"), F.count(F.lit(1)).alias("reps")).where("reps > 1")


def repeat_qi(s: DataFrame, key: str) -> DataFrame:
    """Quality: variance of the mean response over the mean variance of the repeats.  Both come from one unrolling of the
    snippets, each sample once for its time and once for its repeat."""
    axis = F.explode(F.array(F.struct(F.lit(0).alias("a"), F.col("t").cast("long").alias("u")), F.struct(F.lit(1).alias("a"), F.col("rep").cast("long").alias("u"))))
    part = s.select(key, "v", axis.alias("x")).groupBy(key, "x.a", "x.u").agg(F.avg("v").alias("m"), F.var_pop("v").alias("s"))
    g = part.groupBy(key).agg(F.var_pop(F.when(F.col("a") == 0, F.col("m"))).alias("p"), F.avg(F.when(F.col("a") == 1, F.col("s"))).alias("b"), F.count(F.when(F.col("a") == 1, F.lit(1))).alias("reps"))
    return g.select(key, F.when(F.col("b") != 0, F.col("p") / F.col("b")).alias("qidx"), (F.lit(1.0) / F.col("reps")).alias("min_qidx"))


def repeat_correlation(s: DataFrame, key: str) -> DataFrame:
    """Mean correlation over pairs of repeats (a before b).  Repeats of a key meet pairwise by definition;
    moments are summed in the JVM and nothing is collected."""
    a, b = s.select(key, "t", F.col("rep").alias("ra"), F.col("v").alias("va")), s.select(key, "t", F.col("rep").alias("rb"), F.col("v").alias("vb"))
    c = a.join(b, [key, "t"]).where("ra < rb").groupBy(key, "ra", "rb").agg(corr("va", "vb").alias("c"))
    return c.groupBy(key).agg(F.avg(F.when(~F.isnan("c"), F.col("c"))).alias("rep_corr"))


def align_to_stimulus(samples: DataFrame, key: str, time: str, is_frame) -> DataFrame:
    """Mean of the samples in each half-open stimulus interval: frames number the samples behind them."""
    frame = F.sum(F.when(is_frame, 1).otherwise(0)).over(Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return samples.withColumn("frame", frame).where("frame > 0").groupBy(key, "frame").agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("samples"))


def rising_edges(samples: DataFrame, key: str, threshold: float, gap: int = 0) -> DataFrame:
    """Samples at or above the threshold after one below it, at least ``gap`` after the onset before."""
    w = Window.partitionBy(key).orderBy("i")
    up = (F.col("v") >= threshold) & (F.lag("v").over(w) < threshold)
    on = samples.withColumn("_up", up).where("_up").drop("_up")
    before = F.lag("i").over(w)
    return on.withColumn("_g", F.col("i") - before).where(F.col("_g").isNull() | (F.col("_g") >= gap)).drop("_g")


def pulses(samples: DataFrame, key: str, threshold: float) -> DataFrame:
    """(key, start, width, peak) of each run of samples at or above the threshold."""
    w = Window.partitionBy(key)
    high = samples.where(F.col("v") >= threshold).withColumn("_g", F.col("i") - F.row_number().over(w.orderBy("i")))
    return high.groupBy(key, "_g").agg(F.min("i").alias("start"), F.count(F.lit(1)).alias("width"), F.max("v").alias("peak")).drop("_g")


def valid_triggers(samples: DataFrame, key: str, time: str, is_trigger) -> DataFrame:
    """Are all triggers within the trace?  Without triggers: yes."""
    t = F.when(is_trigger, F.col(time))
    g = samples.groupBy(key).agg(F.min(time).alias("a"), F.max(time).alias("b"), F.min(t).alias("c"), F.max(t).alias("d"))
    return g.select(key, F.coalesce((F.col("c") >= F.col("a")) & (F.col("d") <= F.col("b")), F.lit(True)).alias("valid"))
