"""Epochs by time: starts near triggers, trials of several names, resampled averages, aligned clocks.

Samples are rows (key, i, n, time, v) with i from 1 and n samples a key; triggers are rows (key, j, time)
with j from 1.  Times are whole numbers of one unit (microseconds, say).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epochal.operators.epochs import asof


def starts(samples: DataFrame, triggers: DataFrame, key: str, time: str, every: int = 1, delay: int = 0, tolerance: int | None = 128_000, pad: bool = False, drop_last: bool = True) -> DataFrame:
    """(key, rep, start, k): the sample nearest to every n-th trigger plus ``delay`` (padded: the last one not after it), and
    the epoch's length, the floored median step (padded: one more).  A lone epoch goes on to the end of the trace.

    A trigger without a sample within the tolerance is an error, as is an incomplete epoch unless ``drop_last``."""
    chosen = triggers.where((F.col("j") - 1) % every == 0).select(key, "j", (F.col(time) + delay).alias(time))
    near = asof(chosen, samples.select(key, time, "i"), key, time, "i", "backward" if pad else "nearest", None if pad else tolerance)
    start = F.when(F.col("m_value").isNull(), F.raise_error(F.lit("no sample near a trigger")).cast("int")).otherwise(F.col("m_value").cast("int"))
    w = Window.partitionBy(key).orderBy("j")
    s = near.select(key, "j", start.alias("start")).withColumn("_d", F.lead("start").over(w) - F.col("start"))
    s = s.join(samples.groupBy(key).agg(F.max("n").alias("n")), key)
    step = F.floor(F.percentile("_d", F.lit(0.5)).over(Window.partitionBy(key))).cast("int") + (1 if pad else 0)
    s = s.withColumn("k", F.coalesce(step, F.col("n") - F.col("start") + 1))
    whole = F.col("start") + F.col("k") - 1 <= F.col("n")
    if not drop_last:
        whole = F.when(whole, F.lit(True)).otherwise(F.raise_error(F.lit("incomplete epoch")).cast("boolean"))
    return s.where(whole).select(key, F.row_number().over(w).alias("rep"), "start", "k")


def offsets(trials: list[tuple]) -> list[tuple[str, int, int]]:
    """(name, place, part) of each part's first trigger in a repeat, from trials (name, triggers[, triggers a part]):
    places are the sums of the triggers before."""
    out, at = [], 0
    for name, n, *part in trials:
        step = part[0] if part and part[0] else n
        out += [(name, at + p, i) for i, p in enumerate(range(0, n, step))]
        at += n
    return out


def group_starts(samples: DataFrame, triggers: DataFrame, key: str, time: str, trials: list[tuple], delay: int = 0, tolerance: int | None = 128_000, incomplete: bool = True) -> DataFrame:
    """(key, name, rep, part, start, end) of each named trial: from the sample nearest to its first trigger plus ``delay`` up to the one
    nearest to the next part's, the last up to the trace's last sample, which it leaves out.

    Triggers without a sample near end the recording, or are an error unless ``incomplete``."""
    total = sum(x[1] for x in trials)
    place = (F.col("j") - 1) % total
    rows = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(name).alias("name"), F.lit(part).alias("part")) for name, p, part in offsets(trials)])
    chosen = triggers.withColumn("_m", F.filter(rows, lambda x: x["p"] == place.cast("int"))).where(F.size("_m") > 0)
    chosen = chosen.select(key, "j", F.col(time).alias("_own"), F.col("_m")[0]["name"].alias("name"), F.col("_m")[0]["part"].alias("part"), (F.col(time) + delay).alias(time))
    data = samples.select(key, time, "i")
    near = asof(chosen, data, key, time, "i", "nearest", tolerance).withColumn("start", F.col("m_value").cast("int")).drop("m_time", "m_value")
    if not incomplete:
        near = near.withColumn("start", F.when(F.col("start").isNull(), F.raise_error(F.lit("incomplete data")).cast("int")).otherwise(F.col("start")))
    near = near.where("start is not null")
    # Where the next part's trigger itself (without the delay) lies.
    stop = asof(near.select(key, "j", "name", "part", "start", F.col("_own").alias(time)), data, key, time, "i", "nearest")
    w = Window.partitionBy(key).orderBy("j")
    stop = stop.withColumn("_e", F.lead(F.col("m_value").cast("int")).over(w)).join(samples.groupBy(key).agg(F.max("n").alias("n")), key)
    rep = F.row_number().over(Window.partitionBy(key, "name", "part").orderBy("j"))
    return stop.select(key, "name", rep.alias("rep"), "part", "start", F.coalesce("_e", "n").alias("end")).where("end > start")


def group_snippets(samples: DataFrame, starts: DataFrame, key: str, stack: str | None = None, tolerance: float = 0.1) -> DataFrame:
    """(key, name, rep, part, t, v) of :func:`group_starts`.  ``pad`` cuts the last repeat of a name to the longest of the others
    (in long form nothing is padded); ``truncate`` cuts all to the shortest, an error where it is over ``tolerance`` shorter."""
    s = starts.withColumn("_k", F.col("end") - F.col("start"))
    by = Window.partitionBy(key, "name", "part")
    if stack == "pad":
        last = F.col("rep") == F.max("rep").over(by)
        s = s.withColumn("_last", last).withColumn("_o", F.max(F.when(~F.col("_last"), F.col("_k"))).over(by))
        s = s.withColumn("_k", F.when(F.col("_last"), F.least("_k", F.coalesce("_o", "_k"))).otherwise(F.col("_k"))).drop("_last", "_o")
    elif stack == "truncate":
        least, most = F.min("_k").over(by), F.max("_k").over(by)
        s = s.withColumn("_k", F.when(most - least <= tolerance * most, least).otherwise(F.raise_error(F.lit("repeats differ in length")).cast("int")))
    elif stack is not None:
        raise ValueError(f"unknown stacking: {stack}")
    want = s.select(key, "name", "rep", "part", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("t"), "start").withColumn("i", F.col("start") + F.col("t"))
    return want.join(samples.select(key, "i", "v"), [key, "i"]).select(key, "name", "rep", "part", "t", "v")


def truncated(series: DataFrame, key: list[str], unit: str, place: str, tolerance: float = 0.05) -> DataFrame:
    """Series of a key cut to the shortest; an error where one is over ``tolerance`` longer."""
    size = series.groupBy(*key, unit).agg((F.max(place) + 1).alias("_k"))
    g = size.groupBy(*key).agg(F.min("_k").alias("_least"), F.max("_k").alias("_most"))
    ok = F.when(F.col("_most") - F.col("_least") <= tolerance * F.col("_most"), F.col("_least")).otherwise(F.raise_error(F.lit("lengths differ")).cast("int"))
    return series.join(g.select(*key, ok.alias("_n")), key).where(F.col(place) < F.col("_n")).drop("_n")


def padded(series: DataFrame, key: list[str], unit: str, place: str, value: str, fill: float | None = None) -> DataFrame:
    """Series of a key filled up to the longest with ``fill``."""
    size = series.groupBy(*key, unit).agg((F.max(place) + 1).alias("_k"))
    longest = Window.partitionBy(*key)
    more = size.withColumn("_n", F.max("_k").over(longest)).where("_k < _n").select(*key, unit, F.explode(F.sequence("_k", F.col("_n") - 1)).alias(place), F.lit(fill).cast("double").alias(value))
    return series.select(*key, unit, place, F.col(value).cast("double").alias(value)).unionByName(more)


def without_empty(reps: DataFrame, key: str) -> DataFrame:
    """Repeats (key, rep, t, v) that hold a number, each cut to the shortest run up to the last number of any."""
    held = reps.groupBy(key, "rep").agg(F.max(F.when(F.col("v").isNotNull() & ~F.isnan("v"), F.col("t"))).alias("_l")).where("_l is not null")
    least = held.withColumn("_m", F.min("_l").over(Window.partitionBy(key))).select(key, "rep", "_m")
    return reps.join(least, [key, "rep"]).where("t <= _m").drop("_m")


def resampled(s: DataFrame, key: str, step: int, duration: DataFrame) -> DataFrame:
    """(key, rep, g, v): each repeat (key, rep, t relative to its first trigger, v) on a grid of ``step`` over the key's ``duration``
    (key, span), linear between samples and held beyond the first and last."""
    by = Window.partitionBy(key, "rep")
    w = by.orderBy("t")
    d = s.join(duration.select(key, F.ceil(F.col("span") / step).cast("long").alias("_g")), key)
    d = d.withColumns({"_t1": F.lead("t").over(w), "_v1": F.lead("v").over(w), "_first": F.row_number().over(w) == 1})
    lo = F.when(F.col("_first"), F.lit(0)).otherwise(F.greatest(F.ceil(F.col("t") / step), F.lit(0)))
    hi = F.least(F.when(F.col("_t1").isNull(), F.col("_g") - 1).otherwise(F.ceil(F.col("_t1") / step) - 1), F.col("_g") - 1)
    d = d.withColumns({"_lo": lo.cast("long"), "_hi": hi.cast("long")}).where("_lo <= _hi")
    d = d.select(key, "rep", F.explode(F.sequence("_lo", "_hi")).alias("g"), "t", "v", "_t1", "_v1")
    part = (F.col("g") * step - F.col("t")) / (F.col("_t1") - F.col("t"))
    inside = F.col("_t1").isNotNull() & (F.col("g") * step >= F.col("t"))
    return d.select(key, "rep", "g", F.when(inside, F.col("v") + (F.col("_v1") - F.col("v")) * part).otherwise(F.col("v")).alias("v"))


def resampled_averages(s: DataFrame, key: str, step: int, duration: DataFrame) -> DataFrame:
    """Mean over repeats on the common grid."""
    return resampled(s, key, step, duration).groupBy(key, "g").agg(F.avg("v").alias("average"))


def median_step(triggers: DataFrame, key: str, time: str) -> DataFrame:
    """(key, span): median time between the first triggers of repeats."""
    d = F.col(time) - F.lag(time).over(Window.partitionBy(key).orderBy("j"))
    return triggers.withColumn("_d", d).groupBy(key).agg(F.percentile("_d", F.lit(0.5)).alias("span")).where("span is not null")


def relative_times(s: DataFrame, key: str, tolerance: float) -> DataFrame:
    """(key, t, time): mean over repeats of the time ``rt`` since each repeat's start; an error where they differ by more than ``tolerance``."""
    g = s.groupBy(key, "t").agg(F.avg("rt").alias("time"), F.stddev_pop("rt").alias("_s"))
    return g.select(key, "t", F.when(F.col("_s") <= tolerance, F.col("time")).otherwise(F.raise_error(F.lit("repeats are not aligned")).cast("double")).alias("time"))


def stimulus_to_trace(samples: DataFrame, frames: DataFrame, key: str, time: str, tolerance: int = 3_000) -> DataFrame:
    """Samples with the stimulus frame ``f`` that is shown: the last one that began at or before the sample, up to ``tolerance`` late."""
    late = frames.select(key, "f", (F.col(time) - tolerance).alias(time))
    near = asof(samples, late.select(key, time, "f"), key, time, "f", "backward")
    return near.withColumn("f", F.col("m_value").cast("int")).drop("m_time", "m_value").where("f is not null")


def trigger_frames(triggers: DataFrame, key: str, time: str, per_trigger: int, n_frames: int) -> DataFrame:
    """(key, f, time): stimulus frames shown at triggers, ``per_trigger`` each, spread over the key's mean step.  Triggers that
    want more frames than there are are an error; frames without trigger are left out."""
    by = Window.partitionBy(key)
    n = F.count(F.lit(1)).over(by)
    step = F.when(n > 1, (F.max(time).over(by) - F.min(time).over(by)) / (n - 1)).otherwise(F.lit(0.0))
    d = triggers.withColumn("_s", step).select(key, "j", F.col(time).alias("_t"), "_s", F.explode(F.sequence(F.lit(0), F.lit(per_trigger - 1))).alias("_p"))
    f = (F.col("j") - 1) * per_trigger + F.col("_p")
    f = F.when(f < n_frames, f).otherwise(F.raise_error(F.lit("more triggers than stimulus frames")).cast("int"))
    return d.select(key, f.cast("int").alias("f"), (F.col("_t") + F.col("_s") * F.col("_p") / per_trigger).cast("long").alias(time))
