"""Features of responses to chirps, spots, bars and noise, and how images compare across conditions.

Averages are rows (key, t, average), snippets (key, rep, t, v), with t the sample's number from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochal.functions.scalars import corr
from epochal.operators.features import contrast
from epochal.operators.series import by_kernel


def _within(lo, hi):
    return (F.col("t") >= lo) & (F.col("t") < hi)


def peak_ratio(avg: DataFrame, key: str, fs: float, after: float, spread: float, on: float = 2.0, until: float = 6.0, invert: bool = False) -> DataFrame:
    """(key, ratio): rectified mean around ``after`` seconds behind the peak over the peak, both above the mean before ``on``; at most 1
    (``invert``: one less that); -1 without a peak."""
    if spread >= after:
        raise ValueError("the spread must be less than the delay")
    a, b, d, w = int(on * fs), int(until * fs), int(after * fs), int(spread * fs)
    by = Window.partitionBy(key)
    base = F.avg(F.when(F.col("t") < a, F.col("average"))).over(by)
    peak = F.min_by(F.when(_within(a, b), F.col("t")), F.when(_within(a, b), F.struct(-F.col("average"), F.col("t")))).over(by)
    g = avg.withColumns({"_x": F.col("average") - base, "_p": peak}).groupBy(key).agg(
        F.max(F.when(F.col("t") == F.col("_p"), F.col("_x"))).alias("p"),
        F.avg(F.when((F.col("t") >= F.col("_p") + d - w) & (F.col("t") <= F.col("_p") + d + w), F.col("_x"))).alias("q"),
    )
    ratio = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("q")) / F.col("p"))
    return g.select(key, F.when(F.col("p") > 1e-9, 1 - ratio if invert else ratio).otherwise(F.lit(-1.0)).alias("ratio"))


def transience(avg: DataFrame, key: str, fs: float, after: float = 0.4, spread: float = 0.15, on: float = 2.0, until: float = 6.0) -> DataFrame:
    """How far the response has fallen ``after`` seconds behind its peak."""
    return peak_ratio(avg, key, fs, after, spread, on, until, True).withColumnRenamed("ratio", "transience")


def step_response(avg: DataFrame, key: str, fs: float, width: float = 2.0, on: float = 2.0, off: float = 5.0) -> DataFrame:
    """(key, on, off, polarity): rectified mean responses to a step up and down, and their contrast (0 where there is none)."""
    part = lambda s: F.greatest(F.coalesce(F.avg(F.when(_within(int(s * fs), int((s + width) * fs)), F.col("average"))), F.lit(0.0)), F.lit(0.0))
    return avg.groupBy(key).agg(part(on).alias("on"), part(off).alias("off")).withColumn("polarity", contrast(F.col("on"), F.col("off")))


def level_contrast(avg: DataFrame, key: str, fs: float, start: float, end: float) -> DataFrame:
    """(key, low, high, index): 95th percentiles of the first and last third of a stretch, and their difference over the sum of their
    sizes (-1 without any)."""
    a, b = int(fs * start), int(fs * end)
    part = lambda lo, hi: F.percentile(F.when(_within(lo, hi), F.col("average")), F.lit(0.95))
    g = avg.groupBy(key).agg(part(a, a + (b - a) // 3).alias("low"), part(b - (b - a) // 3, b).alias("high"))
    size = F.abs("low") + F.abs("high")
    return g.withColumn("index", F.when(size < 1e-9, F.lit(-1.0)).otherwise((F.col("high") - F.col("low")) / size))


def surround(local: DataFrame, whole: DataFrame, key: str) -> DataFrame:
    """(key, strength): median over repeats of the mean response to the whole field less that to the local one, where positive
    (rows key, rep, v)."""
    m = lambda d, n: d.groupBy(key, "rep").agg(F.avg("v").alias("m")).groupBy(key).agg(F.median("m").alias(n))
    return m(local, "l").join(m(whole, "g"), key).select(key, (F.col("g") - F.greatest(F.col("l"), F.lit(0.0))).alias("strength"))


def spot_matrix(snips: DataFrame, key: str, conditions: int, first: int) -> DataFrame:
    """(key, rep, cond, response): median of the first samples of each epoch; epochs run through the conditions in turn.  Values are
    in standard deviations of the trace if the samples are."""
    place = F.col("rep") - 1
    return snips.where(F.col("t") < first).groupBy(key, F.floor(place / conditions).cast("int").alias("rep"), (place % conditions).cast("int").alias("cond")).agg(F.median("v").alias("response"))


def spot_indices(matrix: DataFrame, key: str, small: int, large: int, off: int) -> DataFrame:
    """(key, response_small, response_large, surround, offset) from the medians over repeats of three conditions."""
    m = matrix.groupBy(key, "cond").agg(F.median("response").alias("r")).groupBy(key)
    at = lambda c: F.max(F.when(F.col("cond") == c, F.col("r")))
    g = m.agg(at(small).alias("response_small"), at(large).alias("response_large"), at(off).alias("_o"))
    part = lambda a, b: F.when(F.abs(a) + F.abs(b) < 1e-9, F.lit(0.0)).otherwise((a - b) / (F.abs(a) + F.abs(b)))
    return g.select(key, "response_small", "response_large", part(F.col("response_small"), F.col("response_large")).alias("surround"), part(F.col("response_large"), F.col("_o")).alias("offset"))


def by_direction(snips: DataFrame, key: str, order: list[float]) -> DataFrame:
    """(key, d, rep, t, v): snippets by their direction, d its place among the sorted directions (degrees); snippets run through
    ``order`` in turn, and a number that is no multiple of its length is an error."""
    n = len(order)
    place = {v: i for i, v in enumerate(sorted(order))}
    d = F.array(*[F.lit(place[v]) for v in order])[((F.col("rep") - 1) % n).cast("int")]
    total = F.max("rep").over(Window.partitionBy(key))
    nth = F.floor((F.col("rep") - 1) / n).cast("int")
    return snips.select(key, F.when(total % n == 0, d).otherwise(F.raise_error(F.lit("snippets do not fill the directions")).cast("int")).alias("d"), nth.alias("rep"), "t", "v")


def direction_averages(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key, "d", "t").agg(F.avg("v").alias("v"))


def tuning(rows: DataFrame, key: str, directions: list[float], dt: float, version: int = 2, shuffles: int = 1000, seed: int = 1) -> DataFrame:
    """Direction and orientation tuning of each key's :func:`by_direction` rows: indices, p-values of a seeded permutation test,
    preferred angles (radians), on-off index, quality, and time and direction components.  One key is held at a time."""
    from epochal.functions.tuning import describe

    schema = f"{key} {dict(rows.dtypes)[key]}, ds_index double, ds_pvalue double, pref_dir double, os_index double, os_pvalue double, pref_or double, on_off double, d_qi double, time_component array<double>, dir_component array<double>, surrogate_dsi double"
    angles = sorted(directions)

    def run(k, pdf):
        import pandas as pd

        cube = pdf.pivot_table(index="t", columns=["d", "rep"], values="v").dropna().to_numpy(float)
        out = describe(cube.reshape(len(cube), len(angles), -1), angles, dt, version, shuffles, seed)
        return pd.DataFrame([(k[0], *out)], columns=[c.split()[0] for c in schema.replace("array<double>", "list").split(", ")])

    return rows.groupBy(key).applyInPandas(run, schema)


def fourier_transience(snips: DataFrame, key: str, dt: float, start: int, length: float = 6.0, after: float = 0.4, rate: float = 500.0) -> DataFrame:
    """(key, rep, transience): each repeat resampled to ``rate`` Hz by its Fourier series, and one less its value ``after`` seconds behind the
    peak over the peak, above its least value; from sample ``start`` on."""
    from epochal.functions.tuning import fourier_resample

    def run(pdf):
        x = pdf["v"].to_numpy(float)
        y = fourier_resample(x, max(1, int(len(x) * dt * rate)))
        y = y - y.min()
        part = y[int(start * dt * rate) : int((start * dt + length) * rate)]
        at = int(part.argmax()) if len(part) else 0
        later = part[min(at + int(after * rate), len(part) - 1)] if len(part) else 0.0
        return pdf.iloc[:1].assign(transience=1 - later / part[at] if len(part) and part[at] > 0 else 0.0)[["unit", "transience"]]

    packed = snips.select(F.struct(key, "rep").alias("unit"), F.col("t").alias("i"), "v")
    kind = dict(packed.dtypes)["unit"]
    return by_kernel(packed, "unit", run, f"unit {kind}, transience double").select("unit.*", "transience")


def brightness_share(stack: DataFrame, mask: DataFrame, key: str, artifact: int) -> DataFrame:
    """(key, label, average, index): mean of a region's pixels between the least mean pixel right of the artifact columns (0) and the 99th
    percentile over frames of the median of the first column (1).  Rows (key, x, y, f, v)."""
    pixel = stack.groupBy(key, "x", "y").agg(F.avg("v").alias("m"))
    low = pixel.where(F.col("x") >= artifact).groupBy(key).agg(F.min("m").alias("_l"))
    high = stack.where("x = 0").groupBy(key, "f").agg(F.median("v").alias("_m")).groupBy(key).agg(F.percentile("_m", F.lit(0.99)).alias("_h"))
    r = pixel.join(mask.where("label <> 0"), [key, "x", "y"]).groupBy(key, "label").agg(F.avg("m").alias("average"))
    d = r.join(low, key).join(high, key)
    return d.select(key, "label", "average", F.try_divide(F.col("average") - F.col("_l"), F.col("_h") - F.col("_l")).alias("index"))


def artifact_samples(stack: DataFrame, key: str) -> DataFrame:
    """(key, i, n, v): the first column's pixels in the order of lines, one sample a line."""
    w = Window.partitionBy(key)
    d = stack.where("x = 0")
    return d.select(key, F.row_number().over(w.orderBy("f", "y")).alias("i"), F.count(F.lit(1)).over(w).alias("n"), F.col("v").cast("double").alias("v"))


def shift_scores(a: DataFrame, b: DataFrame, key: str, most: int, metric: str = "mse") -> DataFrame:
    """(key, dx, dy, score) of every shift of image ``b`` within ``most``: minus the mean squared difference from ``a``, or their correlation."""
    r = F.sequence(F.lit(-most), F.lit(most))
    moved = b.select(key, "x", "y", F.col("v").alias("w"), F.explode(r).alias("dx")).select("*", F.explode(r).alias("dy"))
    moved = moved.select(key, (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), "dx", "dy", "w")
    d = F.col("v") - F.col("w")
    score = -F.avg(d * d) if metric == "mse" else corr("v", "w")
    return a.join(moved, [key, "x", "y"]).groupBy(key, "dx", "dy").agg(score.alias("score"))


def best_shifts(scores: DataFrame, key: str) -> DataFrame:
    """(key, dx, dy, score): the shift of largest score, turned round: by how much ``a`` lies off ``b``; the smallest of equal ones."""
    order = F.struct(-F.col("score"), F.abs("dx"), F.abs("dy"), "dx", "dy")
    return scores.groupBy(key).agg(F.min_by(F.struct((-F.col("dx")).alias("dx"), (-F.col("dy")).alias("dy"), "score"), order).alias("r")).select(key, "r.*")


def across(maps: DataFrame, split: str, reference: str, on: list[str], most: int, metric: str = "mse") -> DataFrame:
    """Best shift between the map (on, split, x, y, v) of the ``reference`` condition and that of each other."""
    a = maps.where(F.col(split) == reference)
    b = maps.where(F.col(split) != reference)
    pair = F.struct(*on, F.col(split).alias("other"))
    others = b.select(*on, F.col(split).alias("other")).distinct()
    one = a.drop(split).join(others, on).select(F.struct(*on, "other").alias("pair"), "x", "y", "v")
    return best_shifts(shift_scores(one, b.select(pair.alias("pair"), "x", "y", "v"), "pair", most, metric), "pair").select("pair.*", "dx", "dy", "score")


def mask_relation(a: DataFrame, b: DataFrame, key: str, most: int = 5) -> DataFrame:
    """(key, relation, dx, dy): is label image ``b`` the same as ``a``, ``a`` shifted by at most ``most``, or different?  Rows (key, x, y, label)
    of labelled pixels."""
    r = F.sequence(F.lit(-most), F.lit(most))
    size = lambda d, n: d.groupBy(key).agg(F.count(F.lit(1)).alias(n))
    moved = a.select(key, "x", "y", "label", F.explode(r).alias("dx")).select("*", F.explode(r).alias("dy"))
    moved = moved.select(key, (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), "label", "dx", "dy")
    same = moved.join(b.select(key, "x", "y", "label"), [key, "x", "y", "label"]).groupBy(key, "dx", "dy").agg(F.count(F.lit(1)).alias("n"))
    whole = same.join(size(a, "_a"), key).join(size(b, "_b"), key).where("n = _a AND n = _b")
    best = whole.groupBy(key).agg(F.min_by(F.struct("dx", "dy"), F.struct(F.abs("dx") + F.abs("dy"), "dx", "dy")).alias("s"))
    kind = F.when(F.col("s").isNull(), "different").when((F.col("s.dx") == 0) & (F.col("s.dy") == 0), "same").otherwise("shifted")
    return size(b, "_b").select(key).join(best, key, "left").select(key, kind.alias("relation"), F.col("s.dx").alias("dx"), F.col("s.dy").alias("dy"))


def stack_medians(stack: DataFrame, key: list[str]) -> DataFrame:
    """Median over frames of each pixel, without NaN."""
    return stack.groupBy(*key, "x", "y").agg(F.median(F.nanvl(F.col("v").cast("double"), F.lit(None).cast("double"))).alias("v"))


def centred_shifts(shifts: DataFrame, key: str, onset: int) -> DataFrame:
    """Frame shifts (key, f, dx, dy) less the median of the eleven from ``onset`` on, and the largest distance of a key's: f, dx, dy, most."""
    by = Window.partitionBy(key)
    near = (F.col("f") >= onset) & (F.col("f") < onset + 11)
    d = shifts.withColumns({c: F.col(c) - F.median(F.when(near, F.col(c))).over(by) for c in ("dx", "dy")})
    return d.withColumn("most", F.max(F.greatest(F.abs("dx"), F.abs("dy"))).over(by))


def shifted_frames(stack: DataFrame, shifts: DataFrame, key: str, fill: float) -> DataFrame:
    """Stack rows (key, f, x, y, v) moved by whole shifts (key, f, dx, dy); pixels that nothing moves to take ``fill``."""
    moved = stack.join(shifts.select(key, "f", "dx", "dy"), [key, "f"]).select(key, "f", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), "v")
    return stack.select(key, "f", "x", "y").join(moved, [key, "f", "x", "y"], "left").withColumn("v", F.coalesce("v", F.lit(fill)))


def pixel_shifts(shifts: DataFrame, key: str, fs: float, cutoff: float = 0.2) -> DataFrame:
    """Whole shifts of frames (key, f, dx, dy): low-pass, less the median, rounded."""
    import numpy as np

    from epochal.functions.kernels import lowpass

    def run(pdf):
        out = pdf[[key, "i"]].copy()
        for c in ("dx", "dy"):
            x = lowpass(pdf[c].to_numpy(float), fs, cutoff)
            out[c] = np.round(x - np.median(x)).astype(int)
        return out

    rows = shifts.select(key, F.col("f").alias("i"), "dx", "dy")
    return by_kernel(rows, key, run, f"{key} {dict(rows.dtypes)[key]}, i int, dx int, dy int").withColumnRenamed("i", "f")


def noise_data(samples: DataFrame, triggers: DataFrame, frames: DataFrame, key: str, time: str, per_trigger: int = 1, kind: str = "trace", reference: str = "trace", tolerance: int = 3_000) -> DataFrame:
    """Traces and stimulus on one clock, ready for a filter: rows (key, i, f, s, v).  On the trace's clock each sample has the frame it shows;
    on the stimulus' each frame the mean of its samples.  ``kind``: the trace itself, its positive ``gradient`` or its ``events``; at last it
    is in standard deviations, clipped, and the stimulus (f, s) of -1 and 1 or in deviations from its mean."""
    from epochal.operators import series, trials

    n = frames.count()
    d = samples
    if kind == "gradient":
        d = series.difference(d, key, True).withColumn("v", F.col("dv")).drop("dv")
    elif kind == "events":
        d = series.robust_events(d, key).withColumn("v", F.col("peak")).drop("peak")
    elif kind != "trace":
        raise ValueError(f"unknown kind: {kind}")
    shown = trials.trigger_frames(triggers, key, time, per_trigger, n)
    d = trials.stimulus_to_trace(d.select(key, "i", time, "v"), shown, key, time, tolerance)
    if reference == "stim":
        d = d.groupBy(key, "f").agg(F.avg("v").alias("v")).withColumn("i", F.col("f") + 1)
    elif reference != "trace":
        raise ValueError(f"unknown clock: {reference}")
    d = series.clip_unit(d, key).withColumn("v", F.col("vc")).drop("vc")
    return d.join(frames.select("f", binary_stimulus(frames).alias("s")), "f").select(key, "i", "f", "s", "v")


def timing(past: float, future: float, dt: float) -> dict:
    """Lags of a filter that reaches ``past`` and ``future`` seconds: times, number, shift and samples to leave out at first."""
    import math

    p, f = math.ceil(past / dt), math.ceil(future / dt)
    return {"time": [i * dt for i in range(-p + 1, f + 1)], "lags": p + f, "shift": -f, "burn_in": p}


def binary_stimulus(frames: DataFrame, value: str = "s") -> Column:
    """A stimulus of noughts and ones as -1 and 1, any other in standard deviations from its mean; over all rows, which are summed first."""
    n = frames.agg(F.min(value).alias("l"), F.max(value).alias("h"), F.count_distinct(value).alias("n"), F.avg(value).alias("m"), F.stddev_pop(value).alias("s")).first()
    if n["n"] is not None and n["n"] <= 2 and n["l"] in (0, 1) and n["h"] in (0, 1):
        return F.col(value) * 2.0 - 1.0
    return (F.col(value) - F.lit(n["m"])) / F.lit(n["s"] or 1.0)


def design(samples: DataFrame, key: str, stimulus: str, lags: int, shift: int = 0) -> DataFrame:
    """Samples with ``x``, the stimulus at lags ``shift`` to ``shift`` + lags - 1 (0 outside): window offsets, no self-join."""
    w = Window.partitionBy(key).orderBy("i")
    at = lambda k: F.col(stimulus) if k == 0 else F.lag(stimulus, k).over(w) if k > 0 else F.lead(stimulus, -k).over(w)
    return samples.withColumn("x", F.array(*[F.coalesce(at(k), F.lit(0.0)) for k in range(shift, shift + lags)]))


def least_squares(rows: DataFrame, key: str, response: str) -> DataFrame:
    """(key, w): weights that fit the response best from ``x`` (normal equations; the least norm where they are singular).  Products are
    summed as matrices on the executors (:mod:`epochal.operators.filters`), lags squared a key."""
    from epochal.operators import filters

    return filters.least_squares(rows, key, response)


def shared_design(samples: DataFrame, frames: DataFrame, key: str, on: list[str]) -> DataFrame:
    """(key, p, w): spike-triggered averages of all traces of a presentation against its one design (on, f, x): traces are met by the
    frame they show."""
    d = samples.join(frames, [*on, "f"]).select(key, F.col("v"), F.posexplode("x").alias("p", "_x"))
    return d.groupBy(key, "p").agg((F.sum(F.col("_x") * F.col("v")) / F.sum("v")).alias("w"))


def split_scores(rows: DataFrame, key: str, response: str, fit: str) -> DataFrame:
    """(key, part, cc, mse, n) of predictions on train, dev and test parts."""
    e = F.col(response) - F.col(fit)
    return rows.groupBy(key, "part").agg(corr(response, fit).alias("cc"), F.avg(e * e).alias("mse"), F.count(F.lit(1)).alias("n"))


def last_peaks(peaks: DataFrame, key: str, n: int) -> DataFrame:
    """(key, peaks): the last ``n`` peaks (t, v) in time."""
    return peaks.groupBy(key).agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("t", "v")))), 1, n).alias("_p")).select(key, F.reverse("_p").alias("peaks"))  # a filter's peaks


def top_centres(candidates: DataFrame, key: str, score: str, n: int) -> DataFrame:
    """The ``n`` candidates (x, y) of largest score of each key, ranked."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col(score).desc(), "x", "y"))
    return candidates.withColumn("rank", rank).where(F.col("rank") <= n)
