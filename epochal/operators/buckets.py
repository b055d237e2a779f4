"""Windows over keys too long for a task: a key is cut in buckets of its order, each is worked alone, and what a bucket needs of those before it
(a count, the last value, a filter's state) is carried by a small second pass over one row a bucket.

``bucket`` is a column that never falls along the order, such as ``floor(time / width)``.  A bucket's rows must fit a
task, and a key's buckets (one short row each) too.  Results are those of the unbucketed operators.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochal.functions.kernels import butterworth
from epochal.functions.shared import written


def _before(key: str):
    return Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)


def _after(key: str):
    return Window.partitionBy(key).orderBy("_b").rowsBetween(1, Window.unboundedFollowing)


def _placed(df: DataFrame, key: str, order: list[str], bucket: Column) -> DataFrame:
    """Adds ``_i``, a row's place in its key, and ``_n``, the key's rows."""
    d = df.withColumn("_b", bucket)
    counts = d.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_c"))
    carried = counts.select(key, "_b", F.coalesce(F.sum("_c").over(_before(key)), F.lit(0)).alias("_above"), F.sum("_c").over(Window.partitionBy(key)).alias("_n"))
    within = F.row_number().over(Window.partitionBy(key, "_b").orderBy(*order))
    return d.withColumn("_r", within).join(carried, [key, "_b"]).select(*df.columns, (F.col("_above") + F.col("_r")).alias("_i"), "_n")


def indexed(df: DataFrame, key: str, order: list[str], value: str, bucket: Column) -> DataFrame:
    """``series.indexed``: ``i`` (place in the key), ``n`` (samples of the key) and ``v``."""
    return _placed(df, key, order, bucket).select(*df.columns, F.col("_i").alias("i"), F.col("_n").alias("n"), F.col(value).cast("double").alias("v"))


def asof(targets: DataFrame, data: DataFrame, key: str, time: str, value: str, bucket, how: str = "backward", tolerance: float | None = None) -> DataFrame:
    """``epochs.asof``; ``bucket`` makes the bucket of a time, for both sides."""
    both = targets.withColumns({"_side": F.lit(1), "_v": F.lit(None).cast("double"), "_t": F.lit(None).cast("long")}).unionByName(
        data.select(key, time, F.col(value).cast("double").alias("_v"), F.col(time).cast("long").alias("_t"), F.lit(0).alias("_side")), allowMissingColumns=True
    )
    both = both.withColumns({"_b": bucket(F.col(time)), "_d": F.when(F.col("_side") == 0, F.struct(F.col("_t").alias("t"), F.col("_v").alias("v")))})
    known = F.when(F.col("_side") == 0, F.struct("_t", "_v"))
    # Of equal times the running window takes whichever sorts last; ends take the largest value, as does the order below.
    ends = both.groupBy(key, "_b").agg(F.max(known).alias("_last"), F.min_by(F.col("_d"), F.when(F.col("_side") == 0, F.struct(F.col("_t"), -F.col("_v")))).alias("_first"))
    ends = ends.select(
        key, "_b",
        F.last(F.when(F.col("_last").isNotNull(), F.struct(F.col("_last._t").alias("t"), F.col("_last._v").alias("v"))), ignorenulls=True).over(_before(key)).alias("_back"),
        F.first("_first", ignorenulls=True).over(_after(key)).alias("_fore"),
    )
    w = Window.partitionBy(key, "_b")
    back = F.last("_d", ignorenulls=True).over(w.orderBy(time, "_side", "_v").rowsBetween(Window.unboundedPreceding, 0))
    fore = F.last("_d", ignorenulls=True).over(w.orderBy(F.col(time).desc(), "_side", "_v").rowsBetween(Window.unboundedPreceding, 0))
    d = both.withColumns({k: v for k, v in (("_near_b", back), ("_near_f", fore)) if how == "nearest" or how == {"_near_b": "backward", "_near_f": "forward"}[k]})
    d = d.where("_side = 1").join(ends, [key, "_b"], "left")
    if how in ("nearest", "backward"):
        d = d.withColumn("_near_b", F.coalesce("_near_b", "_back"))
    if how in ("nearest", "forward"):
        d = d.withColumn("_near_f", F.coalesce("_near_f", "_fore"))
    if how == "nearest":
        nearer = F.col("_near_f").isNull() | (F.col(time) - F.col("_near_b.t") <= F.col("_near_f.t") - F.col(time))
        d = d.withColumn("_m", F.when(nearer, F.col("_near_b")).otherwise(F.col("_near_f")))
    else:
        d = d.withColumn("_m", F.col("_near_b" if how == "backward" else "_near_f"))
    ok = F.lit(True) if tolerance is None else F.abs(F.col("_m.t") - F.col(time)) <= tolerance
    return d.select(*targets.columns, F.when(ok, F.col("_m.t")).alias("m_time"), F.when(ok, F.col("_m.v")).alias("m_value"))


def running_sum(df: DataFrame, key: str, order: list[str], value: str, bucket: Column, name: str = "total") -> DataFrame:
    """Adds the sum of ``value`` up to and with each row."""
    d = df.withColumn("_b", bucket)
    sums = d.groupBy(key, "_b").agg(F.sum(value).alias("_s"))
    carried = sums.select(key, "_b", F.coalesce(F.sum("_s").over(_before(key)), F.lit(0)).alias("_above"))
    own = F.coalesce(F.sum(value).over(Window.partitionBy(key, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return d.withColumn("_own", own).join(carried, [key, "_b"]).select(*df.columns, (F.col("_above") + F.col("_own")).alias(name))


def epoch_starts(samples: DataFrame, key: str, is_trigger: Column, size: int, every: int = 1) -> DataFrame:
    """``epochs.epoch_starts`` of samples with ``i`` and ``n``, in buckets of ``size`` samples: (key, start, k, rep)."""
    t = samples.where(is_trigger).select(key, F.col("i").alias("start"), "n")
    place = F.floor(F.col("start") / size)
    if every > 1:
        t = _placed(t, key, ["start"], place).where((F.col("_i") - 1) % every == 0).drop("_i", "_n")
    t = t.withColumn("_b", place)
    firsts = t.groupBy(key, "_b").agg(F.min("start").alias("_first"))
    nexts = firsts.select(key, "_b", F.first("_first").over(_after(key)).alias("_next"))
    lead = F.lead("start").over(Window.partitionBy(key, "_b").orderBy("start"))
    t = t.withColumn("_l", lead).join(nexts, [key, "_b"]).withColumn("_d", F.coalesce("_l", "_next") - F.col("start"))
    # Steps are counted by their length, so the exact median of a long key holds one number a length.
    steps = t.groupBy(key).agg(F.floor(F.percentile("_d", F.lit(0.5))).cast("int").alias("_step"))
    t = t.join(steps, key).withColumn("k", F.coalesce("_step", (F.col("n") - F.col("start") + 1).cast("int")))
    t = t.where(F.col("start") + F.col("k") - 1 <= F.col("n")).select(key, "start", "k")
    return _placed(t, key, ["start"], place).select(key, "start", "k", F.col("_i").alias("rep"))


class Cascade:
    """Second-order sections in one state: a sample goes through all of them, which keep two numbers each."""

    def __init__(self, sections: np.ndarray, block: int = 64):
        n = 2 * len(sections)
        self.a, self.b, self.c, self.d = np.zeros((n, n)), np.zeros(n), np.zeros(n), 1.0
        for s, (b0, b1, b2, a1, a2) in enumerate(sections):
            z = slice(2 * s, 2 * s + 2)
            take = np.array([b1 - a1 * b0, b2 - a2 * b0])
            self.a[z] += np.outer(take, self.c)
            self.a[z, z] += np.array([[-a1, 1.0], [-a2, 0.0]])
            self.b[z] = take * self.d
            self.c, self.d = b0 * self.c, b0 * self.d
            self.c[2 * s] += 1.0
        self.block = block
        powers = [np.eye(n)]
        for _ in range(block):
            powers.append(self.a @ powers[-1])
        self.out = np.stack([self.c @ p for p in powers[:block]])  # a block's outputs from the state before it
        pulse = np.array([self.d, *(self.c @ p @ self.b for p in powers[: block - 1])])
        self.response = np.array([[pulse[i - j] if i >= j else 0.0 for j in range(block)] for i in range(block)])
        self.step = powers[block]
        self.take = np.stack([powers[block - 1 - i] @ self.b for i in range(block)], 1)

    def settled(self, x: float) -> np.ndarray:
        """The state after ``x`` for ever."""
        return np.linalg.solve(np.eye(len(self.b)) - self.a, self.b * x)

    def run(self, x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(outputs, the state after them)."""
        m = len(x) // self.block
        body = x[: m * self.block].reshape(m, self.block)
        own, add, states = body @ self.response.T, body @ self.take.T, np.empty((m, len(z)))
        for i in range(m):
            states[i] = z
            z = self.step @ z + add[i]
        out = [(own + states @ self.out.T).ravel()]
        rest = []
        for v in x[m * self.block :]:
            rest.append(self.c @ z + self.d * v)
            z = self.a @ z + self.b * v
        return np.concatenate([*out, rest]), z


def _filtered(rows: DataFrame, key: str, sections: np.ndarray, down: bool) -> DataFrame:
    """(key, j, _b, y) of rows (key, j, _b, y) along ``j`` (or against it), settled at the first value."""
    kind = rows.schema[key].dataType.simpleString()
    cascade = Cascade(sections)
    sign = -1 if down else 1

    def along(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        j, y = t["j"].to_numpy(), t["y"].to_numpy()
        order = np.argsort(sign * j)
        return j[order], y[order]

    def ends(t: pa.Table) -> pa.Table:
        _, y = along(t)
        z = cascade.run(y, np.zeros(len(cascade.b)))[1]
        return pa.table({key: t[key].slice(0, 1), "_b": t["_b"].slice(0, 1), "m": pa.array([len(y)], pa.int64()), "x": pa.array([float(y[0])]), "z": pa.array([z.tolist()], pa.list_(pa.float64()))})

    def carry(t: pa.Table) -> pa.Table:
        order = np.argsort(sign * t["_b"].to_numpy())
        m, x, own = t["m"].to_numpy()[order], t["x"].to_numpy()[order], np.array(t["z"].to_pylist())[order]
        z, out = cascade.settled(float(x[0])), []
        for n, e in zip(m.tolist(), own, strict=True):
            out.append(z.tolist())
            z = np.linalg.matrix_power(cascade.a, n) @ z + e
        return pa.table({key: t[key].take(pa.array(order)), "_b": t["_b"].take(pa.array(order)), "z": pa.array(out, pa.list_(pa.float64()))})

    def apply(t: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table({key: t[key], "j": t["j"], "_b": t["_b"], "y": t["y"]})
        order = pa.array(np.argsort(sign * t["j"].to_numpy()))
        y = cascade.run(t["y"].to_numpy()[order.to_numpy()], np.array(t["z"][0].as_py()))[0]
        return pa.table({key: t[key].take(order), "j": t["j"].take(order), "_b": t["_b"].take(order), "y": pa.array(y)})

    states = rows.groupBy(key, "_b").applyInArrow(ends, f"{key} {kind}, _b long, m long, x double, z array<double>")
    carried = states.groupBy(key).applyInArrow(carry, f"{key} {kind}, _b long, z array<double>")
    with_state = rows.join(carried, [key, "_b"]).select(key, "_b", "j", "y", "z")
    return with_state.groupBy(key, "_b").applyInArrow(apply, f"{key} {kind}, j long, _b long, y double")


def lowpass(samples: DataFrame, key: str, fs: float, cutoff: float, size: int = 1 << 16, order: int = 6) -> DataFrame:
    """``kernels.lowpass`` (forward and backward over the mirrored trace) of samples (key, i, n, v) without nulls: (key, i, v), in buckets of ``size`` samples."""
    sections = butterworth(order, cutoff, fs)
    x = samples.select(key, F.col("i").cast("long").alias("i"), F.col("n").cast("long").alias("n"), F.col("v").cast("double").alias("v"))
    edge = x.where((F.col("i") == 1) | (F.col("i") == F.col("n"))).groupBy(key).agg(F.max_by("v", -F.col("i")).alias("_one"), F.max_by("v", "i").alias("_end"))
    pad = F.least(F.col("n") - 1, F.lit(3 * order))
    near = x.where(((F.col("i") > 1) & (F.col("i") <= pad + 1)) | ((F.col("i") < F.col("n")) & (F.col("i") >= F.col("n") - pad))).join(edge, key)
    head = near.where((F.col("i") > 1) & (F.col("i") <= pad + 1)).select(key, (2 - F.col("i")).alias("j"), (2 * F.col("_one") - F.col("v")).alias("y"))
    tail = near.where((F.col("i") < F.col("n")) & (F.col("i") >= F.col("n") - pad)).select(key, (2 * F.col("n") - F.col("i")).alias("j"), (2 * F.col("_end") - F.col("v")).alias("y"))
    whole = x.select(key, F.col("i").alias("j"), F.col("v").alias("y")).unionByName(head).unionByName(tail)
    rows = whole.select(key, "j", F.floor((F.col("j") - 1) / size).cast("long").alias("_b"), "y")
    there = written(_filtered(rows, key, sections, False), "forward")
    back = _filtered(there, key, sections, True)
    return back.join(x.select(key, F.col("i").alias("j")), [key, "j"]).select(key, F.col("j").alias("i"), F.col("y").alias("v"))
