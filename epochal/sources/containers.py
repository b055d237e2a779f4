"""What recordings hold, from rows of their datasets (path, dataset, shape, values), as ``tables.recordings`` reads them.

Values are in row-major order.  Names are looked up without regard to case; what must be there once is an error when it is there
twice.  Each function is a projection and an unrolling of arrays: one recording's dataset is one row, and goes no further as such.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochal.sources.recordings import labelled, merged_parameters, repair_times, whole_labels


def _only(data: DataFrame, name: Column, what: str) -> DataFrame:
    """The dataset of each path for which ``name`` holds; more than one is an error."""
    d = data.where(name).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("path")))
    return d.withColumn("values", F.when(F.col("_n") == 1, F.col("values")).otherwise(F.raise_error(F.lit(f"several datasets of {what}")))).drop("_n")


def _same_shape(data: DataFrame, what: str) -> DataFrame:
    """Datasets of one path that have one shape; others are an error."""
    by = Window.partitionBy("path")
    shape = F.array_join(F.col("shape"), "x")
    d = data.withColumns({"_a": F.min(shape).over(by), "_b": F.max(shape).over(by)})
    return d.withColumn("values", F.when(F.col("_a") == F.col("_b"), F.col("values")).otherwise(F.raise_error(F.lit(f"{what} differ in shape")))).drop("_a", "_b")


def stacks(data: DataFrame, names: list[str] | None = None, prefix: str = "wDataCh", zero: str | None = None) -> DataFrame:
    """(path, ch, x, y, frame, v) of the named channels, or of all whose name begins with ``prefix``; their shapes must agree.  A
    path without the channel ``zero`` gets noughts for it, of the first channel's shape."""
    known = data.where(F.col("dataset").isin(*names) if names else F.col("dataset").startswith(prefix))
    if zero:
        lone = known.groupBy("path").agg(F.max(F.col("dataset") == zero).alias("_has"), F.min_by(F.struct("shape", "values"), "dataset").alias("_f")).where("NOT _has")
        known = known.unionByName(lone.select("path", F.lit(zero).alias("dataset"), F.col("_f.shape").alias("shape"), F.transform("_f.values", lambda v: F.lit(0.0)).alias("values")))
    d = _same_shape(known, "channels").select("path", F.col("dataset").alias("ch"), "shape", F.posexplode("values").alias("_i", "v"))
    ny, nf = F.col("shape")[1], F.col("shape")[2]
    i = F.col("_i")
    return d.select("path", "ch", F.floor(i / (ny * nf)).cast("int").alias("x"), F.pmod(F.floor(i / nf), ny).cast("int").alias("y"), F.pmod(i, nf).cast("int").alias("frame"), "v")


def traces(data: DataFrame) -> DataFrame:
    """(path, roi, i, time, v) of traces that were computed before (regions x samples), whose times have the same shape; roi from 0, i from 1."""
    v = _only(data, F.lower("dataset") == "traces0_raw", "traces").select("path", F.col("shape"), F.col("values").alias("_v"))
    t = _only(data, F.lower("dataset") == "tracetimes0", "times").select("path", F.col("shape").alias("_s"), F.col("values").alias("_t"))
    d = v.join(t, "path")
    ok = F.array_join(F.col("shape"), "x") == F.array_join(F.col("_s"), "x")
    d = d.withColumn("_v", F.when(ok, F.col("_v")).otherwise(F.raise_error(F.lit("traces and times differ in shape"))))
    d = d.select("path", "shape", F.posexplode(F.arrays_zip("_v", "_t")).alias("_i", "_p"))
    n = F.col("shape")[1]
    return d.select("path", F.floor(F.col("_i") / n).cast("int").alias("roi"), (F.pmod("_i", n) + 1).cast("int").alias("i"), F.col("_p._t").alias("time"), F.col("_p._v").alias("v"))


def triggers(data: DataFrame, with_values: bool = False) -> DataFrame:
    """(path, j, time[, value]) of trigger times, j from 1; counts of old files become seconds.  With values there must be as many."""
    t = _only(data, F.lower("dataset") == "triggertimes", "trigger times").select("path", F.col("values").alias("_t"))
    if with_values:
        v = _only(data, F.lower("dataset") == "triggervalues", "trigger values").select("path", F.col("values").alias("_v"))
        t = t.join(v, "path", "left")
        t = t.withColumn("_t", F.when(F.size("_t") == F.size("_v"), F.col("_t")).otherwise(F.raise_error(F.lit("trigger times and values differ in number"))))
    else:
        t = t.withColumn("_v", F.col("_t"))
    rows = t.select("path", F.posexplode(F.arrays_zip("_t", "_v")).alias("_i", "_p")).select("path", (F.col("_i") + 1).alias("j"), F.col("_p._t").alias("time"), F.col("_p._v").alias("value"))
    end = data.where(F.lower("dataset") == "tracetimes0").select("path", F.array_max("values").alias("end"))
    rows = repair_times(rows, "path", "time", end)
    return rows if with_values else rows.drop("value")


def roi_mask(data: DataFrame) -> DataFrame:
    """(path, x, y, label) of the one dataset whose name holds ``rois``; labels are whole, and an empty image gives no rows."""
    m = _only(data, F.lower("dataset").contains("rois") & (F.size("values") > 0), "masks")
    d = m.select("path", "shape", F.posexplode("values").alias("_i", "label"))
    ny = F.col("shape")[1]
    return whole_labels(d.select("path", F.floor(F.col("_i") / ny).cast("int").alias("x"), F.pmod("_i", ny).cast("int").alias("y"), "label"))


def roi_traces(data: DataFrame, ids: DataFrame) -> DataFrame:
    """(path, roi, i, time, v, dt) of the wanted regions (path, roi): a wanted one that is not there is an error; dt is the mean step."""
    t = traces(data)
    want = ids.join(t.select("path", "roi").distinct().withColumn("_in", F.lit(True)), ["path", "roi"], "left")
    want = want.withColumn("roi", F.when(F.col("_in"), F.col("roi")).otherwise(F.raise_error(F.lit("no trace of a region")).cast("int"))).drop("_in")
    by = Window.partitionBy("path", "roi")
    n = F.count(F.lit(1)).over(by)
    return t.join(want, ["path", "roi"]).withColumn("dt", F.try_divide(F.max("time").over(by) - F.min("time").over(by), n - 1))


def parameters(tables: DataFrame, texts: str = "wparamsstr", numbers: str = "wparamsnum") -> DataFrame:
    """(path, params) from labelled vectors (path, dataset, labels, texts, numbers): text and number tables as one map, keys in lower case."""
    as_map = lambda c: labelled(F.col("labels"), F.col(c))
    a = tables.where(F.lower("dataset") == texts).select("path", as_map("texts").alias("_a"))
    b = tables.where(F.lower("dataset") == numbers).select("path", as_map("numbers").alias("_b"))
    d = a.join(b, "path", "full")
    empty = lambda c, kind: F.coalesce(F.col(c), F.expr(f"cast(map() as map<string,{kind}>)"))
    return d.select("path", merged_parameters(empty("_a", "string"), empty("_b", "double")).alias("params"))


def renamed(params: Column, names: dict[str, str]) -> Column:
    """A map of parameters with keys of another program under the usual ones."""
    out = F.transform_keys(params, lambda k, v: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), k), k)) if names else params
    return out


def packed(rows: DataFrame, dataset: str, place: list[str], value: str, shape: Column) -> DataFrame:
    """(path, dataset, shape, values): rows of one dataset in row-major order of ``place``, for a sink; ``tables.write`` refuses to overwrite."""
    g = rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(*place, F.col(value).cast("double").alias("_v")))).alias("_r"))  # one dataset of a recording
    return g.select("path", F.lit(dataset).alias("dataset"), shape.alias("shape"), F.transform("_r", lambda r: r["_v"]).alias("values"))


def preferred_mask(masks: DataFrame, ranks: DataFrame, key: list[str]) -> DataFrame:
    """The mask (path, x, y, label) of each key's file of least rank that has one (ranks: key, path, rank)."""
    have = ranks.join(masks.select("path").distinct(), "path")
    first = have.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy("rank", "path"))).where("_r = 1").select(*key, "path")
    return masks.join(first, "path")
