"""The imaging pipeline as nodes: from pixels, masks and triggers to traces, epochs, qualities and indices.

Manual tables (filled with ``Schema.insert``) and their columns:

* ``stimulus``: stim; ntrigger_rep, isrepeated
* ``preprocess``: pre; half, poly_order, subtract_baseline, non_negative, standardize
* ``frame``: rec, stim; i (from 1), n, us, trigger
* ``stack``: rec, stim; i, x, y, v
* ``roi_mask``: rec; x, y, label
* ``geometry``: rec; pixel_um, artifact_columns, width, height, dx_um, dy_um, rotation, eye

All others are computed for the keys that are missing (``Schema.populate``). Tables are long: a key may have many rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochal.functions import scalars
from epochal.operators import epochs, features, masks, series
from epochal.plans.nodes import Node, Schema

PRES, ROI = ["rec", "stim"], ["rec", "roi"]
TRACE = ["rec", "stim", "roi"]
PROC = [*TRACE, "pre"]


def packed(df: DataFrame, key: list[str]) -> DataFrame:
    """The key as one struct column, ``unit``, as the operators take it."""
    return df.withColumn("unit", F.struct(*key)).drop(*key)


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("unit.*", *[c for c in df.columns if c != "unit"])


def _of(todo: DataFrame, table: DataFrame, key: list[str]) -> DataFrame:
    return table.join(todo.select(*key).distinct(), key, "left_semi")


def roi(todo: DataFrame, p: dict) -> DataFrame:
    """Pixels, area, diameter of the disk of that area, centre, and whether a pixel lies in the artifact columns."""
    m = _of(todo, p["roi_mask"], ["rec"]).where("label <> 0").join(p["geometry"], "rec")
    g = m.groupBy("rec", F.col("label").cast("int").alias("roi")).agg(
        F.count(F.lit(1)).alias("pixels"),
        (F.count(F.lit(1)) * F.pow(F.first("pixel_um"), F.lit(2))).alias("area_um2"),
        F.avg("x").alias("cx"),
        F.avg("y").alias("cy"),
        F.max(F.col("x") < F.col("artifact_columns")).alias("artifact"),
    )
    return g.withColumn("diameter_um", 2 * F.sqrt(F.col("area_um2") / math.pi))


def traces(todo: DataFrame, p: dict) -> DataFrame:
    """Mean over the pixels of each region and frame; regions in artifact columns have none."""
    m = p["roi_mask"].join(_of(todo, p["roi"], ["rec"]).where("NOT artifact").select("rec", F.col("roi").alias("label")), ["rec", "label"], "left_semi")
    px = _of(todo, p["stack"], PRES).join(m, ["rec", "x", "y"])
    v = px.groupBy("rec", "stim", F.col("label").cast("int").alias("roi"), "i").agg(F.avg("v").alias("v"))
    return _of(todo, v, TRACE).join(p["frame"], [*PRES, "i"])


def processed(todo: DataFrame, p: dict) -> DataFrame:
    """The chain of each parameter set (a short manual table, so its rows are literals of the plan)."""
    out = None
    for q in p["preprocess"].collect():
        t = packed(_of(todo.where(F.col("pre") == q["pre"]), p["traces"], TRACE).withColumn("pre", F.lit(q["pre"])), PROC)
        t = series.process(t, "unit", q["half"], q["poly_order"], q["subtract_baseline"], q["non_negative"], q["standardize"], F.col("trigger"))
        out = t if out is None else out.unionByName(t)
    return unpacked(out)


def snippets(todo: DataFrame, p: dict) -> DataFrame:
    """Epochs at every n-th trigger, n the stimulus' triggers a repeat."""
    t = _of(todo, p["processed"], PROC)
    out = None
    for q in p["stimulus"].where("isrepeated").collect():  # a short manual table
        s = packed(t.where(F.col("stim") == q["stim"]), PROC)
        made = epochs.snippets(s, epochs.epoch_starts(s, "unit", F.col("trigger"), q["ntrigger_rep"]), "unit")
        out = made if out is None else out.unionByName(made)
    return unpacked(out)


def averages(todo: DataFrame, p: dict) -> DataFrame:
    return unpacked(epochs.averages(packed(_of(todo, p["snippets"], PROC), PROC), "unit"))


def repeat_qi(todo: DataFrame, p: dict) -> DataFrame:
    return unpacked(epochs.repeat_qi(packed(_of(todo, p["snippets"], PROC), PROC), "unit"))


def presentation_qi(todo: DataFrame, p: dict) -> DataFrame:
    """Over the regions of a presentation: number, median, mean, extremes and share of good ones."""
    q = _of(todo, p["repeat_qi"], [*PRES, "pre"])
    share = [F.avg((F.col("qidx") >= x).cast("double")).alias(f"share_{int(100 * x)}") for x in (0.2, 0.35, 0.5)]
    return q.groupBy(*PRES, "pre").agg(F.count("qidx").alias("n"), F.median("qidx").alias("median"), F.avg("qidx").alias("mean"), F.min("qidx").alias("least"), F.max("qidx").alias("most"), *share)


def indices(todo: DataFrame, p: dict) -> DataFrame:
    """Polarity and the first harmonic of the average response (halves of its length as on and off)."""
    a = _of(todo, p["averages"], PROC)
    n = a.groupBy(*PROC).agg((F.max("t") + 1).alias("length"))
    x = F.greatest(F.col("average"), F.lit(0.0))
    on, off = (F.coalesce(F.avg(F.when(c, x)), F.lit(0.0)) for c in (F.col("t") < F.col("length") / 2, F.col("t") >= F.col("length") / 2))
    w = F.col("t") * 2 * math.pi / F.col("length")
    g = a.join(n, PROC).groupBy(*PROC).agg(on.alias("a"), off.alias("b"), F.avg(F.col("average") * F.cos(w)).alias("c"), F.avg(F.col("average") * F.sin(w)).alias("s"))
    return g.select(*PROC, features.contrast(F.col("a"), F.col("b")).alias("polarity"), (2 * F.hypot("c", "s")).alias("harmonic"))


def corr_map(todo: DataFrame, p: dict) -> DataFrame:
    """Mean and largest correlation of pixels with their neighbours."""
    s = packed(_of(todo, p["stack"], PRES), PRES)
    return unpacked(masks.neighbour_correlation_by(s, "unit", "i").groupBy("unit").agg(F.avg("corr").alias("mean"), F.max("corr").alias("most")))


def roi_location(todo: DataFrame, p: dict) -> DataFrame:
    """Micrometres from the reference point of the tissue, and turned to retinal axes."""
    r = _of(todo, p["roi"], ROI).join(p["geometry"], "rec")
    x = (F.col("cx") + 0.5 - F.col("width") / 2) * F.col("pixel_um") + F.col("dx_um")
    y = (F.col("cy") + 0.5 - F.col("height") / 2) * F.col("pixel_um") + F.col("dy_um")
    vd, tn = scalars.retinal_position(x, y, F.col("rotation"), F.col("eye"))
    return r.select(*ROI, x.alias("x_um"), y.alias("y_um"), vd.alias("ventral_dorsal"), tn.alias("temporal_nasal"))


def imaging(spark: SparkSession, root: str) -> Schema:
    """All tables above, below ``root``."""
    s = Schema(spark, root)
    for name, key in (("stimulus", ["stim"]), ("preprocess", ["pre"]), ("frame", PRES), ("stack", PRES), ("roi_mask", ["rec"]), ("geometry", ["rec"])):
        s.add(Node(name, key))
    s.add(Node("roi", ROI, ["roi_mask", "geometry"], roi))
    s.add(Node("traces", TRACE, ["frame", "roi", "stack", "roi_mask"], traces, only={"roi": "NOT artifact"}))
    s.add(Node("processed", PROC, ["traces", "preprocess"], processed))
    s.add(Node("snippets", PROC, ["processed", "stimulus"], snippets, only={"stimulus": "isrepeated"}))
    s.add(Node("averages", PROC, ["snippets"], averages))
    s.add(Node("repeat_qi", PROC, ["snippets"], repeat_qi))
    s.add(Node("presentation_qi", [*PRES, "pre"], ["repeat_qi"], presentation_qi))
    s.add(Node("indices", PROC, ["averages"], indices))
    s.add(Node("corr_map", PRES, ["stack"], corr_map))
    s.add(Node("roi_location", ROI, ["roi", "geometry"], roi_location))
    return s
