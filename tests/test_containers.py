"""Datasets of recordings, made by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochal.sources import containers, tables

SCHEMA = "path string, dataset string, shape array<long>, values array<double>"


def data(spark, *items):
    return spark.createDataFrame([(p, n, list(np.shape(v)), np.ravel(v).astype(float).tolist()) for p, n, v in items], SCHEMA)


def test_stacks_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(2, 4, 3, 5))
    d = data(spark, ("r1", "wDataCh0", a), ("r1", "wDataCh1", b), ("r2", "wDataCh0", b), ("r1", "other", [1.0]))
    got = containers.stacks(d)
    assert {(r["path"], r["ch"]) for r in got.select("path", "ch").distinct().collect()} == {("r1", "wDataCh0"), ("r1", "wDataCh1"), ("r2", "wDataCh0")}
    for r in got.where("path = 'r1' AND ch = 'wDataCh1'").collect():
        assert r["v"] == b[r["x"], r["y"], r["frame"]]
    zeros = containers.stacks(d, zero="wDataCh1").where("path = 'r2' AND ch = 'wDataCh1'")
    assert zeros.count() == 60 and zeros.agg(F.sum(F.abs("v"))).first()[0] == 0
    assert containers.stacks(d, ["wDataCh0"]).select("ch").distinct().count() == 1
    back = containers.packed(got.where("ch = 'wDataCh1'"), "wDataCh1", ["x", "y", "frame"], "v", F.array(F.lit(4), F.lit(3), F.lit(5)))
    assert back.first()["values"] == b.ravel().tolist()
    tables.write(back, str(tmp_path / "out"))
    with pytest.raises(Exception, match="already exists"):
        tables.write(back, str(tmp_path / "out"))
    with pytest.raises(Exception, match="differ in shape"):
        containers.stacks(data(spark, ("r", "wDataCh0", a), ("r", "wDataCh1", b[:2]))).collect()


def test_traces_and_triggers(spark):
    v, t = np.arange(12.0).reshape(2, 6), np.tile(np.arange(6) * 0.5, (2, 1))
    d = data(spark, ("r", "Traces0_raw", v), ("r", "Tracetimes0", t), ("r", "TriggerTimes", [500.0, 1000.0]), ("r", "Triggervalues", [1.0, 2.0]), ("s", "triggertimes", [0.5, 1.5]))
    rows = {(r["roi"], r["i"]): (r["time"], r["v"]) for r in containers.traces(d).collect()}
    assert rows[1, 3] == (1.0, 8.0) and len(rows) == 12
    assert [(r["path"], r["time"]) for r in containers.triggers(d).orderBy("path", "j").collect()] == [("r", 1.0), ("r", 2.0), ("s", 0.5), ("s", 1.5)]
    assert [r["value"] for r in containers.triggers(d.where("path = 'r'"), True).orderBy("j").collect()] == [1.0, 2.0]
    ids = spark.createDataFrame([("r", 1)], "path string, roi int")
    assert {r["dt"] for r in containers.roi_traces(d, ids).collect()} == {0.5}
    with pytest.raises(Exception, match="no trace"):
        containers.roi_traces(d, ids.withColumn("roi", F.lit(7))).collect()
    with pytest.raises(Exception, match="several datasets"):
        containers.triggers(data(spark, ("r", "triggertimes", [1.0]), ("r", "TRIGGERTIMES", [1.0]))).collect()
    with pytest.raises(Exception, match="differ in shape"):
        containers.traces(data(spark, ("r", "Traces0_raw", v), ("r", "Tracetimes0", t[:, :3]))).collect()


def test_masks_and_parameters(spark):
    m = np.array([[1, 1, -1], [-2, 1, -1]])
    d = data(spark, ("r", "ROIs", m), ("s", "rois_b", np.zeros((0, 2))))
    got = containers.roi_mask(d)
    assert {(r["path"], r["x"], r["y"], r["label"]) for r in got.collect()} == {("r", x, y, int(m[x, y])) for x in range(2) for y in range(3)}
    with pytest.raises(Exception, match="not whole"):
        containers.roi_mask(data(spark, ("r", "rois", [[0.5]]))).collect()
    ranks = spark.createDataFrame([("f", "s", 1), ("f", "r", 2)], "field string, path string, rank int")
    assert {r["path"] for r in containers.preferred_mask(got, ranks, ["field"]).collect()} == {"r"}
    t = spark.createDataFrame([("r", "wParamsStr", ["GUID", "", "Zoom"], ["g", "x", "no"], None), ("r", "wParamsNum", ["Zoom", "User_dxPix"], None, [0.65, 80.0])], "path string, dataset string, labels array<string>, texts array<string>, numbers array<double>")
    p = containers.parameters(t).first()["params"]
    assert p == {"guid": "g", "zoom": "0.65", "user_dxpix": "80.0"}
    named = containers.parameters(t).select(containers.renamed(F.col("params"), {"zoom": "zoom_level"}).alias("p")).first()["p"]
    assert set(named) == {"guid", "zoom_level", "user_dxpix"}
