"""Folders of recordings' files, read whole and as a stream."""

import os
import pickle
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochal.sources import containers, files


@pytest.fixture
def folder(tmp_path):
    os.makedirs(tmp_path / "in/_hidden")
    mask = np.arange(12).reshape(3, 4) % 3
    np.save(tmp_path / "in/a.npy", np.arange(6.0).reshape(2, 3))
    np.savez(tmp_path / "in/b.npz", wDataCh0=np.ones((2, 2, 3)), wDataCh1=np.zeros((2, 2, 3)), triggertimes=np.array([1.0, 2.0]))
    (tmp_path / "in/c_ROIs.pkl").write_bytes(pickle.dumps(mask))
    (tmp_path / "in/d.pkl").write_bytes(pickle.dumps({"ROIs": mask, "score": np.float64(0.5)}))
    (tmp_path / "in/e.ini").write_text("[head]\n; note\nstring_Eye = left\nfloat_Zoom=0.65\nfloat_Zoom=0.8\n")
    (tmp_path / "in/f.txt").write_text("nothing")
    np.save(tmp_path / "in/_hidden/g.npy", np.ones(2))
    return str(tmp_path / "in")


def test_all_kinds(spark, folder):
    d = files.read(spark, folder)
    got = {(r["path"].rsplit("/", 1)[1], r["dataset"]): r for r in d.collect()}
    assert set(got) == {("a.npy", "a"), ("b.npz", "wDataCh0"), ("b.npz", "wDataCh1"), ("b.npz", "triggertimes"), ("c_ROIs.pkl", "rois"), ("d.pkl", "ROIs"), ("d.pkl", "score"), ("e.ini", "header")}
    assert got["a.npy", "a"]["shape"] == [2, 3] and got["a.npy", "a"]["values"] == [0, 1, 2, 3, 4, 5] and got["d.pkl", "score"]["shape"] == []
    assert got["e.ini", "header"]["texts"] == {"Eye": "left", "Zoom": "0.8"}
    stacks = containers.stacks(d.select("path", "dataset", "shape", "values"))
    assert stacks.groupBy("ch").agg(F.sum("v").alias("s")).orderBy("ch").collect() == [("wDataCh0", 12.0), ("wDataCh1", 0.0)]
    assert containers.roi_mask(d.where("path LIKE '%c_ROIs.pkl'")).count() == 12


def test_only_what_is_asked_for(spark, folder):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        one = files.read(spark, folder).where("dataset = 'wDataCh1'")
        assert one.count() == 1
        assert files.read(spark, folder).where("dataset LIKE 'wData%' AND size(shape) = 3").count() == 2
        assert files.read(spark, folder).where(F.col("dataset").isin("a", "score")).count() == 2
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    names = files.read(spark, folder, "path string, dataset string", kinds="npz,pkl", datasets="ROIs,wDataCh0")
    assert names.columns == ["path", "dataset"] and sorted(r["dataset"] for r in names.collect()) == ["ROIs", "wDataCh0"]
    assert files.read(spark, folder, bytes=1).rdd.getNumPartitions() == 5
    assert files.read(spark, folder + "/none").count() == 0


def test_filters_reach_the_reader(folder):
    r = files.FilteringReader({"path": folder}, ["dataset"])
    left = list(r.pushFilters([files.EqualTo(("dataset",), "wDataCh1"), files.EqualTo(("shape",), [1])]))
    assert len(left) == 1 and r.names == {"wDataCh1"}
    assert [row for p in r.partitions() for row in r.read(p)] == [("wDataCh1",)]


def test_a_pickle_runs_nothing(spark, tmp_path):
    class Bad:
        def __reduce__(self):
            return os.system, ("true",)

    (tmp_path / "x.pkl").write_bytes(pickle.dumps(Bad()))
    with pytest.raises(Exception, match="does not hold"):
        files.read(spark, str(tmp_path)).collect()


def test_a_growing_folder(spark, folder, tmp_path):
    def run():
        w = files.stream(spark, folder, settle=0.2).select("path", "dataset").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out"))
        w.trigger(availableNow=True).start().awaitTermination(60)
        return sorted(r["dataset"] for r in spark.read.schema("path string, dataset string").parquet(str(tmp_path / "out")).collect())

    time.sleep(0.5)
    first = run()
    assert len(first) == 8
    np.save(f"{folder}/late.npy", np.ones(3))
    time.sleep(0.5)
    assert run() == sorted([*first, "late"]) == run()  # each file once
