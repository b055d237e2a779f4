"""Closed forms and invariants of pieces that queries do not show."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochal.functions import kernels, scalars
from epochal.operators import algebra, epochs, masks, series
from epochal.plans.nodes import Node, Schema, guarded
from epochal.sources import logs, paths
from epochal.streaming import incremental


def test_savgol_reproduces_polynomials():
    w = kernels.savgol_weights(3, 2)
    x = np.arange(-3, 4)
    assert w @ (2 + 3 * x - x**2) == pytest.approx(2)


def test_lowpass_keeps_slow_and_removes_fast():
    t = np.arange(400) / 50
    slow, fast = np.sin(2 * math.pi * t), np.sin(2 * math.pi * 20 * t)
    out = kernels.lowpass(slow + fast, 50, 5)
    assert np.abs(out - slow)[50:-50].max() < 0.05
    assert kernels.lowpass(np.full(20, 3.0), 50, 5) == pytest.approx(np.full(20, 3.0))


def test_rank_one_and_sigmoid_and_areas():
    t, d, share = kernels.rank_one(np.outer([1.0, 2.0, 3.0], [1.0, 0.5]))
    assert share == pytest.approx(1) and t[2] / t[0] == pytest.approx(3) and d[0] > 0
    x = np.linspace(-3, 5, 60)
    assert kernels.fit_sigmoid(x, 2 / (1 + np.exp(-1.5 * (x - 1)))) == pytest.approx((1, 1.5, 2), abs=1e-3)
    square = np.array([[0, 0], [2, 0], [2, 2], [0, 2], [1, 1]], float)
    assert kernels.hull_area(square) == 4 and kernels.polygon_area(square[:4, 0], square[:4, 1]) == 4
    assert kernels.band_power_ratio(np.sin(2 * math.pi * 5 * np.arange(400) / 50), 50) > 4


def test_hash_params_ignores_order():
    assert scalars.hash_params({"a": 1, "b": {3, 1}}) == scalars.hash_params({"b": {1, 3}, "a": 1})
    assert scalars.hash_params([1, 2]) != scalars.hash_params([2, 1])


def test_algebra_errors(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    with pytest.raises(ValueError):
        algebra.insert(a, a.where("k = 1"), ["k"])
    with pytest.raises(KeyError):
        algebra.update(a, a.select((F.col("k") + 5).alias("k"), "v"), ["k"])
    with pytest.raises(LookupError):
        algebra.fetch1(a)
    assert algebra.fetch1(a.where("k = 2"))["v"] == "y"
    assert algebra.anti(a, {"v": "x"}).count() == 1 and algebra.restrict(a, []).count() == 0
    with pytest.raises(ValueError):
        algebra.merge_keys({"a": 1}, {"a": 2})


def test_asof_ties_and_tolerance(spark):
    data = spark.createDataFrame([(1, 10, 1.0), (1, 20, 2.0)], "key long, t long, v double")
    targets = spark.createDataFrame([(1, 15), (1, 5), (1, 100), (2, 1)], "key long, t long")
    near = {(r["key"], r["t"]): r["m_value"] for r in epochs.asof(targets, data, "key", "t", "v", "nearest", 20).collect()}
    assert near == {(1, 15): 1.0, (1, 5): 1.0, (1, 100): None, (2, 1): None}


def test_epochs_drop_incomplete_and_single_rep(spark):
    df = spark.createDataFrame([(1, i, float(i), i in (1, 4, 9, 10)) for i in range(1, 12)], "user_id long, o long, value double, trig boolean")
    s = series.indexed(df, "user_id", ["o"], "value")
    st = epochs.epoch_starts(s, "user_id", F.col("trig")).collect()
    assert [(r["start"], r["k"]) for r in st] == [(1, 3), (4, 3), (9, 3)]
    one = epochs.epoch_starts(s.where("i < 4"), "user_id", F.col("trig"))
    assert epochs.averages(epochs.snippets(s, one, "user_id"), "user_id").count() == 0


def test_constant_traces_normalise_to_zero(spark):
    s = spark.createDataFrame([(1, 1, 2.0), (1, 2, 2.0)], "k long, i long, v double")
    for kind in ("zscore", "zero_one", "soft_zero_one"):
        assert {r[kind] for r in series.normalise(s, "k", kind).collect()} == {0.0}


def test_connected_and_neighbour_correlation(spark):
    m = spark.createDataFrame([(1, x, y, int(v)) for y, row in enumerate(["1101", "0001", "1100"]) for x, v in enumerate(row)], "k long, x int, y int, label int")
    got = {(r["x"], r["y"]): r["component"] for r in masks.connected(m, "k", "label").collect()}
    assert got[(0, 0)] == got[(1, 0)] != got[(3, 0)] == got[(3, 1)] and got[(2, 0)] == 0 and len(set(got.values())) == 4
    t = np.sin(np.linspace(0, 7, 50))
    stack = spark.createDataFrame([(x, y, f, float(t[f] * (1 if x < 2 else -1))) for x in range(4) for y in range(2) for f in range(50)], "x int, y int, f int, v double")
    c = {(r["x"], r["y"]): r["corr"] for r in masks.neighbour_correlation(stack).collect()}
    assert c[(0, 0)] == pytest.approx(1) and c[(1, 0)] == pytest.approx(1 / 5)


def test_populate_twice_adds_nothing(spark, tmp_path):
    sch = Schema(spark, str(tmp_path / "db"))
    sch.add(Node("a", ["k"]))
    sch.add(Node("b", ["k"], ["a"], lambda todo, p: todo.join(p["a"], "k").select("k", (F.col("v") * 2).alias("w")), keep="k > 1"))
    a = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "k long, v long")
    sch.insert("a", a)
    sch.insert("a", a)
    assert sch.table("a").count() == 3
    assert sch.populate("b", limit=1) == 1 and sch.populate("b") == 1 and sch.populate("b") == 0
    assert sorted(r["w"] for r in sch.table("b").collect()) == [4, 6]
    with pytest.raises(KeyError):
        sch.add(Node("c", ["k"], ["nothing"]))
    sch.drop("b")
    assert not sch.has("b")


def test_guarded_kernel_isolates_errors(spark):
    def kernel(pdf):
        if pdf["k"].iloc[0] == 2:
            raise RuntimeError("bad key")
        return pdf[["k", "v"]]

    run, schema = guarded(kernel, "k", "k long, v long")
    rows = spark.createDataFrame([(1, 1), (2, 2)], "k long, v long").groupBy("k").applyInPandas(run, schema).collect()
    assert {r["k"]: r["error"] for r in rows} == {1: None, 2: "RuntimeError: bad key"}


def test_paths_and_headers(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "M1_LR_GCL0_chirp.smp").write_text("x")
    (tmp_path / "x" / ".hidden.smp").write_text("x")
    f = paths.list_files(spark, str(tmp_path))
    r = f.select(paths.token(F.col("filename"), 2).alias("field"), paths.token(F.col("filename"), 9).alias("none"), paths.alias_match(paths.token(F.col("filename"), 2), ["gcl"], True).alias("hit"), paths.match_file(F.col("filename"), "chirp").alias("m")).collect()
    assert [tuple(x) for x in r] == [("GCL0", None, True, True)]
    p = spark.createDataFrame([("/d/Raw/a_b.smp",)], "p string")
    assert p.select(paths.to_preprocessed(F.col("p"))).first()[0] == "/d/Pre/SMP_a_b.h5"
    with pytest.raises(Exception, match="not a raw path"):
        p.select(paths.to_preprocessed(F.lit("/d/else.smp"))).collect()
    lines = spark.createDataFrame([("f", 1, "[one]"), ("f", 2, "string_eye = left"), ("f", 3, "string_eye = right ")], "path string, line_no int, line string")
    assert [(x["key"], x["value"]) for x in paths.ini_pairs(lines).collect()] == [("eye", "right")]


def test_log_lines(spark):
    lines = spark.createDataFrame([("p", 1, "20200101 101112     INFO {'stim': 1}"), ("p", 2, "not a log line at all")], "path string, line_no int, line string")
    r = logs.parse_lines(lines).orderBy("line_no").collect()
    assert r[0]["ts"] is not None and r[0]["level"] == "INFO" and '"stim"' in r[0]["body"] and r[1]["ts"] is None


def test_streaming_population_and_pairing(spark, tmp_path):
    src, dst, chk = (str(tmp_path / x) for x in ("in", "out", "chk"))
    e = spark.createDataFrame([(1, "2024-01-01 00:00:00", "start"), (1, "2024-01-01 00:05:00", "end"), (2, "2024-01-01 00:01:00", "end")], "user_id long, ts string, kind string").select("user_id", F.to_timestamp("ts").alias("ts"), "kind")
    e.write.parquet(src)
    schema = "user_id long, ts timestamp, kind string"
    for _ in range(2):
        incremental.populate_new_files(spark, src, schema, dst, chk, ["user_id"], lambda df: df.groupBy("user_id").count())
    assert spark.read.parquet(dst).count() == 2
    e.where("user_id = 2").withColumn("user_id", F.lit(3).cast("long")).write.mode("append").parquet(src)
    incremental.populate_new_files(spark, src, schema, dst, chk, ["user_id"], lambda df: df.groupBy("user_id").count())
    assert spark.read.parquet(dst).count() == 3
    q = incremental.pair_runs(spark.readStream.schema(schema).parquet(src), "user_id").writeStream.format("memory").queryName("paired").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r["user_id"] for r in spark.sql("select * from paired").collect()] == [1]
