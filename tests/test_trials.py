"""Epochs by time, nodes, parameters, tuning, mixtures and published grids against closed forms and numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochal.functions import fitting, kernels, tuning
from epochal.operators import algebra, learning, responses, trials
from epochal.plans import params
from epochal.plans.nodes import Node, Schema
from epochal.sources import recordings


def recording(spark, times, triggers, values=None):
    n = len(times)
    s = spark.createDataFrame([(1, i + 1, n, int(t), float(i if values is None else values[i])) for i, t in enumerate(times)], "u int, i int, n int, us long, v double")
    return s, spark.createDataFrame([(1, j + 1, int(t)) for j, t in enumerate(triggers)], "u int, j int, us long")


def starts_of(df):
    return [(r["rep"], r["start"], r["k"]) for r in df.orderBy("rep").collect()]


def test_starts_are_nearest_and_lone_epochs_stay(spark):
    s, t = recording(spark, range(0, 200, 10), [12, 52, 93, 155])
    assert starts_of(trials.starts(s, t, "u", "us", tolerance=5)) == [(1, 2, 4), (2, 6, 4), (3, 10, 4), (4, 16, 4)]
    assert starts_of(trials.starts(s, t, "u", "us", delay=3, tolerance=5)) == [(1, 2, 5), (2, 6, 5), (3, 11, 5)]  # of two samples as near the earlier; the last is incomplete
    assert starts_of(trials.starts(s, t, "u", "us", pad=True)) == [(1, 2, 5), (2, 6, 5), (3, 10, 5), (4, 16, 5)]
    assert starts_of(trials.starts(s, t.where("j = 1"), "u", "us", tolerance=5)) == [(1, 2, 19)]
    with pytest.raises(Exception, match="incomplete"):
        trials.starts(s, t, "u", "us", delay=3, tolerance=5, drop_last=False).collect()
    with pytest.raises(Exception, match="no sample near"):
        trials.starts(s, t.withColumn("us", F.col("us") + 500), "u", "us", tolerance=5).collect()


def test_groups_of_trials(spark):
    assert trials.offsets([("a", 1), ("b", 4, 2), ("a", 1, None)]) == [("a", 0, 0), ("b", 1, 0), ("b", 3, 1), ("a", 5, 0)]
    s, t = recording(spark, range(0, 300, 10), [0, 40, 90, 140, 180, 230])
    g = trials.group_starts(s, t, "u", "us", [("a", 1), ("b", 2)], 0, 5)
    got = sorted((r["name"], r["rep"], r["part"], r["start"], r["end"]) for r in g.collect())
    assert got == [("a", 1, 0, 1, 5), ("a", 2, 0, 15, 19), ("b", 1, 0, 5, 15), ("b", 2, 0, 19, 30)]
    cut = trials.group_snippets(s, g, "u", "pad").groupBy("name", "rep").count()
    assert {(r["name"], r["rep"]): r["count"] for r in cut.collect()} == {("a", 1): 4, ("a", 2): 4, ("b", 1): 10, ("b", 2): 10}
    with pytest.raises(Exception, match="differ in length"):
        trials.group_snippets(s, g, "u", "truncate", 0.05).collect()
    assert trials.group_snippets(s, g, "u", "truncate", 0.2).where("name = 'b'").count() == 20
    with pytest.raises(ValueError):
        trials.group_snippets(s, g, "u", "other")


def test_resampling_matches_interp(spark):
    rng = np.random.default_rng(0)
    rows, want = [], []
    for rep in range(3):
        t = np.sort(rng.choice(np.arange(5, 960), 25, replace=False))
        v = rng.normal(size=25)
        rows += [(1, rep, int(a), float(b)) for a, b in zip(t, v, strict=True)]
        want.append(np.interp(np.arange(0, 1000, 40), t, v))
    s = spark.createDataFrame(rows, "u int, rep int, t long, v double")
    got = trials.resampled_averages(s, "u", 40, spark.createDataFrame([(1, 990.0)], "u int, span double")).orderBy("g").collect()
    assert [r["average"] for r in got] == pytest.approx(list(np.mean(want, 0)))


def test_relative_times(spark):
    s = spark.createDataFrame([(1, r, t, t * 0.1 + 0.001 * r) for r in range(3) for t in range(4)], "u int, rep int, t int, rt double")
    assert [r["time"] for r in trials.relative_times(s, "u", 0.01).orderBy("t").collect()] == pytest.approx([0.001, 0.101, 0.201, 0.301])
    with pytest.raises(Exception, match="not aligned"):
        trials.relative_times(s, "u", 1e-5).collect()


def test_frames_of_triggers(spark):
    _, t = recording(spark, [0], [0, 100, 220])
    assert [r["us"] for r in trials.trigger_frames(t, "u", "us", 2, 10).orderBy("f").collect()] == [0, 55, 100, 155, 220, 275]
    with pytest.raises(Exception, match="more triggers"):
        trials.trigger_frames(t, "u", "us", 2, 5).collect()


def test_populate_gets_on_past_keys_without_rows(spark, tmp_path):
    s = Schema(spark, str(tmp_path / "db"))
    s.add(Node("a", ["k"]))
    s.insert("a", spark.range(5).select(F.col("id").cast("int").alias("k")))
    s.add(Node("c", ["k"], ["a"], lambda todo, p: todo.where("k >= 2").withColumn("v", F.col("k") * 2), also=["extra"]))
    assert [s.populate("c", 2) for _ in range(4)] == [2, 2, 1, 0]
    assert sorted(r["v"] for r in s.table("c").collect()) == [4, 6, 8] and s.missing("c").isEmpty()
    s.forget("c")
    assert s.missing("c").count() == 2 and s.inputs("c") == ["a"] and s.reflect() == {"a": ["k"], "c": ["k", "v"]}
    with pytest.raises(KeyError):
        s.add(Node("x", ["k"], ["nowhere"]))
    s.drop_all()
    assert s.reflect() == {}


def test_algebra_without_shared_columns(spark):
    a, b = spark.range(3), spark.range(2).withColumnRenamed("id", "p")
    with pytest.raises(ValueError):
        algebra.natural_join(a, b)
    with pytest.raises(ValueError):
        algebra.natural_join(a, b, 1)
    assert algebra.natural_join(a, b, 2).count() == 6
    assert algebra.closest_rows(a, spark.range(3)) and not algebra.closest_rows(a, a.union(a.limit(1))) and not algebra.closest_rows(a, b)
    assert algebra.fetch_keys(a.union(a), ["id"]).__len__() == 3
    with pytest.raises(ValueError, match="over 2 rows"):
        algebra.fetch_keys(a, ["id"], 2)
    assert algebra.numbers_equal({"a": [1.0, float("nan")]}, {"a": [1.0 + 1e-9, float("nan")]}) and not algebra.numbers_equal([1], [2])


def test_parameter_tables(spark):
    r = params.rows(spark, "user", {"experimenter": "X", "data_dir": "/d", "mask_alias": "MB"}).first()
    assert r["mask_alias"] == "mb" and r["raw_dir"] == "Raw"
    two = params.rows(spark, "classifier_method", {"trees": 10}, {"trees": 20}, hashed=True)
    assert two.select("method_id").distinct().count() == 2
    for name, bad in (("ipl_bins", {"bin_id": 1, "borders": [2.0, 1.0]}), ("user", {"data_dir": "x"}), ("sta_params", {"sta_id": 1, "train": 2.0}), ("raw_params", {"raw_id": 1, "other": 2})):
        with pytest.raises(ValueError):
            params.rows(spark, name, bad)
    assert [x["experimenter"] for x in params.fan_out(spark, "raw_params", "experimenter", ["a", "b"], {"raw_id": 1})] == ["a", "b"]
    old = params.rows(spark, "raw_params", {"raw_id": 1})
    assert params.same_or_new(old, params.rows(spark, "raw_params", {"raw_id": 1}, {"raw_id": 2}), ["raw_id"]).count() == 1
    with pytest.raises(ValueError):
        params.same_or_new(old, params.rows(spark, "raw_params", {"raw_id": 1, "from_raw": True}), ["raw_id"])
    assert all(params.columns_of(schema)[0] in key for key, schema, _ in params.TABLES.values())


def test_blocked_recursion_is_the_plain_one():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 64, 65, 300):
        x = rng.normal(size=n).cumsum()
        b0, b1, b2, a1, a2 = section = kernels.butterworth(6, 1.0, 10.0)[0]
        z1, z2, want = x[0] * (1 - b0), x[0] * (b2 - a2), []
        for v in x:
            o = b0 * v + z1
            z1, z2 = b1 * v - a1 * o + z2, b2 * v - a2 * o
            want.append(o)
        assert kernels.recurse(x, section) == pytest.approx(want)
    assert kernels.lowpass(np.full(50, 3.0), 10, 1) == pytest.approx(np.full(50, 3.0))
    assert np.argmax(kernels.lowpass(np.eye(1, 200, 100)[0], 10, 1)) == 100 and np.argmax(kernels.lowpass(np.eye(1, 200, 100)[0], 10, 1, zero_phase=False)) > 100


def test_fourier_resampling():
    t = np.arange(40) / 40
    wave = lambda u: np.sin(2 * np.pi * 3 * u) + 0.5 * np.cos(2 * np.pi * u)
    for n in (30, 40, 41, 100):
        assert tuning.fourier_resample(wave(t), n) == pytest.approx(wave(np.arange(n) / n), abs=1e-9)


@pytest.mark.parametrize("version", [1, 2])
def test_direction_tuning(spark, version):
    rng = np.random.default_rng(4)
    order = [0.0, 180.0, 45.0, 225.0, 90.0, 270.0, 135.0, 315.0]
    gain = {d: 1 + np.cos(np.deg2rad(d - 90)) for d in order}
    course = np.concatenate((np.zeros(9), np.sin(np.linspace(0, np.pi, 12)), np.zeros(11)))
    rows = [(1, rep * 8 + j + 1, t, float(gain[d] * v + 0.02 * rng.normal())) for rep in range(3) for j, d in enumerate(order) for t, v in enumerate(course)]
    snips = spark.createDataFrame(rows, "k int, rep int, t int, v double")
    r = responses.tuning(responses.by_direction(snips, "k", order), "k", order, 0.128, version, 200).first()
    assert r["pref_dir"] == pytest.approx(np.pi / 2, abs=0.05) and r["ds_index"] > 0.4 and r["ds_pvalue"] <= 0.05 and r["os_pvalue"] > 0.3
    assert r["d_qi"] > 0.95 and max(map(abs, r["time_component"])) == pytest.approx(1) and r["dir_component"][2] == 1 and min(r["dir_component"]) == 0
    with pytest.raises(Exception, match="do not fill"):
        responses.by_direction(snips.where("rep <= 11"), "k", order).collect()


def test_mixtures_of_other_covariances():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(200, 2)) * s + m for s, m in ((0.3, (0, 0)), (0.5, (5, 5)), (0.4, (-5, 5)))])
    for kind in ("spherical", "tied", "diag", "full"):
        m = fitting.fit_mixture(x, 3, kind)
        label = m.predict(x)
        assert sorted(np.bincount(label)) == [200, 200, 200] and all(len(set(label[i : i + 200])) == 1 for i in (0, 200, 400))
    assert fitting.fit_mixture(x, 3, "full").loglik > fitting.fit_mixture(x, 1, "full").loglik


def test_mixture_choice_and_assignment(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(60, 2)) * 0.3 + m for m in ((0, 0), (6, 0))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    _, k, model = learning.mixture(df, "v", range(1, 4), kinds=("spherical", "diag"))
    assert k == 2 and learning.assign_mixture(df, "v", model).groupBy("cluster").count().count() == 2


def test_classifier_scores_and_gate(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, i % 2, (rng.normal(size=3) + 4 * (i % 2)).tolist()) for i in range(200)], "id int, y int, v array<double>")
    model, scores = learning.trained(df, "v", "y", "id", trees=10)
    assert min(scores.values()) > 0.95 and set(scores) == {"train", "test", "all"}
    out = learning.classify(df, "v", model)
    assert out.where("cell_class = y").count() > 195 and out.agg(F.min("confidence")).first()[0] >= 0.5
    assert learning.confident(out, 1.1).where("cell_class <> -1").count() == 0


def test_published_grids(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(size=260)
    df = spark.createDataFrame([(1, v.tolist())], "id int, v array<double>")
    grid = np.linspace(0, 32, 249)
    want = np.interp(grid, np.arange(260) * 0.125 + 0.128, v)
    want = want - np.median(want[:8])
    assert learning.published_chirp(df, "v", 0.125).first()["v"] == pytest.approx(list(want / np.abs(want).max()))
    bar = np.interp(np.arange(32) * 0.128, np.arange(260) * 0.125, v)
    bar = np.roll(bar, -4)
    bar = bar - np.median(bar[:8])
    assert learning.published_bar(df, "v", 0.125).first()["v"] == pytest.approx(list(bar / np.abs(bar).max()))
    step = np.cumsum(np.concatenate(([0], np.full(79, 0.128), np.full(80, 1 / 7.5), np.full(89, 0.128))))
    warped = np.interp(step, np.arange(260) * 0.128 + 0.128, v)
    assert learning.warped_chirp(df, "v").first()["v"] == pytest.approx(list(warped / np.abs(warped).max()))


def test_channel_triggers(spark):
    trace = [0] * 10 + [9] * 4 + [0] * 16 + [9] * 5 + [0] * 2 + [9] * 2 + [0] * 11
    pixels = lambda v: spark.createDataFrame([(1, p, float(x)) for p, x in enumerate(v)], "k int, p long, v double")
    assert sorted(r["p"] for r in recordings.triggers(pixels(trace), "k", 8, 5.0).collect()) == [10, 30]  # 37 is too close
    high = [9] * 6 + trace[4:]
    assert sorted(r["p"] for r in recordings.triggers(pixels(high), "k", 8, 5.0).collect()) == [6 - 3, 12, 32]
    assert recordings.auto_threshold(pixels([0, 40_000]), "k").first()["threshold"] == 30_000


def test_agglomerative_has_no_silent_switch(spark):
    df = spark.createDataFrame([([float(i), 0.0],) for i in range(12)], "v array<double>")
    # ``most`` bounds the centres of the approximate way only.
    assert learning.agglomerative(df, "v", k=11, most=10).select("cluster").distinct().count() == 11
    assert learning.agglomerative(df, "v", k=2, most=10, approximate=True).select("cluster").distinct().count() == 2


def test_least_squares_finds_the_filter(spark):
    rng = np.random.default_rng(8)
    s = rng.normal(size=300)
    w = np.array([0.5, -1.0, 2.0])
    y = sum(c * np.concatenate((np.zeros(k), s[: 300 - k])) for k, c in enumerate(w))
    df = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(s, y, strict=True))], "k int, i int, s double, y double")
    assert responses.least_squares(responses.design(df, "k", "s", 3), "k", "y").first()["w"] == pytest.approx(list(w))
    assert responses.timing(0.5, 0.2, 0.1)["lags"] == 7 and responses.timing(0.5, 0.2, 0.1)["shift"] == -2


def test_triggers_of_a_scan(spark):
    nx, ny, frames = 6, 4, 12
    v = np.zeros((frames, ny, nx))
    v.reshape(-1)[[50, 51, 52, 120, 121, 122, 230, 231]] = 60_000
    rows = [(1, f, y, x, float(v[f, y, x])) for f in range(frames) for y in range(ny) for x in range(nx)]
    stack = spark.createDataFrame(rows, "k int, frame int, y int, x int, v double")
    p = spark.createDataFrame([(1, {"user_dxpix": 10.0, "user_dypix": 4.0, "user_npixretrace": 3.0, "user_nxpixlineoffs": 1.0, "realpixdur": 1e5})], "k int, p map<string,double>")
    scans = p.select("k", *[c.alias(n) for n, c in recordings.scan_columns(F.col("p")).items()])
    got = sorted(r["time"] for r in recordings.trigger_times(stack, scans, "k", delay=0.5).collect())
    line = lambda p: p // nx
    assert got == pytest.approx([(line(p) // ny) * 4.0 + (line(p) % ny) * 1.0 + 0.5 for p in (50, 120, 230)])


def test_noise_on_either_clock(spark):
    rng = np.random.default_rng(1)
    s, t = recording(spark, range(0, 4000, 10), range(0, 4000, 50), rng.normal(size=400))
    frames = spark.createDataFrame([(f, float(f % 2)) for f in range(80)], "f int, s double")
    a = responses.noise_data(s, t, frames, "u", "us", tolerance=3)
    assert a.count() == 400 and {r["s"] for r in a.collect()} == {-1.0, 1.0} and a.where("f = 3").count() == 5
    b = responses.noise_data(s, t, frames, "u", "us", reference="stim", kind="gradient", tolerance=3)
    assert b.count() == 80 and a.agg(F.stddev_pop("v")).first()[0] == pytest.approx(1, abs=0.01)
    with pytest.raises(ValueError):
        responses.noise_data(s, t, frames, "u", "us", kind="other")


def test_pixel_shifts(spark):
    rows = [(1, f, 3.0 * (f >= 80) + 0.1 * (-1) ** f, -2.0) for f in range(120)]
    got = responses.pixel_shifts(spark.createDataFrame(rows, "u int, f int, dx double, dy double"), "u", 8.0, 0.5).orderBy("f").collect()
    assert {r["dy"] for r in got} == {0} and got[110]["dx"] - got[5]["dx"] == 3


def test_saved_classifier(spark, tmp_path):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, i % 2, (rng.normal(size=4) + 4 * (i % 2)).tolist(), (i % 10) / 10) for i in range(80)], "id int, y int, v array<double>, q double")
    labels = df.select("id", "y", F.when(F.col("id") > 5, F.col("y")).alias("z"))
    assert learning.training_rows(df.drop("y"), labels, ["id"], ["y", "z"]).count() == 74
    assert learning.good_responses(df.withColumns({"bar_qi": F.col("q"), "chirp_qi": F.lit(0.0)})).count() == 24
    m = learning.forest(df, "v", "y", 5)
    path = str(tmp_path / "clf")
    learning.save_bundle(spark, m, path, [[1.0, 2.0]], [[3.0]], ["a", "b", "p", "area"], {0: "off", 1: "on"})
    back = learning.load_bundle(spark, path)
    assert back["y_names"] == {0: "off", 1: "on"} and learning.classify(df, "v", back["model"]).where("cell_class = y").count() > 76
    with pytest.raises(ValueError):
        learning.check_bundle({**back, "feature_names": ["a"]}, 4)
    with pytest.raises(ValueError):
        learning.check_bundle({"model": None}, 4)
