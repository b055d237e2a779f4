"""Receptive fields, images, masks, labels, stimuli and clustering against closed forms."""

import math
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochal.functions import cell_types, fitting
from epochal.operators import learning, masks, receptive, segmentation
from epochal.sources import stimuli


def image(spark, m, name="v", kind="double"):
    rows = [(x, y, float(m[x, y]) if kind == "double" else int(m[x, y])) for x in range(m.shape[0]) for y in range(m.shape[1])]
    return spark.createDataFrame(rows, f"x int, y int, {name} {kind}")


def back(df, name="v"):
    rows = df.collect()
    out = np.full((max(r["x"] for r in rows) + 1, max(r["y"] for r in rows) + 1), np.nan)
    for r in rows:
        out[r["x"], r["y"]] = np.nan if r[name] is None else r[name]
    return out


def test_peaks_and_prominence():
    v = np.array([0, 1, 0, 3, 2.5, 2.8, 0, 2, 2, 2, 0], float)
    assert fitting.peaks(v, 0.5, 0.5).tolist() == [1, 3, 8]
    assert fitting.peaks(v, 0.5, 0.1).tolist() == [1, 3, 5, 8]
    assert fitting.peaks(np.zeros(5), 0, 0).tolist() == []


def test_spline_and_half_width():
    x = np.linspace(0, 3, 7)
    f = fitting.natural_spline(x, 2 * x + 1)
    assert f(np.array([0.3, 2.9])) == pytest.approx([1.6, 6.8])
    t = np.linspace(-1, 0, 101)
    r = fitting.temporal_features(t, np.exp(-0.5 * ((t + 0.4) / 0.1) ** 2), baseline=0.1)
    assert r["polarity"] == 1 and r["peak_lag"] == pytest.approx(0.4, abs=1e-3)
    assert r["half_width"] == pytest.approx(2 * 0.1 * math.sqrt(2 * math.log(2)), abs=1e-3)
    assert r["transience"] == 0 and r["baseline_share"] < 1e-3


def test_temporal_biphasic_and_flat():
    t = np.linspace(-1, 0, 201)
    v = np.exp(-0.5 * ((t + 0.3) / 0.05) ** 2) - 0.5 * np.exp(-0.5 * ((t + 0.6) / 0.05) ** 2)
    assert fitting.temporal_features(t, v)["transience"] == pytest.approx(2 * 0.5 / 1.5, abs=1e-2)
    assert fitting.temporal_features(t, -v)["polarity"] == -1
    assert fitting.temporal_features(t, np.zeros(201))["peak_lag"] is None


def test_bspline_basis_sums_to_one():
    b = fitting.bspline_basis(30, 7)
    assert b.shape == (30, 7) and b.sum(1) == pytest.approx(np.ones(30)) and (b >= 0).all()


def test_saturating_fit():
    s = np.linspace(0, 1, 21)
    p, mse = fitting.fit_naka_rushton(s, fitting.naka_rushton(s, (0.2, 1.5, 0.3, 2.5)))
    assert p == pytest.approx([0.2, 1.5, 0.3, 2.5], abs=1e-2) and mse < 1e-6


def test_gaussian_fit_of_an_off_field(spark):
    x, y = np.meshgrid(np.arange(12), np.arange(10), indexing="ij")
    m = -fitting.gaussian2d(x, y, (2.0, 5.3, 4.1, 1.5, 1.5, 0.0))
    r = receptive.spatial(image(spark, m, "w").withColumn("k", F.lit(1).cast("long")), "k", 10.0, 10.0).first()
    assert r["polarity"] == -1 and (r["cx"], r["cy"]) == pytest.approx((5.3, 4.1), abs=0.01)
    assert r["explained"] > 0.999 and r["area"] == pytest.approx(math.pi * 4 * 15 * 15, rel=0.01)
    assert r["centre_index"] == pytest.approx(-1, abs=0.02)


def test_difference_of_gaussians():
    x, y = np.meshgrid(np.arange(15), np.arange(15), indexing="ij")
    m = fitting.gaussian2d(x, y, (2.0, 7, 7, 1.5, 1.5, 0)) - fitting.gaussian2d(x, y, (0.5, 7, 7, 4, 4, 0))
    assert fitting.fit_spatial(m, surround=True)["explained"] > 0.999 > fitting.fit_spatial(m)["explained"]


def test_outline_of_a_disk(spark):
    x, y = np.meshgrid(np.arange(21), np.arange(21), indexing="ij")
    m = np.maximum(0, 1 - np.hypot(x - 10, y - 9) / 8)
    r = receptive.outlines(image(spark, m, "w").withColumn("k", F.lit(1).cast("long")), "k", [0.5, 2.0]).orderBy("level").collect()
    assert r[0]["area"] == pytest.approx(math.pi * 16, rel=0.02) and (r[0]["cx"], r[0]["cy"]) == pytest.approx((10, 9), abs=0.01)
    assert r[0]["irregular"] < 0.03 and r[0]["inside"] == pytest.approx(math.pi * 16, rel=0.15) and r[0]["ring"] > 0
    assert r[1]["n"] == 0 and r[1]["irregular"] == 1


def test_open_contours_are_left_out():
    m = np.tile(np.arange(6.0), (6, 1))
    assert fitting.contours(m, 2.5) == []
    m = np.zeros((7, 9))
    m[2, 2] = m[4, 6] = 1
    assert len(fitting.contours(m, 0.5)) == 2


def test_split_and_merge_of_a_separable_field(spark):
    rows = [(1, t, x, y, (t - 1.5) * (1 + x) * (2 - y)) for t in range(4) for x in range(3) for y in range(2)]
    rf = spark.createDataFrame(rows, "k long, t int, x int, y int, w double")
    r = receptive.split_svd(rf, "k").first()
    assert r["explained"] == pytest.approx(1)
    made = {(t, x, y): a * b for t, a in zip(r["times"], r["time"], strict=True) for x, y, b in zip(r["xs"], r["ys"], r["space"], strict=True)}
    assert all(made[t, x, y] == pytest.approx(w) for _, t, x, y, w in rows)
    srf, trf = receptive.split_sd(rf, "k")
    assert srf.orderBy(F.desc("w")).first()[1:3] == (2, 0) and trf.count() == 4
    assert receptive.normalise(rf, "k").where("w < 0").count() == 12


def test_spline_filter_finds_the_filter(spark):
    rng = np.random.default_rng(1)
    x, w = rng.standard_normal(900), np.array([0, 0.5, 1, 0.5, 0, -0.3, -0.3, 0])
    y = fitting.lagged(x, 8) @ w + 0.1 * rng.standard_normal(900)
    df = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "k long, i int, s double, r double")
    r = receptive.spline_filter(df, "k", "s", "r", 8, [4, 7], [0.001, 0.1]).first()
    assert r["cc_test"] > 0.9 and r["p_value"] == 0 and np.corrcoef(r["filter"], w)[0, 1] > 0.95


def test_spline_filter_of_short_and_constant_series(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 1.0), *[(2, i, 1.0, 3.0) for i in range(40)]], "k long, i int, s double, r double")
    assert {r["k"]: r["cc_test"] for r in receptive.spline_filter(df, "k", "s", "r", 4, [3], [0.01]).collect()} == {1: 0.0, 2: 0.0}


def test_resize_and_rotate(spark):
    m = np.arange(12.0).reshape(3, 4)
    assert back(segmentation.resize(image(spark, m), (3, 4), (6, 8))).tolist() == np.kron(m, np.ones((2, 2))).tolist()
    assert back(segmentation.resize(image(spark, m), (3, 4), (3, 4), 1)) == pytest.approx(m)
    assert back(segmentation.rotate(image(spark, m), (3, 4), 90)) == pytest.approx(np.rot90(m))
    turned = back(segmentation.rotate(image(spark, m), (3, 4), 30))
    assert turned.shape == (5, 5) and np.isnan(turned[0, 0]) and turned[2, 2] == pytest.approx(5.5)
    assert segmentation.rescale(image(spark, m), (3, 4), (0.5, 0.5)).count() == 4
    m[1, 1] = np.nan
    holed = image(spark, m).withColumn("v", F.nullif("v", F.lit(float("nan"))))
    assert np.isnan(back(segmentation.resize(holed, (3, 4), (6, 8), 1))[2:4, 2:4]).all()


def test_compare_masks(spark):
    m = np.zeros((8, 8), int)
    m[2:4, 2:5], m[5, 5] = 1, 2
    a = image(spark, m, "label", "int")
    assert tuple(segmentation.compare(a, a, 2).first()) == ("same", 0, 0)
    assert tuple(segmentation.compare(a, image(spark, np.roll(m, (1, -1), (0, 1)), "label", "int"), 2).first()) == ("shifted", 1, -1)
    assert segmentation.compare(a, image(spark, 3 - m, "label", "int"), 2).first()["verdict"] == "different"
    empty = image(spark, np.zeros((3, 3)), "label", "int")
    assert segmentation.compare(empty, empty, 1).first()["verdict"] == "same"


def test_add_labels(spark):
    m, n = np.zeros((6, 6), int), np.zeros((6, 6), int)
    m[0:2, 0:2] = 3
    n[2, 0], n[4:6, 4:6] = 1, 2
    got = back(segmentation.add_labels(image(spark, m, "label", "int"), image(spark, n, "label", "int")), "label")
    assert got[2, 0] == 0 and (got[4:6, 4:6] == 5).all() and (got[0:2, 0:2] == 3).all()


def test_growing_separates_two_sources(spark):
    rng = np.random.default_rng(0)
    a, b = rng.standard_normal(60), rng.standard_normal(60)
    rows = []
    for x in range(9):
        for y in range(7):
            base = a if x in (2, 3) and y in (2, 3, 4) else b if x in (6, 7) and y in (2, 3) else 0
            rows.append((1, x, y, [float(v) for v in base + 0.05 * rng.standard_normal(60)]))
    df = spark.createDataFrame(rows, "k long, x int, y int, series array<double>")
    got = back(segmentation.grow(df, "k", q=0.1, least_corr=0.3), "label")
    assert set(got[2:4, 2:5].ravel()) == {1} or set(got[2:4, 2:5].ravel()) == {2}
    assert len(set(got[6:8, 2:4].ravel())) == 1 and got[6, 2] not in (0, got[2, 2]) and (got > 0).sum() == 10
    small = back(segmentation.grow(df, "k", q=0.1, least_corr=0.3, most=4), "label")
    assert max((small == i).sum() for i in (1, 2)) == 4


def test_seed_mask_is_connected(spark):
    m = np.zeros((7, 7))
    m[2:4, 2:4] = m[6, 6] = 1
    near = segmentation.around_seed(image(spark, m), (2, 2), 9, F.col("v"), 0.5).withColumn("k", F.lit(1).cast("long"))
    got = {(r["x"], r["y"]): r["component"] for r in masks.connected(near, "k", "label").collect()}
    assert got[2, 2] == got[3, 3] != got[6, 6] and got[0, 0] == 0


def test_cell_type_table(spark):
    t = {r["cluster_id"]: r for r in cell_types.table(spark).collect()}
    assert len(t) == 75 and t[5]["cluster_name"] == "4b" and t[5]["group_id"] == 4 and t[75]["group_name"] == "On local 2"
    assert {r["supergroup"] for r in t.values()} == {"OFF", "ON-OFF", "Fast ON", "Slow ON", "Unc. ON", "Unc. SbC", "dAC"}
    odd = spark.createDataFrame([(0,), (76,), (None,)], "c int").select(cell_types.cluster_name(F.col("c")).alias("n")).distinct().collect()
    assert [r["n"] for r in odd] == ["Unknown"]


def test_stimuli(spark):
    with pytest.warns(UserWarning):
        noise = stimuli.noise(30)
    rows = [stimuli.no_stimulus(), noise, stimuli.chirp(), stimuli.moving_bar()]
    t = stimuli.table(spark, rows)
    assert t.count() == 4 and stimuli.conflicts(t).count() == 0
    bar = t.where("stim_name = 'movingbar'").first()
    assert [i["name"] for i in bar["trial_info"]][:3] == ["0", "180", "45"] and t.where("stim_name = 'noise'").first()["stim_dict"]["offset_x_um"] == 0
    with pytest.raises(ValueError):
        stimuli.table(spark, [stimuli.chirp(), stimuli.chirp(name="other")])
    with pytest.raises(ValueError):
        stimuli.trials([1, 2], 3)
    with pytest.raises(ValueError):
        stimuli.trials([{"name": "a", "ntrigger": 1, "odd": 2}], 1)
    with pytest.raises(TypeError):
        stimuli.trials("ab", 2)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert stimuli.trials([{"name": "a", "ntrigger": 2}], 2)


def test_agglomerative(spark):
    pts = [[0.0, 0.0], [0.1, 0.0], [5.0, 5.0], [5.1, 5.0], [9.0, 0.0]]
    df = spark.createDataFrame([*enumerate(pts * 3), (99, None)], "id int, v array<double>")
    for kw in ({"k": 3}, {"threshold": 3.0}):
        got = {r["id"]: r["cluster"] for r in learning.agglomerative(df, "v", **kw).collect()}
        assert got.pop(99) is None
        assert got[0] == got[1] == got[5] and got[2] == got[3] and len({got[0], got[2], got[4]}) == 3
    big = {r["id"]: r["cluster"] for r in learning.agglomerative(df, "v", k=3, most=4, approximate=True).collect()}
    assert big.pop(99) is None
    assert big[0] == big[1] and big[2] == big[3] and len(set(big.values())) == 3
    rows = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, [2.0, 4.0, 6.5]), (2, [3.0, 2.0, 1.0])], "id int, v array<double>")
    got = {r["id"]: r["cluster"] for r in learning.agglomerative(rows, "v", "complete", threshold=0.9).collect()}
    assert got[0] == got[1] != got[2]
    assert learning.agglomerative(df.where("false"), "v", k=2).count() == 0


def test_ward_matches_the_variance_criterion():
    x = np.random.default_rng(2).standard_normal((12, 3))
    label, w = np.arange(12), np.ones(12)
    while len(set(label)) > 4:  # brute force: the merge that adds the least variance
        sse = lambda m: ((x[m] - x[m].mean(0)) ** 2).sum()
        ids = sorted(set(label))
        i, j = min(((a, b) for a in ids for b in ids if a < b), key=lambda p: sse(np.isin(label, p)) - sse(label == p[0]) - sse(label == p[1]))
        label[label == j] = i
    assert fitting.agglomerate(x, w, "ward", 4).tolist() == np.unique(label, return_inverse=True)[1].tolist()


def test_covariance_and_sparse_components(spark):
    rng = np.random.default_rng(3)
    z = rng.standard_normal((400, 2))
    x = np.column_stack([z[:, 0], z[:, 0], z[:, 0], z[:, 1], z[:, 1], rng.standard_normal(400)]) + 0.1 * rng.standard_normal((400, 6))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, v array<double>").repartition(5)
    mean, sd, c = learning.covariance(df, "v")
    assert mean == pytest.approx(x.mean(0)) and sd == pytest.approx(x.std(0)) and c == pytest.approx(np.corrcoef(x.T))
    out, loadings, share = learning.sparse_pca(df, "v", 2, share=0.3)
    assert set(np.flatnonzero(loadings[0])) == {0, 1, 2} and set(np.flatnonzero(loadings[1])) == {3, 4}
    assert 0.75 < share < 0.9 and len(out.first()["spc"]) == 2


def test_imaging_tables_end_to_end(spark, tmp_path):
    from epochal.plans import tables

    rng = np.random.default_rng(5)
    s = tables.imaging(spark, str(tmp_path / "db"))
    n, step = 60, 10
    wave = np.tile(np.concatenate((np.ones(5), np.zeros(5))), 6)
    pixels = []
    for rec in (1, 2):
        for i in range(1, n + 1):
            for x in range(5):
                for y in range(3):
                    signal = wave[i - 1] if x in (1, 2) else 1 - wave[i - 1] if x == 4 else 0.0
                    pixels.append((rec, "chirp", i, x, y, float(signal + 0.05 * rng.standard_normal())))
    s.insert("stack", spark.createDataFrame(pixels, "rec int, stim string, i int, x int, y int, v double"))
    s.insert("frame", spark.createDataFrame([(r, "chirp", i, n, 1000 * i, i % step == 1) for r in (1, 2) for i in range(1, n + 1)], "rec int, stim string, i int, n int, us long, trigger boolean"))
    s.insert("stimulus", spark.createDataFrame([("chirp", 1, True)], "stim string, ntrigger_rep int, isrepeated boolean"))
    s.insert("preprocess", spark.createDataFrame([(1, 0, 3, False, False, 0), (2, 12, 2, False, False, 2)], "pre int, half int, poly_order int, subtract_baseline boolean, non_negative boolean, standardize int"))
    label = {0: 9, 1: 1, 2: 1, 3: 0, 4: 2}
    s.insert("roi_mask", spark.createDataFrame([(r, x, y, label[x]) for r in (1, 2) for x in range(5) for y in range(3)], "rec int, x int, y int, label int"))
    s.insert("geometry", spark.createDataFrame([(r, 2.0, 1, 5, 3, 10.0, 0.0, 0.0, "right") for r in (1, 2)], "rec int, pixel_um double, artifact_columns int, width int, height int, dx_um double, dy_um double, rotation double, eye string"))
    made = {name: s.populate(name) for name in s.order() if s.nodes[name].compute}
    assert made["roi"] == 2 and made["processed"] == 8 and made["corr_map"] == 2
    assert {r["roi"]: (r["pixels"], r["artifact"]) for r in s.table("roi").where("rec = 1").collect()} == {1: (6, False), 2: (3, False), 9: (3, True)}
    assert s.table("traces").select("roi").distinct().count() == 2  # the artifact has none
    q = s.table("repeat_qi").where("pre = 1").collect()
    assert len(q) == 4 and all(r["qidx"] > 0.9 for r in q)
    polarity = {r["roi"]: r["polarity"] for r in s.table("indices").where("rec = 2 AND pre = 1").collect()}
    assert polarity[1] > 0.8 and polarity[2] < -0.8
    assert s.table("presentation_qi").count() == 4 and s.table("presentation_qi").first()["share_50"] == 1
    at = s.table("roi_location").where("rec = 1 AND roi = 1").first()
    assert at["x_um"] == pytest.approx((1.5 + 0.5 - 2.5) * 2 + 10) and at["y_um"] == pytest.approx(0)
    assert 0.55 < s.table("corr_map").first()["most"] < 0.8  # 5 of 8 neighbours share the signal
    left = {name: s.missing(name).count() for name in ("roi", "traces", "snippets", "indices", "corr_map")}
    assert left == dict.fromkeys(left, 0)


def test_process_steps(spark):
    from epochal.operators import series

    v = [5.0, 1.0, 2.0, 1.0, 2.0, 1.0, 8.0, 9.0, 2.0, 1.0]
    df = spark.createDataFrame([(1, i + 1, 10, x, i == 6) for i, x in enumerate(v)], "k long, i int, n int, v double, go boolean")
    plain = [r["v"] for r in series.process(df, "k").orderBy("i").collect()]
    assert plain[3:] == v[3:7] + plain[7:] and len(plain) == 10
    got = [r["v"] for r in series.process(df, "k", baseline=True, standardise=1, is_trigger=F.col("go")).orderBy("i").collect()]
    base = np.array(plain[:5])
    assert got == pytest.approx(list((np.array(plain) - np.median(base)) / base.std()))
    assert min(r["v"] for r in series.process(df, "k", positive=True, standardise=2, cutoff=1.0, fs=10.0).collect()) == 0
    with pytest.raises(ValueError):
        series.process(df, "k", baseline=True)


def one_lasso(x, y, beta, xd, yd, rounds=1000, least=50, patience=5):
    """Accelerated proximal steps of a single problem, in full."""
    step = 1 / max(np.linalg.norm(x, 2) ** 2 / len(x), 1e-12)
    w = z = np.zeros(x.shape[1])
    m, best, kept, bad = 1.0, np.inf, w, 0
    for k in range(rounds):
        u = z - step * (x.T @ (x @ z - y)) / len(x)
        new = np.sign(u) * np.maximum(np.abs(u) - step * beta, 0)
        m2 = (1 + np.sqrt(1 + 4 * m * m)) / 2
        z, w, m = new + (m - 1) / m2 * (new - w), new, m2
        if k % 10 == 0:
            e = np.mean((yd - xd @ w) ** 2)
            if e < best - 1e-9:
                best, kept, bad = e, w, 0
            elif k >= least:
                bad += 1
                if bad >= patience:
                    break
    return kept


def test_filters_of_many_keys_are_fitted_together(monkeypatch):
    """A stack of problems ends each where it would end alone, in about the steps of its slowest one."""
    rng = np.random.default_rng(5)
    x, xd = rng.normal(size=(60, 40, 5)), rng.normal(size=(60, 12, 5))
    x[0], x[1, :, 2] = 0.0, x[1, :, 1]
    w = rng.normal(size=(60, 5))
    y, yd = np.einsum("kij,kj->ki", x, w) + rng.normal(size=(60, 40)), np.einsum("kij,kj->ki", xd, w) + rng.normal(size=(60, 12))
    beta = rng.choice([0.001, 0.1, 3.0], 60)
    calls, times = [], fitting.times
    monkeypatch.setattr(fitting, "times", lambda *a: calls.append(1) or times(*a))
    got = fitting.lasso_paths(x, y, beta, xd, yd)
    assert len(calls) <= 2 * 1000 + 100
    for k in range(60):
        assert np.allclose(got[k], one_lasso(x[k], y[k], beta[k], xd[k], yd[k]), atol=1e-12)


def test_spline_filter_of_keys_of_many_lengths(spark):
    """Every key as it is alone; a key with missing responses has no filter and harms no other."""
    rng = np.random.default_rng(6)
    rows = [(k, i, float(rng.integers(2)), float(rng.normal()) if k != 3 or i != 4 else None) for k, n in enumerate([30, 41, 30, 30, 2, 75, 41]) for i in rng.permutation(n).tolist()]
    df = spark.createDataFrame(rows, "k long, i int, s double, r double")
    args = ("k", "s", "r", 5, [3, 4], [0.001, 0.01])
    got = {r["k"]: r for r in receptive.spline_filter(df, *args).collect()}
    assert sorted(got) == list(range(7)) and got[3]["filter"] == [0.0] * 5 and got[3]["mse_test"] is None and got[4]["cc_test"] == 0
    for k in (0, 1, 5):
        assert receptive.spline_filter(df.where(F.col("k") == k), *args).first() == got[k]
    assert receptive.spline_filter(df, *args, shuffles=0).where("p_value is not null").count() == 0
