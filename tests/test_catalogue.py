"""All declared tables from small recordings, end to end."""

import numpy as np
import pytest

from epochal.functions import tuning
from epochal.plans import catalogue, params

STEP, N = 125_000, 96
TRIGGERS = {"chirp": 32, "lchirp": 32, "movingbar": 6, "noise": 4, "sinespot": 4, "csl": 8}


@pytest.fixture(scope="module")
def db(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    s = catalogue.full(spark, str(tmp_path_factory.mktemp("db") / "all"), fs=8.0, step=STEP)
    put = lambda name, rows, schema: s.insert(name, spark.createDataFrame(rows, schema).coalesce(1))
    pixels, alt, frames, triggers = [], [], [], []
    label = {0: 9, 1: 1, 2: 1, 3: 0, 4: 2}
    for rec in (1, 2):
        for stim, every in TRIGGERS.items():
            phase = np.arange(N) % every
            wave = {"chirp": phase < 16, "lchirp": phase < 8, "movingbar": (phase < 3) * (1 + (np.arange(N) // every) % 8), "noise": rng.integers(0, 2, N)}.get(stim, phase < every // 2).astype(float)
            for i in range(N):
                frames.append((rec, stim, i + 1, N, STEP * (i + 1), bool(phase[i] == 0)))
                for x in range(5):
                    for y in range(3):
                        v = (wave[i] if x in (1, 2) else wave.max() - wave[i] if x == 4 else 0.0) + 0.05 * rng.standard_normal()
                        pixels.append((rec, stim, i + 1, x, y, float(v)))
                        if i < 12 and stim == "chirp":
                            alt.append((rec, stim, i + 1, x, y, float(x + 0.1 * rng.standard_normal())))
            triggers += [(rec, stim, j + 1, STEP * (i + 1)) for j, i in enumerate(range(0, N, every))]
    put("stack", pixels, "rec int, stim string, i int, x int, y int, v double")
    put("stack_alt", alt, "rec int, stim string, i int, x int, y int, v double")
    put("frame", frames, "rec int, stim string, i int, n int, us long, trigger boolean")
    put("trigger", triggers, "rec int, stim string, j int, us long")
    put("stimulus", [(k, 1, k != "noise") for k in TRIGGERS], "stim string, ntrigger_rep int, isrepeated boolean")
    put("preprocess", [(1, 0, 3, False, False, 0)], params.TABLES["preprocess"][1])
    put("roi_mask", [(r, x, y, label[x]) for r in (1, 2) for x in range(5) for y in range(3)], "rec int, x int, y int, label int")
    put("presentation_mask", [(r, "chirp", x + (r == 2), y, label[x]) for r in (1, 2) for x in range(5) for y in range(3)], "rec int, stim string, x int, y int, label int")
    put("geometry", [(r, 2.0, 1, 5, 3, 10.0, 0.0, 0.0, "right") for r in (1, 2)], "rec int, pixel_um double, artifact_columns int, width int, height int, dx_um double, dy_um double, rotation double, eye string")
    head = {"prep": "", "eye": "right", "prepwmorient": "90", "pharmdrug": "none", "prepwmopticdiscpos": "5;6;7", "animdob": "2020-01-05", "animgender": "f"}
    put("header", [(7, "/data/20210203/1", head)], "exp int, folder string, header map<string,string>")
    scan = {"user_dxpix": 80.0, "user_dypix": 64.0, "user_npixretrace": 10.0, "user_nxpixlineoffs": 6.0, "realpixdur": 25.0, "xcoord_um": 100.0, "ycoord_um": 50.0, "zoom": 0.65}
    names = ["SMP_M1_GCL0_chirp_control.h5", "SMP_M1_GCL0_noise_control.h5", "SMP_M1_GCL0_chirp_drug.h5", "SMP_M1_ods_x_control.h5", "SMP_M1_GCL0_hq_control.h5", "readme.txt"]
    put("recording_file", [(7, "/data/20210203/1", n, scan, 1.0, 2.0, 3.0) for n in names], "exp int, folder string, filename string, scan map<string,double>, odx double, ody double, odz double")
    places = {"animal": 1, "field": 2, "stimulus": 3, "cond1": 4, "region": 2}
    s.insert("user", params.rows(spark, "user", {"experimenter": "DataUser", "data_dir": "/data", "places": places}))
    put("field_of", [(1, 7, "GCL0", "control"), (2, 7, "GCL0", "drug")], "rec int, exp int, field string, cond string")
    put("high_stack", [(7, "GCL0", i, x, 0, float(i * x)) for i in range(5) for x in range(4)], "exp int, field string, i int, x int, y int, v double")
    put("trial", [("chirp", "up", 1, None, 0), ("lchirp", "down", 1, 1, 0)], "stim string, name string, ntrigger int, ntrigger_split int, place int")
    put("bar_order", [("movingbar", [0.0, 180.0, 45.0, 225.0, 90.0, 270.0, 135.0, 315.0], 0.125)], "stim string, directions array<double>, dt double")
    put("shift_raw", [(1, "chirp", 1, f, float(f % 3), float(f % 2)) for f in range(1, 20)], "rec int, stim string, motion_id int, f int, dx double, dy double")
    put("outline_point", [(7, 2, 30.0, 40.0), (7, 1, 10.0, 20.0)], "exp int, num int, x double, y double")
    lines = ["20210203 101500 INFO     {'x': 'STARTED'}", "20210203 101600 ERROR    {'x': 'lost'}", "20210203 101700 INFO     {'x': 'FINISHED'}"]
    put("log_line", [(7, "a.log", i, t) for i, t in enumerate(lines)], "exp int, path string, line_no int, line string")
    put("place_entry", [("t", 1, 1.0, 2.0)], "table_id string, rec int, ventral_dorsal_pos_um double, temporal_nasal_pos_um double")
    s.insert("location_table", params.rows(spark, "location_table", {"table_id": "t", "path": "x.csv"}))
    put("noise_frame", [("noise", f, float(rng.integers(0, 2) * 2 - 1)) for f in range(24)], "stim string, f int, s double")
    t, x, y = np.meshgrid(np.arange(8), np.arange(6), np.arange(5), indexing="ij")
    w = np.exp(-((t - 5) ** 2) / 3) * np.exp(-((x - 2) ** 2 + (y - 2) ** 2) / 2)
    put("rf", [(1, "noise", 1, 1, float(a) / 8 - 1, int(b), int(c), float(v)) for a, b, c, v in zip(t.ravel(), x.ravel(), y.ravel(), w.ravel(), strict=True)], "rec int, stim string, roi int, rf_id int, t double, x int, y int, w double")
    add = lambda name, *items: s.insert(name, params.rows(spark, name, *items))
    add("ipl_border", {"rec": 1, "left": 0.0, "right": 1.0, "thick": 2.0}, {"rec": 2, "left": 0.0, "right": 0.0, "thick": 1.0})
    add("ipl_bins", {"bin_id": 1, "borders": [-1.0, 0.0, 0.5, 2.0]})
    add("features_params", {"features_id": 1, "kind": "pca", "ncomps": [2, 1], "roles": ["chirp", "lchirp"]}, {"features_id": 2, "kind": "none", "ncomps": [0], "roles": ["chirp"]})
    add("clustering_params", {"clustering_id": 1, "k": 2}, {"clustering_id": 2, "kind": "gmm", "k": 2, "folds": 1})
    add("noise_params", {"noise_id": 1}, {"noise_id": 2, "fit_kind": "gradient"})
    add("sta_params", {"sta_id": 1, "past": 0.5}, {"sta_id": 2, "past": 0.5, "method": "mle"})
    add("fast_sta_params", {"fast_id": 1, "past": 0.5})
    add("glm_params", {"glm_id": 1, "lags": 4, "dfs": [3], "betas": [0.001], "shuffles": 5})
    add("glm_quality_params", {"quality_id": 1})
    add("split_params", {"split_id": 1}, {"split_id": 2, "method": "sd"})
    add("contour_params", {"contour_id": 1, "levels": [0.3]})
    add("cs_params", {"cs_id": 1})
    add("cascade_traces_params", {"ct_id": 1})
    add("classifier_method", {"method_id": "few", "trees": 5, "seed": 1})
    add("celltype_params", {"gate_id": 1, "least": 0.0}, {"gate_id": 2, "least": 1.01})
    s.insert("training_cell", training_cells(spark, range(40)))
    put("training_basis", [("t", [[1.0] * 120 + [0.0] * 129, [0.0] * 120 + [1.0] * 129], [[1.0] * 32])], "training_id string, chirp_basis array<array<double>>, bar_basis array<array<double>>")
    return s, s.populate_all()


def training_cells(spark, ids):
    """Cells of two classes, told apart by which part of the chirp they follow."""
    rng = np.random.default_rng(11)
    rows = [("t", i, (np.r_[np.full(120, i % 2), np.full(129, 1 - i % 2)] + 0.1 * rng.normal(size=249)).tolist(), rng.normal(size=32).tolist(), 0.5, 60.0, 3 if i % 2 else 8) for i in ids]
    return spark.createDataFrame(rows, "training_id string, cell int, chirp array<double>, bar array<double>, bar_ds_pvalue double, roi_size_um2 double, cluster int")


def one(s, name, where="true"):
    return s.table(name).where(where).first()


def test_every_table_is_made(db):
    s, made = db
    computed = [n for n in s.order() if s.nodes[n].compute]
    assert set(made) == set(computed)
    empty = [n for n in computed if not s.has(n) or s.table(n).isEmpty()]
    assert empty == []
    assert all(s.missing(n).isEmpty() for n in ("roi", "os_ds", "glm_quality", "chirp_surround"))
    assert set(s.inputs("retinal_roi")) >= {"roi", "header", "rel_field", "geometry"} and "retinal_roi" in s.reflect()


def test_experiment_and_places(db):
    s, _ = db
    e = one(s, "experiment")
    assert (str(e["date"]), e["exp_num"]) == ("2021-02-03", 1) and one(s, "animal_age")["age_days"] == 395
    i = one(s, "exp_info")
    assert (i["prep"], i["eye"], i["prepwmorient"], i["odx"]) == ("wholemount", "right", 90.0, 5.0) and one(s, "pharm_info")["pharm"] == 0
    kinds = {r["filename"]: r["kind"] for r in s.table("file_info").collect()}
    assert kinds["SMP_M1_ods_x_control.h5"] == "od" and kinds["SMP_M1_GCL0_hq_control.h5"] == "hr" and "readme.txt" not in kinds
    f = one(s, "field", "cond = 'control'")
    assert f["filepath"].endswith("GCL0_chirp_control.h5") and f["pix_nx"] == 64
    assert one(s, "optic_disk")["source"] == "file" and one(s, "rel_field", "cond = 'control'")["relx"] == 99.0
    r = one(s, "retinal_field", "cond = 'control'")
    assert r["ventral_dorsal_pos_um"] == pytest.approx(-48) and r["temporal_nasal_pos_um"] == pytest.approx(-99)
    assert one(s, "retinal_category", "cond = 'control'")["ntvd_side"] == "tv"
    roi = one(s, "rel_roi", "rec = 1 AND roi = 1")
    assert roi["relx"] == pytest.approx(99.0) and roi["rely"] == pytest.approx(48 - (1.5 + 0.5 - 2.5) * 2)
    assert one(s, "outline_rel")["relative"][0]["x"] == 9.0 and one(s, "field_from_table")["ventral_dorsal_pos_um"] == 1.0
    d = one(s, "ipl_depth", "rec = 1 AND roi = 2")
    assert d["depth"] == pytest.approx((1 - 1.0) / 2) and one(s, "ipl_bin", "rec = 1 AND roi = 2")["bin"] == 1


def test_images_and_logs(db):
    s, _ = db
    m = {r["rec"]: (r["relation"], r["dx"]) for r in s.table("mask_presentation").collect()}
    assert m == {1: ("same", 0), 2: ("shifted", 1)}
    b = one(s, "brightness", "rec = 1 AND stim = 'chirp' AND roi = 9")
    assert b["brightness"] == pytest.approx(0, abs=0.1) and b["brightness_alt"] == pytest.approx(0, abs=0.1)
    assert s.table("brightness").where("stim = 'noise' AND brightness_alt IS NULL").count() == 6
    x = {r["roi"]: r["sr_index"] for r in s.table("sr_index").where("rec = 1").collect()}
    assert set(x) == {1, 2, 9}
    run = one(s, "stim_log")
    assert (run["ended"] - run["started"]).seconds == 120 and one(s, "log")["errors"] == 1 and one(s, "log_file")["idx"] == 1
    assert one(s, "motion")["most"] >= 1 and one(s, "high_resolution_averages", "x = 2")["v"] == 4.0
    c = one(s, "cross_condition", "stim = 'chirp'")
    assert abs(c["dx"]) <= 1 and c["cond"] == "drug" and c["rec"] == 2
    p = one(s, "presentation", "stim = 'chirp'")
    assert p["ntrigger"] == 3 and p["trigger_valid"]


def test_responses(db):
    s, _ = db
    q = one(s, "chirp_bc", "rec = 1 AND roi = 1")
    assert q["polarity_index"] is not None and len(q.asDict()) == 4 + 11
    assert one(s, "chirp_qi", "roi = 1")["qidx"] > 0.9 and one(s, "chirp_rgc", "roi = 1") is not None
    t = one(s, "os_ds", "rec = 1 AND roi = 1")
    angles = np.deg2rad(np.arange(0, 360, 45.0))
    ds, pref = tuning.selectivity(np.array([0, 2, 4, 6, 1, 3, 5, 7]) / 7, angles, 1)  # responses grow with the order of the bars
    assert t["ds_index"] == pytest.approx(ds, abs=0.02) and t["pref_dir"] == pytest.approx(pref, abs=0.2)
    assert 0 <= t["ds_pvalue"] <= 1 and len(t["dir_component"]) == 8
    g = s.table("group_snippets").where("rec = 1 AND roi = 1 AND stim = 'chirp'")
    assert {r["name"] for r in g.collect()} == {"up"} and g.select("rep").distinct().count() == 3
    assert s.table("resampled_averages").where("rec = 1 AND roi = 1 AND stim = 'chirp'").count() == 32
    b = one(s, "typed_trace")
    assert len(b["preproc_chirp"]) == 249 and len(b["preproc_bar"]) == 32 and max(map(abs, b["preproc_chirp"])) == pytest.approx(1)
    assert s.table("clusters").select("features_id", "clustering_id").distinct().count() == 4


def test_filters(db):
    s, _ = db
    d = s.table("sta_data_set").where("noise_id = 1 AND sta_id = 2 AND part = 'train'").collect()
    assert len(d) == 4 and all(r["n"] == 76 for r in d)
    g = one(s, "gauss", "split_id = 1")
    assert g["cx"] == pytest.approx(2, abs=0.1) and g["cy"] == pytest.approx(2, abs=0.1)
    o = one(s, "rf_offset", "split_id = 1")
    assert o["dx_um"] == pytest.approx((g["cx"] + 0.5 - 10) * 30)
    assert 0 < one(s, "contour_metrics")["centre_share"] < 1
    assert 0 <= one(s, "glm_quality")["rf_glm_qidx"] <= 1
    assert one(s, "temporal_rf", "split_id = 1")["polarity"] == 1
    assert s.table("cascade_spikes").where("rate < 0").count() == 0


def rows_of(s, name, where, value, *key):
    """{key: value} of a table's rows."""
    return {tuple(r[k] for k in key) if len(key) > 1 else r[key[0]]: r[value] for r in s.table(name).where(where).collect()}


def test_headers_give_their_values(db):
    s, _ = db
    assert tuple(one(s, "animal"))[1:] == ("f", "", "") and tuple(one(s, "indicator"))[1:] == ("", "", "", "")
    assert one(s, "pharm_info")["drug"] == "none" and {r["note"] for r in s.table("example").collect()} == {""}


def test_noise_traces_and_their_averages(db):
    s, _ = db
    where = "rec = 1 AND stim = 'noise' AND roi = 1"
    raw = rows_of(s, "traces", where, "v", "i")
    shown = rows_of(s, "noise_trace", where + " AND noise_id = 1", "f", "i")
    v = np.array([raw[i] for i in sorted(shown)])
    got = rows_of(s, "noise_trace", where + " AND noise_id = 1", "v", "i")
    assert np.allclose([got[i] for i in sorted(shown)], np.clip(v / v.std(), -7, 7))
    rise = np.maximum(np.diff(v, prepend=v[0]), 0)
    got = rows_of(s, "noise_trace", where + " AND noise_id = 2", "v", "i")
    assert np.allclose([got[i] for i in sorted(shown)], np.clip(rise / rise.std(), -7, 7))
    # The average of the stimulus at four lags, weighted by all traces of the region.
    frames = rows_of(s, "noise_frame", "stim = 'noise'", "s", "f")
    pairs = [(r["f"], r["v"]) for r in s.table("noise_trace").where(where).collect()]
    w = rows_of(s, "fast_sta", where, "w", "p")
    for p in range(4):
        assert w[p] == pytest.approx(sum(frames.get(f - p, 0.0) * x for f, x in pairs) / sum(x for _, x in pairs))


def test_a_planted_filter_is_described(db):
    s, _ = db
    t, x, y = np.arange(8), np.arange(6)[:, None], np.arange(5)[None, :]
    time, space = np.exp(-((t - 5) ** 2) / 3), np.exp(-((x - 2) ** 2 + (y - 2) ** 2) / 2)
    svd = one(s, "split_rf", "split_id = 1")
    at = [space[a, b] for a, b in zip(svd["xs"], svd["ys"], strict=True)]
    assert np.allclose(np.outer(svd["time"], svd["space"]), np.outer(time, at), atol=1e-9) and svd["explained"] == pytest.approx(1)
    sd = one(s, "split_rf", "split_id = 2")
    assert np.allclose(sd["space"], [space[a, b] * time.std() for a, b in zip(sd["xs"], sd["ys"], strict=True)]) and np.allclose(sd["time"], time)
    d = one(s, "dog", "split_id = 1")
    assert d["explained"] > 0.99 and d["cx"] == pytest.approx(2, abs=0.1) and d["cy"] == pytest.approx(2, abs=0.1)
    c = one(s, "contours", "split_id = 1")
    assert c["n"] == 1 and c["area"] == pytest.approx(-2 * np.log(0.3) * np.pi, rel=0.1) and (c["cx"], c["cy"]) == pytest.approx((2, 2), abs=0.05) and c["inside"] == 9
    assert one(s, "contour_metrics", "split_id = 1")["centre_share"] == pytest.approx(9 / (9 + c["ring"]))
    for r in s.table("center_surround").collect():
        assert r["polarity"] == 1 and r["peak_lag"] == pytest.approx(0.375, abs=0.02)
    o, m, r = one(s, "rf_offset", "split_id = 1"), one(s, "roi_wrt_field", "rec = 1 AND roi = 1"), one(s, "rf_roi_offset", "split_id = 1")
    assert (r["rf_dx_um"], r["rf_dy_um"]) == pytest.approx((o["dx_um"] - m["relx_wrt_field"], o["dy_um"] - m["rely_wrt_field"])) and r["rf_d_um"] == pytest.approx(np.hypot(r["rf_dx_um"], r["rf_dy_um"]))


def test_features_rates_and_models(db):
    s, _ = db
    where = "rec = 2 AND roi = 1"
    chirp = rows_of(s, "averages", where + " AND stim = 'chirp'", "average", "t")
    assert one(s, "features", where + " AND features_id = 2")["features"] == pytest.approx([chirp[i] for i in sorted(chirp)])
    assert len(one(s, "features", where + " AND features_id = 1")["features"]) == 3
    trace = rows_of(s, "cascade_traces", where + " AND stim = 'chirp'", "v", "i")
    rate = rows_of(s, "cascade_spikes", where + " AND stim = 'chirp'", "rate", "i")
    assert all(rate[i] == pytest.approx(max(trace[i] - trace.get(i - 1, trace[i]), 0)) for i in trace)
    steps = {}
    for r in s.table("snippets").where("stim = 'csl' AND rec = 1 AND roi = 1").collect():
        steps.setdefault(r["rep"], []).append(r["v"])
    x, y = np.array(sorted(steps), float), np.array([np.mean(steps[k]) for k in sorted(steps)])
    slope, base = np.polyfit(x, y, 1)
    line, c = np.mean((y - slope * x - base) ** 2), one(s, "csl", "rec = 1 AND roi = 1")
    assert c["mse"] == pytest.approx(line) if c["kind"] == "linear" else c["mse"] <= 1.05 * line
    for r in s.table("glm").collect():
        assert len(r["filter"]) == 4 and r["df"] == 3 and r["beta"] == 0.001 and -1 <= r["cc_test"] <= 1 and 0 <= r["p_value"] <= 1
    key = ("rec", "roi", "noise_id", "glm_id")
    assert rows_of(s, "glm_quality_dict", "true", "mse_test", *key) == rows_of(s, "glm", "true", "mse_test", *key)


def test_cell_types(db, spark):
    s, _ = db
    c = one(s, "classifier")
    assert (c["training_id"], c["method_id"], c["n"]) == ("t", "few", 40) and c["test"] == c["train"] == 1.0 and c["path"].endswith(c["version"])
    types = {(r["rec"], r["roi"]): r for r in s.table("cell_type").collect()}
    assert set(types) == {(r["rec"], r["roi"]) for r in s.table("typed_trace").collect()}
    for r in s.table("typed_trace").collect():  # the part of the chirp it follows most
        v = r["preproc_chirp"]
        t = types[r["rec"], r["roi"]]
        assert t["cluster"] in (3, 8) and sum(t["probabilities"]) == pytest.approx(1) and t["confidence"] == max(t["probabilities"])
        if abs(sum(v[:120]) - sum(v[120:])) > 60:
            assert t["cluster"] == (3 if sum(v[:120]) > sum(v[120:]) else 8)
    gated = s.table("cell_type_gated").collect()
    assert {r["cluster"] for r in gated if r["gate_id"] == 2} == {-1}
    assert {(r["rec"], r["roi"]): r["cluster"] for r in gated if r["gate_id"] == 1} == {k: r["cluster"] for k, r in types.items()}


def test_a_changed_model_scores_again_what_depends_on_it(db, spark):
    s, _ = db
    before = one(s, "classifier")["version"]
    assert set(catalogue.retrain(s).values()) == {0} and one(s, "classifier")["version"] == before
    n = s.table("cell_type").count()
    s.insert("training_cell", training_cells(spark, range(40, 44)))
    made = catalogue.retrain(s)
    assert made == {"classifier": 1, "cell_type": n, "cell_type_gated": 2 * n}
    assert {r["version"] for r in s.table("cell_type").collect()} == {one(s, "classifier")["version"]} != {before}
    assert s.table("cell_type").count() == n
