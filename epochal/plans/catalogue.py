"""Further tables of the imaging pipeline, declared over those of ``tables.imaging``.

Manual tables besides those of ``tables`` and ``params`` and their columns:

* ``header``: exp; folder, header (map of texts)
* ``recording_file``: exp, folder, filename; scan (map of numbers), odx, ody, odz
* ``field_of``: rec, exp, field, cond
* ``stack_alt``: rec, stim; i, x, y, v (the second channel)
* ``trigger``: rec, stim; j, us
* ``trial``: stim; name, ntrigger, ntrigger_split, place
* ``bar_order``: stim; directions, dt
* ``presentation_mask``: rec, stim; x, y, label
* ``high_stack``: exp, field; i, x, y, v
* ``shift_raw``: rec, stim, motion_id; f, dx, dy (from an external estimator)
* ``outline_point``: exp; num, x, y
* ``log_line``: exp, path; line_no, line
* ``place_entry``: table_id, rec; ventral_dorsal_pos_um, temporal_nasal_pos_um
* ``noise_frame``: stim; f, s (the stimulus, one value a frame)
* ``rf``: rec, stim, roi, rf_id; t, x, y, w
* ``external_cluster``: rec, roi; cluster
* ``training_cell``: training_id; cell, chirp, bar (responses on the published grids), bar_ds_pvalue, roi_size_um2, cluster
* ``training_basis``: training_id; chirp_basis, bar_basis (filters of the responses)

Tables are long, computed for missing keys only, and compose the operators; nothing is held whole but one key's filter or trace
where a kernel needs it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epochal.functions import scalars
from epochal.functions.shared import numbered
from epochal.operators import epochs, features, learning, masks, places, receptive, responses, series, trials
from epochal.plans import params, tables
from epochal.plans.nodes import Node, Schema
from epochal.plans.tables import PRES, PROC, ROI, TRACE, _of, packed, unpacked
from epochal.sources import logs, recordings

MANUAL = {
    "header": ["exp"], "recording_file": ["exp", "folder", "filename"], "field_of": ["rec", "exp", "field", "cond"], "stack_alt": PRES, "trigger": PRES, "trial": ["stim"], "bar_order": ["stim"],
    "presentation_mask": PRES, "high_stack": ["exp", "field"], "shift_raw": [*PRES, "motion_id"], "outline_point": ["exp"], "log_line": ["exp", "path"], "place_entry": ["table_id", "rec"], "noise_frame": ["stim"], "rf": [*TRACE, "rf_id"], "external_cluster": ROI, "training_cell": ["training_id", "cell"], "training_basis": ["training_id"],
}


def by_params(todo: DataFrame, p: dict, name: str, key: str, compute) -> DataFrame:
    """Union over the sets of a parameter table (short: its rows are literals of the plan)."""
    out = None
    for q in p[name].collect():
        rows = compute(todo.where(F.col(key) == F.lit(q[key])), q)
        rows = rows.withColumn(key, F.lit(q[key]))
        out = rows if out is None else out.unionByName(rows)
    return out


# Experiments, files and fields


def experiment(todo, p):
    e = recordings.experiments(p["header"].select("folder"))
    return _of(todo, p["header"], ["exp"]).select("exp", "folder").join(e, "folder")


def exp_info(todo, p):
    h = _of(todo, p["header"], ["exp"])
    d = h.select("exp", *[c.alias(n) for n, c in recordings.preparation(F.col("header")).items()], recordings.disk_position(F.element_at("header", "prepwmopticdiscpos")).alias("_d"))
    return d.select("exp", "prep", "eye", "prepwmorient", "_d.*")


def of_header(*names: str):
    def compute(todo, p):
        return _of(todo, p["header"], ["exp"]).select("exp", *[F.coalesce(F.element_at("header", n), F.lit("")).alias(n) for n in names])

    return compute


def pharm(todo, p):
    h = _of(todo, p["header"], ["exp"])
    return h.select("exp", recordings.preparation(F.col("header"))["pharm"].alias("pharm"), F.coalesce(F.element_at("header", "pharmdrug"), F.lit("")).alias("drug"))


def animal_age(todo, p):
    e = _of(todo, p["experiment"], ["exp"]).join(p["header"].select("exp", "header"), "exp")
    born = scalars.flexible_date(F.element_at("header", "animdob"))
    return e.select("exp", F.datediff("date", born).alias("age_days")).where("age_days is not null")


def file_info(todo, p):
    """Files read by the grammar of the (first) experimenter."""
    u = p["user"].orderBy("experimenter").first()
    f = _of(todo, p["recording_file"], ["exp"])
    return recordings.file_rows(f, dict(u["places"]), u["disk_alias"], u["high_alias"], u["outline_alias"], u["mask_alias"])


def field(todo, p):
    f = _of(todo, p["file_info"], ["exp"]).where("kind = 'response'")
    best = recordings.preferred(f.withColumn("cond", F.coalesce(F.col("cond1"), F.lit("control"))), ["exp", "field", "cond"])
    return best.select("exp", "field", "cond", "filepath", *[c.alias(n) for n, c in recordings.scan_columns(F.col("scan")).items()])


def high_resolution(todo, p):
    return recordings.preferred(_of(todo, p["file_info"], ["exp"]).where("kind = 'hr'"), ["exp", "field"]).select("exp", "field", "filepath")


def medians(table: str, key: list[str]):
    def compute(todo, p):
        return responses.stack_medians(_of(todo, p[table], key), key)

    return compute


def presentation(todo, p):
    """Triggers of each presentation and whether they are as many as the stimulus says."""
    n = _of(todo, p["trigger"], PRES).groupBy(*PRES).agg(F.count(F.lit(1)).alias("ntrigger"))
    d = n.join(p["stimulus"], "stim")
    ok = F.when(F.col("isrepeated"), F.col("ntrigger") % F.col("ntrigger_rep") == 0).otherwise(F.col("ntrigger") == F.col("ntrigger_rep"))
    return d.select(*PRES, "ntrigger", ok.alias("trigger_valid"))


def scan_info(todo, p):
    f = _of(todo, p["field_of"], ["rec"]).join(p["field"], ["exp", "field", "cond"])
    return f.select("rec", "line_duration", "scan_period", "scan_frequency", "zoom", "angle_deg")


def outline_abs(todo, p):
    return places.outline(_of(todo, p["outline_point"], ["exp"]), "exp")


def log_file(todo, p):
    known = todo.sparkSession.createDataFrame([], "exp int, path string, idx int")
    return recordings.log_index(_of(todo, p["log_line"], ["exp", "path"]).select("exp", "path").distinct(), known, "exp")


def log(todo, p):
    e = logs.parse_lines(_of(todo, p["log_line"], ["exp", "path"]))
    return e.groupBy("path").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("level") == "ERROR").alias("errors")).join(todo.select("exp", "path").distinct(), "path")


def stim_log(todo, p):
    e = logs.parse_lines(_of(todo, p["log_line"], ["exp", "path"]))
    runs = logs.pair(e, "path", ["line_no"], "ts", F.col("body").contains("STARTED"), F.col("body").rlike("FINISHED|ABORTED"))
    return runs.join(todo.select("exp", "path").distinct(), "path")


# Masks, motion, images


def mask_presentation(todo, p):
    """Is each presentation's mask the field's, the field's shifted, or another?"""
    two = _of(todo, p["presentation_mask"], PRES).where("label <> 0")
    one = p["roi_mask"].where("label <> 0").join(todo.select(*PRES).distinct(), "rec")
    return unpacked(responses.mask_relation(packed(one.select(*PRES, "x", "y", "label"), PRES), packed(two.select(*PRES, "x", "y", "label"), PRES), "unit", 5))


def motion(todo, p):
    """Centred shifts; none for the method ``none``."""
    d = packed(_of(todo, p["shift_raw"], [*PRES, "motion_id"]), [*PRES, "motion_id"])
    return unpacked(responses.centred_shifts(d, "unit", 1))


def brightness(todo, p):
    """Mean of each region's pixels in the mean image scaled to 0..1, of both channels (null without the second)."""
    def image(name: str, out: str) -> DataFrame:
        m = _of(todo, p[name], PRES).groupBy(*PRES, "x", "y").agg(F.avg("v").alias("v"))
        by = Window.partitionBy(*PRES)
        scaled = m.withColumn("v", F.try_divide(F.col("v") - F.min("v").over(by), F.max("v").over(by) - F.min("v").over(by)))
        return scaled.join(p["roi_mask"].where("label <> 0"), ["rec", "x", "y"]).groupBy(*PRES, F.col("label").cast("int").alias("roi")).agg(F.avg("v").alias(out))

    d = image("stack", "brightness")
    alt = image("stack_alt", "brightness_alt") if "stack_alt" in p else d.limit(0).withColumnRenamed("brightness", "brightness_alt")
    return d.join(alt, [*PRES, "roi"], "left").join(todo.select(*PRES, "roi").distinct(), [*PRES, "roi"], "left_semi")


def sr_index(todo, p):
    g = p["geometry"].select("rec", "artifact_columns")
    out = None
    for a in sorted(r[0] for r in g.select("artifact_columns").distinct().collect()):  # one a kind of setup
        s = _of(todo, p["stack_alt"], PRES).join(g.where(F.col("artifact_columns") == a), "rec", "left_semi").withColumnRenamed("i", "f")
        m = p["roi_mask"].join(todo.select(*PRES).distinct(), "rec")
        rows = unpacked(responses.brightness_share(packed(s, PRES), packed(m, PRES), "unit", a))
        out = rows if out is None else out.unionByName(rows)
    return out.withColumnRenamed("label", "roi").withColumnRenamed("index", "sr_index")


def light_artifact(todo, p):
    """The first column's samples in epochs at repeats' first triggers, averaged and scaled to 0..1."""
    s = packed(_of(todo, p["stack"], PRES).withColumnRenamed("i", "f"), PRES)
    a = responses.artifact_samples(s, "unit")
    lines = s.where("x = 0").groupBy("unit").agg(F.count_distinct("y").alias("_h"))
    starts = packed(_of(todo, p["frame"], PRES).join(p["stimulus"], "stim").where("trigger"), PRES)
    starts = starts.withColumn("_j", F.row_number().over(Window.partitionBy("unit").orderBy("i"))).where("(_j - 1) % ntrigger_rep = 0")
    at = starts.join(lines, "unit").select("unit", ((F.col("i") - 1) * F.col("_h") + 1).alias("i"), F.lit(True).alias("_go"))
    x = a.join(at, ["unit", "i"], "left")
    sn = epochs.snippets(x, epochs.epoch_starts(x, "unit", F.coalesce("_go", F.lit(False))), "unit")
    avg = sn.groupBy("unit", "t").agg(F.avg("v").alias("v"))
    by = Window.partitionBy("unit")
    return unpacked(avg.withColumn("v", F.try_divide(F.col("v") - F.min("v").over(by), F.max("v").over(by) - F.min("v").over(by))))


def corr_image(todo, p):
    return unpacked(masks.neighbour_correlation_by(packed(_of(todo, p["stack"], PRES), PRES), "unit", "i")).withColumnRenamed("corr", "v")


def cross_condition(todo, p):
    """Best shift between the correlation image of a field's control and that of each presentation of another condition."""
    m = p["corr_image"].join(p["field_of"], "rec").select("exp", "field", "stim", "cond", "x", "y", "v")
    d = responses.across(m.where("v is not null"), "cond", "control", ["exp", "field", "stim"], 5).withColumnRenamed("other", "cond")
    return d.join(p["field_of"], ["exp", "field", "cond"]).join(todo.select(*PRES).distinct(), PRES, "left_semi").select(*PRES, "cond", "dx", "dy", "score")


def cross_stimulus(reference: str):
    def compute(todo, p):
        d = responses.across(p["corr_image"].where("v is not null").select("rec", "stim", "x", "y", "v"), "stim", reference, ["rec"], 5)
        return d.join(todo.select("rec").distinct(), "rec", "left_semi")

    return compute


# Places


def ipl_depth(todo, p):
    r = _of(todo, p["roi"], ROI).join(p["geometry"].select("rec", "width"), "rec")
    return places.layer_depth(r, p["ipl_border"], "rec", "width").select(*ROI, "depth")


def ipl_bin(todo, p):
    return places.depth_bins(_of(todo, p["ipl_depth"], ROI), p["ipl_bins"]).select(*ROI, "bin_id", F.col("bin").cast("int").alias("bin"))


def optic_disk(todo, p):
    f = _of(todo, p["file_info"], ["exp"]).where("kind = 'od'").withColumn("kind", F.regexp_extract("filename", r"\.([^.]*)$", 1))
    return places.disk_choice(f, _of(todo, p["exp_info"], ["exp"]), ["exp"])


def rel_field(todo, p):
    f = _of(todo, p["field"], ["exp", "field", "cond"]).select("exp", "field", "cond", "absx", "absy", "absz")
    return places.relative_to_disk(f, p["optic_disk"], ["exp"]).select("exp", "field", "cond", "relx", "rely", "relz")


def retinal_field(todo, p):
    d = _of(todo, p["rel_field"], ["exp", "field", "cond"]).join(p["exp_info"].select("exp", "eye", "prepwmorient"), "exp")
    return places.on_retina(d).select("exp", "field", "cond", "ventral_dorsal_pos_um", "temporal_nasal_pos_um")


def retinal_category(dead: float = 0.0):
    def compute(todo, p):
        d = _of(todo, p["retinal_field"], ["exp", "field", "cond"])
        return d.select("exp", "field", "cond", *[c.alias(n) for n, c in places.categories(F.col("ventral_dorsal_pos_um"), F.col("temporal_nasal_pos_um"), dead).items()])

    return compute


def field_from_table(todo, p):
    return places.looked_up(todo, p["place_entry"], ["table_id", "rec"], ["ventral_dorsal_pos_um", "temporal_nasal_pos_um"])


def roi_wrt_field(todo, p):
    g = p["geometry"].select("rec", "pixel_um", "width", "height")
    d = _of(todo, p["roi"], ROI).join(g, "rec").join(p["scan_info"].select("rec", "angle_deg"), "rec", "left").fillna(0.0, ["angle_deg"]).withColumn("z_step_um", F.lit(1.0))
    return places.region_offset(d).select(*ROI, "relx_wrt_field", "rely_wrt_field", "relz_wrt_field")


def rel_roi(todo, p):
    f = p["field_of"].join(p["rel_field"], ["exp", "field", "cond"]).select("rec", "relx", "rely", "relz")
    return places.region_position(_of(todo, p["roi_wrt_field"], ROI), f, ["rec"]).select(*ROI, "relx", "rely", "relz")


def retinal_roi(todo, p):
    e = p["field_of"].join(p["exp_info"], "exp").select("rec", "eye", "prepwmorient")
    return places.on_retina(_of(todo, p["rel_roi"], ROI).join(e, "rec")).select(*ROI, "ventral_dorsal_pos_um", "temporal_nasal_pos_um")


def outline_rel(todo, p):
    d = p["optic_disk"].join(p["exp_info"].select("exp", "eye", "prepwmorient"), "exp")
    return places.relative_outline(_of(todo, p["outline_abs"], ["exp"]), d.select("exp", "odx", "ody", "eye", "prepwmorient"), "exp").select("exp", "relative", "retinal")


# Responses


def group_snippets(todo, p):
    """Snippets of named trials; samples of a presentation are matched to its triggers by time."""
    out = None
    stims = p["trial"].orderBy("place").collect()  # a short manual table
    for stim in sorted({r["stim"] for r in stims}):
        parts = [(r["name"], r["ntrigger"], r["ntrigger_split"]) for r in stims if r["stim"] == stim]
        s = packed(_of(todo.where(F.col("stim") == stim), p["processed"], PROC), PROC)
        units = s.select("unit").distinct()
        t = units.join(p["trigger"].where(F.col("stim") == stim), (F.col("unit.rec") == F.col("rec"))).select("unit", "j", "us")
        rows = trials.group_snippets(s, trials.group_starts(s, t, "unit", "us", parts, 0, None), "unit")
        out = rows if out is None else out.unionByName(rows)
    return unpacked(out)


def resampled(step: int):
    def compute(todo, p):
        """Averages on a common grid of ``step``, in the unit of ``us``."""
        s = packed(_of(todo, p["processed"], PROC).join(p["stimulus"].where("isrepeated"), "stim"), PROC)
        first = s.where("trigger").withColumn("j", F.row_number().over(Window.partitionBy("unit").orderBy("i"))).where("(j - 1) % ntrigger_rep = 0")
        t = first.select("unit", "us", F.row_number().over(Window.partitionBy("unit").orderBy("i")).alias("j"))
        st = trials.starts(s, t, "unit", "us", 1, 0, None)
        want = st.select("unit", "rep", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("_m"), "start").withColumn("i", F.col("start") + F.col("_m"))
        begun = s.select("unit", F.col("i").alias("start"), F.col("us").alias("_u"))
        rows = want.join(s.select("unit", "i", "us", "v"), ["unit", "i"]).join(begun, ["unit", "start"]).select("unit", "rep", (F.col("us") - F.col("_u")).alias("t"), "v")
        return unpacked(trials.resampled_averages(rows, "unit", step, trials.median_step(t, "unit", "us")))

    return compute


def quality_of(family: str):
    def compute(todo, p):
        s = _of(todo, p["snippets"], PROC).where(F.col("stim") == family)
        return unpacked(epochs.repeat_qi(packed(s, PROC), "unit"))

    return compute


def chirp_rgc(fs: float):
    """On-off and transience index of each average's repeats."""
    def compute(todo, p):
        s = packed(_of(todo, p["snippets"], PROC), PROC)
        on = features.on_off_index(s, "unit", (int(2 * fs), int(3 * fs) + 1), (int(5 * fs), int(6 * fs) + 1), max(1, int(fs)))
        tr = responses.fourier_transience(s, "unit", 1 / fs, 0).groupBy("unit").agg(F.avg("transience").alias("transience_index"))
        return unpacked(on.join(tr, "unit"))

    return compute


def chirp_bc(fs: float):
    """Eleven indices of the average response."""
    def compute(todo, p):
        from epochal.functions.kernels import band_power_ratio

        a = packed(_of(todo, p["averages"], PROC), PROC)
        kind = dict(a.dtypes)["unit"]
        high = series.by_kernel(a.withColumnRenamed("t", "i").select("unit", "i", "average"), "unit", lambda pdf: pdf.iloc[:1].assign(high_frequency_index=band_power_ratio(pdf["average"].to_numpy(float)[: int(6 * fs)], fs))[["unit", "high_frequency_index"]], f"unit {kind}, high_frequency_index double")
        freq = responses.level_contrast(a, "unit", fs, 10, 18).select("unit", F.col("low").alias("l_freq_response"), F.col("high").alias("h_freq_response"), F.col("index").alias("lh_freq_index"))
        level = responses.level_contrast(a, "unit", fs, 20, 28).select("unit", F.col("low").alias("l_contrast_response"), F.col("high").alias("h_contrast_response"), F.col("index").alias("lh_contrast_index"))
        d = features.polarity_index(a, "unit", (int(2 * fs), int(4 * fs)), (int(5 * fs), int(7 * fs))).withColumnRenamed("polarity", "polarity_index")
        d = d.join(high, "unit").join(responses.transience(a, "unit", fs).withColumnRenamed("transience", "transience_index"), "unit")
        d = d.join(responses.peak_ratio(a, "unit", fs, 2.0, 0.3).withColumnRenamed("ratio", "plateau_index"), "unit")
        d = d.join(features.tonic_release(a, "unit", int(2 * fs), int(8 * fs)).withColumnRenamed("tonic", "tonic_release_index"), "unit")
        return unpacked(d.join(freq, "unit").join(level, "unit"))

    return compute


def chirp_surround(local: str, whole: str):
    """Surround strength from the responses to a local and a global stimulus, and the two polarities."""
    def compute(todo, p):
        key = ["rec", "roi", "pre"]
        s = p["snippets"].join(todo.select(*key).distinct(), key, "left_semi")
        one, two = (packed(s.where(F.col("stim") == x).drop("stim"), key) for x in (local, whole))
        return unpacked(responses.surround(one, two, "unit"))

    return compute


def spot_features(conditions: int, small: int, large: int, off: int, first: int):
    def compute(todo, p):
        s = packed(_of(todo, p["processed"], PROC).where("stim = 'sinespot'"), PROC)
        sd = F.stddev_pop("v").over(Window.partitionBy("unit"))
        s = s.withColumn("v", F.try_divide("v", sd))
        sn = epochs.snippets(s, epochs.epoch_starts(s, "unit", F.col("trigger")), "unit")
        return unpacked(responses.spot_indices(responses.spot_matrix(sn, "unit", conditions, first), "unit", small, large, off))

    return compute


def os_ds(version: int, shuffles: int):
    """Direction tuning; every bar is an epoch of its own."""
    def compute(todo, p):
        out = None
        for q in p["bar_order"].collect():  # a short manual table
            s = packed(_of(todo.where(F.col("stim") == q["stim"]), p["processed"], PROC), PROC)
            sn = epochs.snippets(s, epochs.epoch_starts(s, "unit", F.col("trigger")), "unit")
            rows = responses.tuning(responses.by_direction(sn, "unit", list(q["directions"])), "unit", list(q["directions"]), q["dt"], version, shuffles)
            out = rows if out is None else out.unionByName(rows)
        return unpacked(out)

    return compute


def csl(todo, p):
    """Saturating fit of the mean response by contrast step (the epoch's number in its repeat)."""
    s = packed(_of(todo, p["snippets"], PROC), PROC)
    m = s.groupBy("unit", "rep").agg(F.avg("v").alias("y"), F.first("rep").cast("double").alias("x"))
    ids = numbered(m.select("unit").distinct(), ["unit"], "_id")
    f = receptive.contrast_fit(m.join(ids, "unit").select("_id", "x", "y"), "_id", "x", "y")
    return unpacked(f.join(ids, "_id").drop("_id"))


# Cell types and clusters


def _array(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "average"))), lambda x: x["average"]).alias(name))  # one average


def typed_traces(chirp: str, bar: str, dt: float, warped: bool = False):
    """Chirp averages and bar time courses on the published grids."""
    def compute(todo, p):
        key = ["rec", "roi", "pre"]
        c = _array(p["averages"].where(F.col("stim") == chirp), key, "preproc_chirp")
        b = p["os_ds"].where(F.col("stim") == bar).select(*key, F.col("time_component").alias("preproc_bar"), "ds_pvalue")
        d = c.join(b, key).join(todo.select(*key).distinct(), key, "left_semi")
        d = learning.warped_chirp(d, "preproc_chirp", dt) if warped else learning.published_chirp(d, "preproc_chirp", dt)
        return learning.published_bar(d, "preproc_bar", dt)

    return compute


def feature_rows(todo, p):
    """Components of the averages of each set's stimuli, one row a region."""
    def one(part, q):
        wide = learning.role_matrix(_array(p["averages"], ["rec", "roi", "pre", "stim"], "v").withColumn("unit", F.struct("rec", "roi", "pre")), "unit", "stim", list(q["roles"]), "v")
        out = wide
        names = []
        for role, k in zip(q["roles"], q["ncomps"], strict=True):
            if q["kind"] == "none":
                out = out.withColumn(f"_{role}", F.col(role))
            elif q["kind"] == "sparse_pca":
                out = learning.sparse_pca(out, role, k)[0].withColumnRenamed("spc", f"_{role}")
            else:
                from pyspark.ml.functions import vector_to_array

                out = learning.scaled_pca(out, role, k)[0].withColumn(f"_{role}", vector_to_array("pc")).drop("pc")
            names.append(f"_{role}")
        return out.select("unit.*", F.concat(*names).alias("features"))

    return by_params(todo, p, "features_params", "features_id", one)


def clusters(todo, p):
    def one(part, q):
        out = None
        for r in part.select("features_id").distinct().orderBy("features_id").collect():  # one a set of parameters
            f = p["features"].where(F.col("features_id") == r[0])
            if q["kind"].startswith("hierarchical"):
                c = learning.agglomerative(f, "features", "ward" if q["kind"].endswith("ward") else "complete", q["k"], q["threshold"])
            elif q["kind"] == "gmm":
                c = learning.assign_mixture(f, "features", learning.mixture(f, "features", range(1, (q["k"] or 6) + 1), kinds=("spherical", "tied", "diag", "full"), cv=q["folds"])[2])
            else:
                raise ValueError(f"unknown kind of clustering: {q['kind']}")
            rows = learning.prune_clusters(c, "cluster", q["min_count"]).drop("cluster").withColumnRenamed("pruned", "cluster").select("features_id", "rec", "roi", "pre", "cluster")
            out = rows if out is None else out.unionByName(rows)
        return out if out is not None else p["features"].limit(0).select("features_id", "rec", "roi", "pre", F.lit(0).alias("cluster"))

    return by_params(todo, p, "clustering_params", "clustering_id", one)


# Cell types


def training_version(cells: DataFrame, basis, method) -> str:
    """A hash of a method's parameters, the filters and all training rows, in whatever order they come."""
    import hashlib

    columns = sorted(cells.columns)
    h = F.xxhash64(F.to_json(F.struct(*columns)))
    n, total, other = cells.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)")), F.bit_xor(F.xxhash64(F.to_json(F.struct(*columns)), F.lit(1)))).first()
    told = [n, total, other, [list(map(float, x)) for x in basis["chirp_basis"]], [list(map(float, x)) for x in basis["bar_basis"]], method["trees"], method["seed"]]
    return hashlib.sha256(repr(told).encode()).hexdigest()


def _versions(p):
    """(training row, method row, version) of every training set with every method; these tables are short."""
    for basis in p["training_basis"].collect():
        cells = p["training_cell"].where(F.col("training_id") == F.lit(basis["training_id"]))
        for method in p["classifier_method"].collect():
            yield basis, method, cells, training_version(cells, basis, method)


def classifier(root: str):
    """A balanced forest for each training set and method, saved below ``_models`` under its version, and its accuracies."""
    def compute(todo, p):
        spark, wanted, out = todo.sparkSession, {(r["training_id"], r["method_id"]) for r in todo.collect()}, []
        for basis, method, cells, version in _versions(p):
            if (basis["training_id"], method["method_id"]) not in wanted:
                continue
            names = [r[0] for r in cells.select("cluster").distinct().orderBy("cluster").collect()]  # one a class
            rows = learning.cell_features(cells, "chirp", "bar", "bar_ds_pvalue", "roi_size_um2", basis["chirp_basis"], basis["bar_basis"])
            index = F.array_position(F.array(*map(F.lit, names)), F.col("cluster")).cast("double") - 1
            rows = rows.withColumn("class", index)
            model, scores = learning.trained(rows, "features", "class", "cell", method["trees"], method["seed"])
            path = f"{root}/_models/{version}"
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)  # of a run that was lost
            features_ = rows.select("feature_names").first()[0]
            learning.save_bundle(spark, model, path, basis["chirp_basis"], basis["bar_basis"], features_, {i: str(c) for i, c in enumerate(names)})
            out.append((basis["training_id"], method["method_id"], version, path, cells.count(), *(None if scores[k] is None else float(scores[k]) for k in ("train", "test", "all"))))
        return spark.createDataFrame(out, "training_id string, method_id string, version string, path string, n long, train double, test double, accuracy double")

    return compute


def cell_type(todo, p):
    """Every region's class by every classifier: (version, cluster, confidence, probabilities)."""
    key, out = ["rec", "roi", "pre"], None
    sizes = p["roi"].select("rec", "roi", F.col("area_um2").alias("roi_size_um2"))
    for c in p["classifier"].collect():  # short: one row a classifier
        part = todo.where((F.col("training_id") == F.lit(c["training_id"])) & (F.col("method_id") == F.lit(c["method_id"])))
        bundle = learning.load_bundle(todo.sparkSession, c["path"])
        cells = _of(part, p["typed_trace"], key).join(sizes, ["rec", "roi"])
        rows = learning.cell_features(cells, "preproc_chirp", "preproc_bar", "ds_pvalue", "roi_size_um2", bundle["chirp_feats"], bundle["bar_feats"])
        rows = learning.classify(rows.where(~F.exists("features", lambda x: x.isNull())), "features", bundle["model"])
        cluster = F.element_at(F.array(*[F.lit(int(bundle["y_names"][i])) for i in range(len(bundle["y_names"]))]), F.col("cell_class") + 1)
        rows = rows.select(*key, *[F.lit(c[k]).alias(k) for k in ("training_id", "method_id", "version")], cluster.alias("cluster"), "confidence", "probabilities")
        out = rows if out is None else out.unionByName(rows)
    return out


def cell_type_gated(todo, p):
    """Classes that the classifier is sure enough of; others are -1."""
    key = ["rec", "roi", "pre", "training_id", "method_id"]
    out = None
    for q in p["celltype_params"].collect():  # a short table
        rows = _of(todo.where(F.col("gate_id") == q["gate_id"]), p["cell_type"], key)
        rows = rows.select(*key, F.lit(q["gate_id"]).alias("gate_id"), "confidence", F.when(F.col("confidence") >= q["least"], F.col("cluster")).otherwise(F.lit(-1)).alias("cluster"))
        out = rows if out is None else out.unionByName(rows)
    return out


def retrain(s: Schema) -> dict[str, int]:
    """Classifiers whose parameters, filters or training rows are no longer those they were fitted on go, with all that they scored, and
    are made again; nothing else is.  Returns the keys made, by table."""
    p = {n: s.table(n) for n in ("training_basis", "training_cell", "classifier_method")}
    now = {(b["training_id"], m["method_id"]): v for b, m, _, v in _versions(p)}
    stale = [(r["training_id"], r["method_id"]) for r in s.table("classifier").collect() if now.get((r["training_id"], r["method_id"])) != r["version"]]
    if stale:
        s.delete("classifier", s.spark.createDataFrame(stale, "training_id string, method_id string"))
    return s.populate_all(["classifier", "cell_type", "cell_type_gated"])


# Noise and receptive fields


def noise_trace(todo, p):
    """Traces of noise presentations with the stimulus frame that each sample shows, in standard deviations and clipped."""
    def one(part, q):
        s = packed(_of(part, p["traces"], TRACE), TRACE)
        units = s.select("unit").distinct()
        t = units.join(p["trigger"], (F.col("unit.rec") == F.col("rec")) & (F.col("unit.stim") == F.col("stim"))).select("unit", "j", "us")
        frames = trials.trigger_frames(t, "unit", "us", 1, 1 << 30)
        d = trials.stimulus_to_trace(s.select("unit", "i", "n", "us", "v"), frames, "unit", "us")
        if q["fit_kind"] == "gradient":
            d = series.difference(d, "unit", True).withColumn("v", F.col("dv")).drop("dv")
        elif q["fit_kind"] == "events":
            d = series.robust_events(d, "unit").withColumn("v", F.col("peak")).drop("peak")
        return unpacked(series.clip_unit(d, "unit").withColumn("v", F.col("vc")).drop("vc"))

    return by_params(todo, p, "noise_params", "noise_id", one)


def sta(dt: float):
    def compute(todo, p):
        def one(part, q):
            key = [*TRACE, "noise_id"]
            x = _of(part, p["noise_trace"], key).join(p["noise_frame"], ["stim", "f"])
            x = packed(x, key)
            lags = responses.timing(q["past"], q["future"], dt)
            rows = responses.design(x, "unit", "s", lags["lags"], lags["shift"])
            if q["method"] == "mle":
                return unpacked(responses.least_squares(rows, "unit", "v"))
            each = rows.select("unit", "v", F.posexplode("x").alias("p", "_x")).groupBy("unit", "p").agg((F.sum(F.col("_x") * F.col("v")) / F.sum("v")).alias("w"))
            return unpacked(each.groupBy("unit").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "w"))), lambda e: e["w"]).alias("w")))  # one filter's lags

        return by_params(todo, p, "sta_params", "sta_id", one)

    return compute


def sta_data_set(dt: float):
    def compute(todo, p):
        def one(part, q):
            key = [*TRACE, "noise_id"]
            x = packed(_of(part, p["noise_trace"], key).join(p["noise_frame"], ["stim", "f"]), key)
            lags = responses.timing(q["past"], q["future"], dt)
            w = packed(_of(part, p["sta"], [*key, "sta_id"]).drop("sta_id"), key)
            d = responses.design(x, "unit", "s", lags["lags"], lags["shift"]).join(w.select("unit", "w"), "unit").withColumn("fit", learning.dot(F.col("x"), F.col("w")))
            return unpacked(responses.split_scores(features.split(d, q["train"], q["dev"]), "unit", "v", "fit"))

        return by_params(todo, p, "sta_params", "sta_id", one)

    return compute


def fast_sta(dt: float):
    """Filters of all traces of a presentation against one design of its stimulus."""
    def compute(todo, p):
        def one(part, q):
            lags = responses.timing(q["past"], q["future"], dt)
            f = p["noise_frame"].withColumnRenamed("f", "i")
            design = responses.design(f, "stim", "s", lags["lags"], lags["shift"]).select("stim", F.col("i").alias("f"), "x")
            x = packed(_of(part, p["noise_trace"], TRACE).withColumn("_stim", F.col("stim")), TRACE).withColumnRenamed("_stim", "stim")
            return unpacked(responses.shared_design(x, design, "unit", ["stim"]))

        return by_params(todo, p, "fast_sta_params", "fast_id", one)

    return compute


def glm(todo, p):
    def one(part, q):
        key = [*TRACE, "noise_id"]
        x = packed(_of(part, p["noise_trace"], key).join(p["noise_frame"], ["stim", "f"]), key)
        ids = numbered(x.select("unit").distinct(), ["unit"], "_id")
        f = receptive.spline_filter(x.join(ids, "unit").select("_id", "i", "s", "v"), "_id", "s", "v", q["lags"], list(q["dfs"]), list(q["betas"]), shuffles=q["shuffles"])
        return unpacked(f.join(ids, "_id").drop("_id"))

    return by_params(todo, p, "glm_params", "glm_id", one)


def glm_quality_dict(todo, p):
    return _of(todo, p["glm"], [*TRACE, "noise_id", "glm_id"]).select(*TRACE, "noise_id", "glm_id", "cc_dev", "cc_test", "mse_test", "p_value")


def glm_single(todo, p):
    from epochal.operators.algebra import best

    g = _of(todo, p["glm"], [*TRACE, "noise_id"]).withColumn("_s", -F.coalesce("cc_test", F.lit(-1.0)))
    return best(g, [*TRACE, "noise_id"], "_s", "glm_id").drop("_s")


def glm_quality(todo, p):
    g = _of(todo, p["glm_single"], [*TRACE, "noise_id"]).join(todo.select(*TRACE, "noise_id", "quality_id").distinct(), [*TRACE, "noise_id"]).join(p["glm_quality_params"], "quality_id")
    tests = [F.col("cc_test") >= F.col("min_cc"), F.col("p_value") <= F.col("max_p"), F.col("mse_test") <= F.col("max_mse")]
    share = sum((F.coalesce(t, F.lit(False)).cast("int") for t in tests), F.lit(0)) / len(tests)
    return g.select(*TRACE, "noise_id", "quality_id", share.alias("rf_glm_qidx"))


RF = [*TRACE, "rf_id"]


def _numbered(rows: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    x = packed(rows, key)
    ids = numbered(x.select("unit").distinct(), ["unit"], "_id")
    return x.join(ids, "unit").drop("unit"), ids


def split_rf(todo, p):
    def one(part, q):
        x, ids = _numbered(_of(part, p["rf"], RF), RF)
        if q["method"] == "svd":
            s = receptive.split_svd(x.withColumnRenamed("_id", "id"), "id").withColumnRenamed("id", "_id")
        else:
            space, time = (receptive.split_sd if q["method"] == "sd" else receptive.split_peak)(x, "_id")
            sp = F.array_sort(F.collect_list(F.struct("x", "y", F.col("w").cast("double").alias("w"))))
            a = space.groupBy("_id").agg(sp.alias("_s")).select("_id", F.col("_s.x").alias("xs"), F.col("_s.y").alias("ys"), F.col("_s.w").alias("space"))
            b = time.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct(F.col("t").cast("double").alias("t"), F.col("w").cast("double").alias("w")))).alias("_t")).select("_id", F.col("_t.t").alias("times"), F.col("_t.w").alias("time"))
            s = b.join(a, "_id").withColumn("explained", F.lit(None).cast("double"))
        return unpacked(s.join(ids, "_id").select("unit", "times", "time", "xs", "ys", "space", "explained"))

    return by_params(todo, p, "split_params", "split_id", one)


SPLIT = [*RF, "split_id"]


def _space(rows: DataFrame) -> DataFrame:
    return rows.select(*SPLIT, F.explode(F.arrays_zip("xs", "ys", "space")).alias("_p")).select(*SPLIT, F.col("_p.xs").alias("x"), F.col("_p.ys").alias("y"), F.col("_p.space").alias("w"))


def over_split(operator, axis: str):
    """An operator of numbered filters over the space or time of each split one."""
    def compute(todo, p):
        s = _of(todo, p["split_rf"], SPLIT)
        rows = _space(s) if axis == "space" else s.select(*SPLIT, F.explode(F.arrays_zip("times", "time")).alias("_p")).select(*SPLIT, F.col("_p.times").alias("t"), F.col("_p.time").alias("w"))
        x, ids = _numbered(rows, SPLIT)
        out = operator(x.withColumnRenamed("_id", "id")).withColumnRenamed("id", "_id")
        return unpacked(out.join(ids, "_id").drop("_id"))

    return compute


def contours(todo, p):
    def one(part, q):
        x, ids = _numbered(_space(_of(part, p["split_rf"], SPLIT)), SPLIT)
        out = receptive.outlines(x.withColumnRenamed("_id", "id"), "id", list(q["levels"]), q["blur"], q["inner"], q["outer"]).withColumnRenamed("id", "_id")
        return unpacked(out.join(ids, "_id").drop("_id"))

    return by_params(todo, p, "contour_params", "contour_id", one)


def contour_metrics(todo, p):
    """Centre and surround of the filters that have a contour: the positive-contour gate."""
    c = _of(todo, p["contours"], [*SPLIT, "contour_id"]).where("area > 0")
    return c.select(*SPLIT, "contour_id", "level", "inside", "ring", F.try_divide(F.col("inside").cast("double"), F.col("inside") + F.col("ring")).alias("centre_share"))


def rf_offset(width: int, height: int, px: float, py: float):
    def compute(todo, p):
        g = _of(todo, p["gauss"], SPLIT)
        return receptive.offset(g, width, height, px, py).select(*SPLIT, "dx_um", "dy_um", F.hypot("dx_um", "dy_um").alias("d_um"))

    return compute


def rf_roi_offset(signs: dict[int, tuple[int, int]], setup: int = 1):
    """Offset of a filter's centre from its region, the setup's axes turned as ``signs`` say."""
    def compute(todo, p):
        sx, sy = signs.get(setup, (1, 1))
        d = _of(todo, p["rf_offset"], SPLIT).join(p["roi_wrt_field"], ROI)
        dx, dy = F.col("dx_um") * sx - F.col("relx_wrt_field"), F.col("dy_um") * sy - F.col("rely_wrt_field")
        return d.select(*SPLIT, dx.alias("rf_dx_um"), dy.alias("rf_dy_um"), F.hypot(dx, dy).alias("rf_d_um"))

    return compute


def center_surround(todo, p):
    """Temporal properties of the kernels of the centre (x 0) and the surround (x 1): their weights, summed over y."""
    def one(part, q):
        r = _of(part, p["rf"], RF).where("x in (0, 1)").withColumn("place", F.when(F.col("x") == 0, "centre").otherwise("surround"))
        key = [*RF, "place"]
        x, ids = _numbered(r.groupBy(*key, "t").agg(F.sum("w").alias("w")), key)
        out = receptive.temporal(x.withColumnRenamed("_id", "id"), "id", q["peak_nstd"], q["latest"]).withColumnRenamed("id", "_id")
        return unpacked(out.join(ids, "_id").drop("_id"))

    return by_params(todo, p, "cs_params", "cs_id", one)


def cascade_traces(todo, p):
    def one(part, q):
        t = packed(_of(part, p["traces"], TRACE), TRACE)
        d = series.process(t, "unit", q["half"], q["poly_order"], cutoff=q["cutoff"])
        return unpacked(series.dff(d, "unit", q["q_low"], q["q_high"]).withColumn("v", F.col("dff")).drop("dff"))

    return by_params(todo, p, "cascade_traces_params", "ct_id", one)


def cascade_spikes(estimate=None):
    """Spike rates of a whole presentation's traces by ``estimate`` (a function of an array of samples, as an external network is); without
    one, the rectified rise of each trace."""
    def compute(todo, p):
        t = packed(_of(todo, p["cascade_traces"], [*TRACE, "ct_id"]), [*TRACE, "ct_id"])
        if estimate is None:
            return unpacked(series.difference(t.select("unit", "i", "v"), "unit", True).select("unit", "i", F.col("dv").alias("rate")))
        kind = dict(t.dtypes)["unit"]
        return unpacked(series.by_kernel(t.select("unit", "i", "v"), "unit", lambda pdf: pdf.assign(rate=estimate(pdf["v"].to_numpy(float)))[["unit", "i", "rate"]], f"unit {kind}, i int, rate double"))

    return compute


def example(todo, p):
    """A skeleton: one row a key."""
    return todo.withColumn("note", F.lit(""))


def full(spark: SparkSession, root: str, fs: float = 7.8125, step: int = 2000, chirp: str = "chirp", local: str = "lchirp", bar: str = "movingbar") -> Schema:
    """``tables.imaging`` with all tables here.  ``fs``: samples a second; ``step``: grid of resampled averages in the unit of ``us``."""
    s = tables.imaging(spark, root)
    for name, (key, _, _) in params.TABLES.items():
        if name not in s.nodes:
            s.add(Node(name, key))
    for name, key in MANUAL.items():
        s.add(Node(name, key))
    cond, dt = ["exp", "field", "cond"], 1 / fs
    add = lambda name, key, parents, compute, **kw: s.add(Node(name, key, parents, compute, **kw))
    add("experiment", ["exp"], ["header"], experiment)
    add("exp_info", ["exp"], ["header"], exp_info)
    add("animal", ["exp"], ["header"], of_header("animgender", "animspecies", "animgenebkground"))
    add("indicator", ["exp"], ["header"], of_header("brdinjectid", "brinjectq", "epdye", "epinjectinto"))
    add("pharm_info", ["exp"], ["header"], pharm)
    add("animal_age", ["exp"], ["experiment", "header"], animal_age)
    add("file_info", ["exp"], ["recording_file", "user"], file_info)
    add("field", cond, ["file_info"], field)
    add("field_averages", PRES, ["stack"], medians("stack", PRES))
    add("presentation", PRES, ["trigger", "stimulus"], presentation)
    add("presentation_averages", PRES, ["stack_alt"], medians("stack_alt", PRES))
    add("scan_info", ["rec"], ["field_of", "field"], scan_info)
    add("high_resolution", ["exp", "field"], ["file_info"], high_resolution)
    add("high_resolution_averages", ["exp", "field"], ["high_stack"], medians("high_stack", ["exp", "field"]))
    add("outline_abs", ["exp"], ["outline_point"], outline_abs)
    add("log_file", ["exp", "path"], ["log_line"], log_file)
    add("log", ["exp", "path"], ["log_line"], log)
    add("stim_log", ["exp", "path"], ["log_line"], stim_log)
    add("mask_presentation", PRES, ["presentation_mask", "roi_mask"], mask_presentation)
    add("motion", [*PRES, "motion_id"], ["shift_raw"], motion)
    add("brightness", [*PRES, "roi"], ["stack", "roi", "roi_mask"], brightness, also=["stack_alt"])
    add("sr_index", PRES, ["stack_alt", "roi_mask", "geometry"], sr_index)
    add("light_artifact", PRES, ["stack", "frame", "stimulus"], light_artifact)
    add("corr_image", PRES, ["stack"], corr_image)
    add("cross_condition", PRES, ["corr_image", "field_of"], cross_condition)
    add("cross_stimulus", ["rec"], ["corr_image"], cross_stimulus(chirp))
    add("ipl_depth", ROI, ["roi", "ipl_border", "geometry"], ipl_depth)
    add("ipl_bin", [*ROI, "bin_id"], ["ipl_depth", "ipl_bins"], ipl_bin)
    add("optic_disk", ["exp"], ["exp_info", "file_info"], optic_disk)
    add("rel_field", cond, ["field", "optic_disk"], rel_field)
    add("retinal_field", cond, ["rel_field", "exp_info"], retinal_field)
    add("retinal_category", cond, ["retinal_field"], retinal_category())
    add("field_from_table", ["table_id", "rec"], ["place_entry", "location_table"], field_from_table)
    add("roi_wrt_field", ROI, ["roi", "geometry", "scan_info"], roi_wrt_field)
    add("rel_roi", ROI, ["roi_wrt_field", "field_of", "rel_field"], rel_roi)
    add("retinal_roi", ROI, ["rel_roi", "field_of", "exp_info"], retinal_roi)
    add("outline_rel", ["exp"], ["outline_abs", "optic_disk", "exp_info"], outline_rel)
    add("group_snippets", PROC, ["processed", "trial", "trigger"], group_snippets)
    add("resampled_averages", PROC, ["processed", "stimulus"], resampled(step), only={"stimulus": "isrepeated"})
    add("chirp_qi", PROC, ["snippets"], quality_of(chirp), keep=f"stim = '{chirp}'")
    add("spot_qi", PROC, ["snippets"], quality_of("sinespot"), keep="stim = 'sinespot'")
    add("chirp_rgc", PROC, ["snippets"], chirp_rgc(fs), keep=f"stim = '{chirp}'")
    add("chirp_bc", PROC, ["averages"], chirp_bc(fs), keep=f"stim = '{chirp}'")
    add("chirp_surround", ["rec", "roi", "pre"], ["snippets"], chirp_surround(local, chirp))
    add("spot_features", PROC, ["processed"], spot_features(6, 0, 1, 2, max(1, int(0.8 * fs))), keep="stim = 'sinespot'")
    add("os_ds", PROC, ["processed", "bar_order"], os_ds(2, 1000))
    add("os_ds_v1", PROC, ["processed", "bar_order"], os_ds(1, 100))
    add("csl", PROC, ["snippets"], csl, keep="stim = 'csl'")
    add("typed_trace", ["rec", "roi", "pre"], ["averages", "os_ds"], typed_traces(chirp, bar, dt))
    add("typed_trace_v2", ["rec", "roi", "pre"], ["averages", "os_ds"], typed_traces(chirp, bar, dt, True))
    add("features", ["features_id"], ["averages", "features_params"], feature_rows)
    add("clusters", ["features_id", "clustering_id"], ["features", "clustering_params"], clusters)
    add("classifier", ["training_id", "method_id"], ["training_basis", "classifier_method"], classifier(s.root), also=["training_cell"])
    add("cell_type", ["rec", "roi", "pre", "training_id", "method_id"], ["typed_trace", "roi", "classifier"], cell_type)
    add("cell_type_gated", ["rec", "roi", "pre", "training_id", "method_id", "gate_id"], ["cell_type", "celltype_params"], cell_type_gated)
    add("noise_trace", [*TRACE, "noise_id"], ["traces", "noise_params", "trigger", "noise_frame"], noise_trace)
    add("sta", [*TRACE, "noise_id", "sta_id"], ["noise_trace", "sta_params", "noise_frame"], sta(dt))
    add("sta_data_set", [*TRACE, "noise_id", "sta_id"], ["sta", "noise_trace", "sta_params", "noise_frame"], sta_data_set(dt))
    add("fast_sta", [*TRACE, "fast_id"], ["noise_trace", "fast_sta_params", "noise_frame"], fast_sta(dt))
    add("glm", [*TRACE, "noise_id", "glm_id"], ["noise_trace", "glm_params", "noise_frame"], glm)
    add("glm_quality_dict", [*TRACE, "noise_id", "glm_id"], ["glm"], glm_quality_dict)
    add("glm_single", [*TRACE, "noise_id"], ["glm"], glm_single)
    add("glm_quality", [*TRACE, "noise_id", "quality_id"], ["glm_single", "glm_quality_params"], glm_quality)
    add("split_rf", SPLIT, ["rf", "split_params"], split_rf)
    add("temporal_rf", SPLIT, ["split_rf"], over_split(lambda x: receptive.temporal(x, "id"), "time"))
    add("gauss", SPLIT, ["split_rf"], over_split(lambda x: receptive.spatial(x, "id"), "space"))
    add("dog", SPLIT, ["split_rf"], over_split(lambda x: receptive.spatial(x, "id", surround=True), "space"))
    add("contours", [*SPLIT, "contour_id"], ["split_rf", "contour_params"], contours)
    add("contour_metrics", [*SPLIT, "contour_id"], ["contours"], contour_metrics)
    add("rf_offset", SPLIT, ["gauss"], rf_offset(20, 15, 30.0, 30.0))
    add("rf_roi_offset", SPLIT, ["rf_offset", "roi_wrt_field"], rf_roi_offset({1: (1, 1), 2: (-1, 1), 3: (-1, 1)}))
    add("center_surround", [*RF, "cs_id"], ["rf", "cs_params"], center_surround)
    add("cascade_traces", [*TRACE, "ct_id"], ["traces", "cascade_traces_params"], cascade_traces)
    add("cascade_spikes", [*TRACE, "ct_id"], ["cascade_traces"], cascade_spikes())
    add("example", ["rec"], ["roi_mask"], example)
    return s

