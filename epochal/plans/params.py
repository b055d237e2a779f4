"""Parameter and manual tables: their columns, defaults, checks and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from epochal.functions.scalars import hash_params

#: Table: (key columns, columns in the order of a schema string, defaults).
TABLES: dict[str, tuple[list[str], str, dict]] = {
    "user": (["experimenter"], "experimenter string, data_dir string, raw_dir string, pre_dir string, data_name string, alt_name string, disk_alias string, high_alias string, outline_alias string, mask_alias string, places map<string,int>", {"raw_dir": "Raw", "pre_dir": "Pre", "data_name": "wDataCh0", "alt_name": "wDataCh1", "disk_alias": "ods", "high_alias": "hq_hr_highres_512_zstack", "outline_alias": "outline_edge", "mask_alias": "chirp_mb"}),
    "raw_params": (["raw_id"], "raw_id int, from_raw boolean, negative_labels boolean, trigger_precision string, include_artifacts boolean", {"from_raw": False, "negative_labels": False, "trigger_precision": "line", "include_artifacts": False}),
    "preprocess": (["pre"], "pre int, half int, poly_order int, subtract_baseline boolean, non_negative boolean, standardize int", {"half": 0, "poly_order": 3, "subtract_baseline": False, "non_negative": False, "standardize": 0}),
    "motion_params": (["motion_id"], "motion_id int, method string, options map<string,double>", {"method": "none", "options": {}}),
    "ipl_border": (["rec"], "rec int, left double, right double, thick double", {}),
    "ipl_bins": (["bin_id"], "bin_id int, borders array<double>", {}),
    "location_table": (["table_id"], "table_id string, path string, x_column string, y_column string", {"x_column": "ventral_dorsal_pos_um", "y_column": "temporal_nasal_pos_um"}),
    "training_data": (["training_id"], "training_id string, path string, chirp_path string, bar_path string", {}),
    "classifier_method": (["method_id"], "method_id string, trees int, seed int", {"trees": 1000, "seed": 2001}),
    "classifier_file": (["classifier_id"], "classifier_id int, path string, n_features int, n_classes int", {"n_classes": 75}),
    "celltype_params": (["gate_id"], "gate_id int, least double", {"least": 0.25}),
    "features_params": (["features_id"], "features_id int, kind string, ncomps array<int>, standardize boolean, roles array<string>", {"kind": "pca", "standardize": True}),
    "clustering_params": (["clustering_id"], "clustering_id int, kind string, k int, threshold double, min_count int, folds int", {"kind": "hierarchical_ward", "min_count": 0, "folds": 10}),
    "noise_params": (["noise_id"], "noise_id int, fit_kind string, cutoff double, up_trace int, up_stim int, reference string", {"fit_kind": "trace", "cutoff": 0.0, "up_trace": 1, "up_stim": 1, "reference": "trace"}),
    "sta_params": (["sta_id"], "sta_id int, past double, future double, method string, train double, dev double", {"past": 1.0, "future": 0.0, "method": "sta", "train": 0.8, "dev": 0.1}),
    "fast_sta_params": (["fast_id"], "fast_id int, past double, future double, up_stim int", {"past": 1.0, "future": 0.0, "up_stim": 1}),
    "glm_params": (["glm_id"], "glm_id int, lags int, dfs array<int>, betas array<double>, shuffles int", {"shuffles": 20}),
    "glm_quality_params": (["quality_id"], "quality_id int, min_cc double, max_p double, max_mse double", {"min_cc": 0.0, "max_p": 0.05, "max_mse": 1e9}),
    "split_params": (["split_id"], "split_id int, method string, blur double", {"method": "svd", "blur": 0.0}),
    "contour_params": (["contour_id"], "contour_id int, levels array<double>, blur double, inner double, outer double", {"blur": 0.0, "inner": 0.0, "outer": 2.0}),
    "cs_params": (["cs_id"], "cs_id int, peak_nstd double, latest double", {"peak_nstd": 1.0, "latest": 1e9}),
    "cascade_traces_params": (["ct_id"], "ct_id int, half int, poly_order int, q_low double, q_high double, cutoff double", {"half": 0, "poly_order": 3, "q_low": 2.5, "q_high": 80.0, "cutoff": 0.0}),
    "cascade_params": (["cascade_id"], "cascade_id int, model string, folder string", {}),
}


def checked(name: str, row: dict) -> dict:
    """A row with its defaults; unknown columns, missing keys and values that make no sense are errors."""
    key, schema, defaults = TABLES[name]
    columns = columns_of(schema)
    if extra := set(row) - set(columns):
        raise ValueError(f"{name}: unknown columns {sorted(extra)}")
    out = {c: row.get(c, defaults.get(c)) for c in columns}
    if missing := [k for k in key if out[k] is None]:
        raise ValueError(f"{name}: no {missing}")
    if name == "user":
        out |= {c: out[c].lower() for c in columns if c.endswith("_alias")}
    if name == "ipl_bins" and list(out["borders"]) != sorted(set(out["borders"])):
        raise ValueError("borders must rise")
    if name == "ipl_border" and not out["thick"]:
        raise ValueError("a layer has a thickness")
    for c in ("train", "dev"):
        if c in out and not 0 <= out[c] <= 1:
            raise ValueError(f"{c} is a share")
    return out


def columns_of(schema: str) -> list[str]:
    """Names in a schema string (commas within types apart)."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(schema + ","):
        depth += {"<": 1, ">": -1}.get(c, 0)
        if c == "," and depth == 0:
            out.append(schema[at:i].split()[0])
            at = i + 1
    return out


def rows(spark: SparkSession, name: str, *items: dict, hashed: bool = False) -> DataFrame:
    """Checked rows of a table; with ``hashed`` the key is the hash of all other values."""
    key, schema, _ = TABLES[name]
    out = []
    for item in items:
        if hashed:
            item = item | {key[0]: hash_params({k: v for k, v in item.items() if k not in key})}
        r = checked(name, item)
        out.append(tuple(r[c] for c in columns_of(schema)))
    return spark.createDataFrame(out, schema)


def fan_out(spark: SparkSession, name: str, over: str, values: list, *items: dict) -> list[dict]:
    """Each row for each value of a further column, as dicts."""
    return [{**checked(name, i), over: v} for i in items for v in values]


def same_or_new(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not there; a row that is there with other values is an error."""
    rest = [c for c in old.columns if c not in key]
    both = old.join(new, key, "left_semi").select(*key, *rest)
    if not both.exceptAll(new.join(old, key, "left_semi").select(*key, *rest)).isEmpty():
        raise ValueError("a key is there with other values")
    return new.join(old, key, "left_anti")
