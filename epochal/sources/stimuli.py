"""Stimulus rows: presets, validation of trials and aliases, and the table made of them."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "stim_name string, alias string, stim_family string, framerate double, isrepeated boolean, ntrigger_rep int, "
    "trial_info array<struct<name: string, ntrigger: int, ntrigger_split: int>>, stim_dict map<string, double>"
)

# Aliases of the presets, and the order of directions of the moving bar.
ALIASES = {"nostim": "nostim_none", "chirp": "chirp_gchirp_globalchirp_lchirp_localchirp", "movingbar": "mb_mbar_bar_movingbar"}
DIRECTIONS = [0, 180, 45, 225, 90, 270, 135, 315]


def trials(items, ntrigger_rep: int) -> list[dict]:
    """Trials as mappings (a plain value is a name with one trigger). Their triggers must sum to
    ``ntrigger_rep``; for one trigger a repeat a mismatch only warns."""
    if not isinstance(items, list | tuple):
        raise TypeError("trials must be a list")
    out = [dict(i) if isinstance(i, dict) else {"name": str(i), "ntrigger": 1} for i in items]
    for i in out:
        if extra := set(i) - {"name", "ntrigger", "ntrigger_split"}:
            raise ValueError(f"unknown trial fields: {sorted(extra)}")
        for k in ("ntrigger", "ntrigger_split"):
            if k in i and int(i[k]) != i[k]:
                raise ValueError(f"{k} must be whole, not {i[k]}")
    total = sum(i["ntrigger"] for i in out)
    if total != ntrigger_rep:
        message = f"trials have {total} triggers, a repeat has {ntrigger_rep}"
        if ntrigger_rep > 1:
            raise ValueError(message)
        warnings.warn(message, stacklevel=2)
    return out


def stimulus(name: str, alias: str | None = None, family: str = "", framerate: float = 0.0, repeated: bool = False, ntrigger_rep: int = 0, trial_info=None, **numbers) -> dict:
    """One row; keyword numbers that are given become ``stim_dict``."""
    info = None if trial_info is None else [{"name": i["name"], "ntrigger": int(i["ntrigger"]), "ntrigger_split": i.get("ntrigger_split")} for i in trials(trial_info, ntrigger_rep)]
    values = {k: float(v) for k, v in numbers.items() if v is not None}
    return {"stim_name": name, "alias": alias or name, "stim_family": family, "framerate": float(framerate), "isrepeated": repeated, "ntrigger_rep": ntrigger_rep, "trial_info": info, "stim_dict": values}


def no_stimulus() -> dict:
    return stimulus("nostim", ALIASES["nostim"])


def noise(scale_um: float | None = None, offset_x_um: float | None = None, offset_y_um: float | None = None, **kw) -> dict:
    """Dense noise; an offset that is not given is taken as 0, with a warning."""
    if offset_x_um is None or offset_y_um is None:
        warnings.warn("stimulus offset not given, taken as 0", stacklevel=2)
    base = {"name": "noise", "alias": f"dn_noise_dn{scale_um}m_noise{scale_um}m", "family": "noise", "framerate": 5.0, "ntrigger_rep": 1500, "ntrigger_per_frame": 1}
    return stimulus(**{**base, "pix_scale_x_um": scale_um, "pix_scale_y_um": scale_um, "offset_x_um": offset_x_um or 0, "offset_y_um": offset_y_um or 0, **kw})


def chirp(**kw) -> dict:
    return stimulus(**{"name": "chirp", "alias": ALIASES["chirp"], "family": "chirp", "framerate": 1 / 60, "repeated": True, "ntrigger_rep": 2, **kw})


def moving_bar(**kw) -> dict:
    base = {"name": "movingbar", "alias": ALIASES["movingbar"], "family": "movingbar", "framerate": 1 / 60, "repeated": True, "ntrigger_rep": 1, "trial_info": DIRECTIONS}
    if "trial_info" not in kw and kw.get("ntrigger_rep", 1) == 1:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")  # eight trials of one trigger each are the preset
            return stimulus(**{**base, **kw})
    return stimulus(**{**base, **kw})


def table(spark: SparkSession, rows: list[dict], unique_alias: bool = True) -> DataFrame:
    """The rows as a table; names are unique, and with ``unique_alias`` so is every alias token."""
    names = [r["stim_name"] for r in rows]
    if len(set(names)) != len(names):
        raise ValueError("stimulus names must be unique")
    if unique_alias:
        owner: dict[str, str] = {}
        for r in rows:
            for token in r["alias"].split("_"):
                if owner.setdefault(token, r["stim_name"]) != r["stim_name"]:
                    raise ValueError(f"alias {token!r} is used by {owner[token]} and {r['stim_name']}")
    columns = ["stim_name", "alias", "stim_family", "framerate", "isrepeated", "ntrigger_rep", "trial_info", "stim_dict"]
    return spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], SCHEMA)


def conflicts(stimuli: DataFrame) -> DataFrame:
    """Alias tokens that belong to more than one stimulus."""
    each = stimuli.select("stim_name", F.explode(F.split("alias", "_")).alias("token")).distinct()
    return each.groupBy("token").agg(F.sort_array(F.collect_list("stim_name")).alias("stimuli")).where(F.size("stimuli") > 1)
