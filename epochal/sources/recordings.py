"""Recordings: names and headers to rows, scan parameters to typed columns, clocks and triggers of a scan.

Files are rows (folder, filename); parameters are a map column of names to numbers; pixels are rows
(key, p, v) in the order they were scanned, p from 0.  Reading a container is left to ``tables.recordings``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochal.operators import algebra
from epochal.sources import paths

#: Names of conditions that count as controls.
CONTROLS = ("control", "none", "c1", "contr", "cntr")
#: Bounds and level of the trigger channel, and samples a second of old trigger files.
LOW, HIGH, LEVEL, OLD_RATE = 25_000, 35_000, 30_000, 500.0


def _one_of(value: Column, aliases: list[str], numbered: bool = False) -> Column:
    return paths.alias_match(value, aliases, numbered)


def file_rows(files: DataFrame, places: dict[str, int], disk: str, high: str, outline: str, masks: str, raw: bool = False) -> DataFrame:
    """(folder, filename, each name of ``places``, kind, filepath, mask_order) of the files whose names can be read.

    ``places`` counts tokens of the name (one less in raw names); aliases are lists joined by ``_``.  Kind: disk, high resolution or
    outline by region, field or stimulus, else a response, which must have a stimulus.  mask_order: place of the stimulus among
    ``masks`` (behind them if it is not there; one further for the other kinds), and 0.1 for each condition that is no control."""
    d = files.withColumns({n: paths.token(F.col("filename"), at - int(raw)) for n, at in places.items()})
    lists = [x.lower().split("_") for x in (disk, high, outline, masks)]
    spots = [F.col(n) for n in ("region", "field", "stimulus") if n in places]
    any_of = lambda aliases, numbered=False: reduce(lambda a, b: a | b, [_one_of(c, aliases, numbered) for c in spots], F.lit(False))
    stimulus = F.col("stimulus") if "stimulus" in places else F.lit(None).cast("string")
    kind = F.when(any_of(lists[0]), "od").when(any_of(lists[1]), "hr").when(any_of(lists[2], True), "outline").when(stimulus.isNotNull(), "response")
    names = F.array(*[F.lit(m) for m in lists[3]])
    at = F.array_position(names, F.lower(stimulus))
    order = F.when(F.col("kind") != "response", F.lit(len(lists[3]) + 1)).when(at > 0, at - 1).otherwise(F.lit(len(lists[3]))).cast("double")
    for i in range(1, 4):
        if f"cond{i}" in places:
            order = order + F.when(F.lower(F.coalesce(F.col(f"cond{i}"), F.lit("none"))).isin(*CONTROLS), 0.0).otherwise(0.1)
    d = d.withColumn("kind", kind).where("kind is not null")
    return d.withColumns({"filepath": F.concat_ws("/", "folder", "filename"), "mask_order": order})


def preferred(files: DataFrame, key: list[str]) -> DataFrame:
    """The file of least mask_order of each key."""
    return algebra.best(files, key, "mask_order", "filename")


def mask_order(files: DataFrame, key: list[str], stimulus: str, condition: str, masks: str, high: str) -> DataFrame:
    """Files ranked for their masks within a key: by the place of the stimulus among ``masks``, high resolution last, a condition
    that is no control a hundred later, ties by name (a hundredth each)."""
    names = masks.lower().split("_")
    at = F.array_position(F.array(*[F.lit(m) for m in names]), F.lower(stimulus))
    base = F.when(_one_of(F.col(stimulus), high.lower().split("_")), F.lit(len(names) + 1)).when(at > 0, at - 1).otherwise(F.lit(len(names))).cast("double")
    by = Window.partitionBy(*key)
    alphabet = F.row_number().over(by.orderBy("filename")) - 1
    penalty = base + alphabet * 0.01 + F.when(F.lower(F.coalesce(F.col(condition), F.lit("none"))).isin(*CONTROLS), 0.0).otherwise(100.0)
    return files.withColumn("penalty", F.round(penalty, 2)).withColumn("rank", F.row_number().over(by.orderBy("penalty", "filename")))


def field_files(files: DataFrame, field: str, place: int | None = None, kind: str = "h5", hidden: bool = False) -> DataFrame:
    """Files of a suffix whose name has the field, in order of name."""
    ok = F.lower("filename").endswith("." + kind) & paths.match_file(F.col("filename"), field, place)
    ok = ok if hidden else ok & ~F.col("filename").startswith(".")
    return files.where(ok).orderBy("folder", "filename")


def folders_with(files: DataFrame, suffix: str) -> DataFrame:
    """Folders that hold a file of the suffix."""
    return files.where(F.col("filename").endswith(suffix) & ~F.col("filename").startswith(".")).select("folder").distinct()


def presentations(fields: DataFrame, files: DataFrame, stimuli: DataFrame, key: list[str]) -> DataFrame:
    """Files of each field that show a stimulus, by the aliases of ``stimuli`` (stim_name, alias); two files of one key are an error."""
    tokens = stimuli.select("stim_name", F.explode(F.array_distinct(F.split(F.lower("alias"), "_"))).alias("_alias"))
    d = fields.join(files, key).withColumn("_alias", F.lower("stimulus")).join(tokens, "_alias").drop("_alias")
    n = F.count(F.lit(1)).over(Window.partitionBy(*key, "stim_name"))
    return d.withColumn("filepath", F.when(n == 1, F.col("filepath")).otherwise(F.raise_error(F.lit("more than one file of a stimulus"))))


def experiments(headers: DataFrame) -> DataFrame:
    """(folder, date, exp_num) of header folders ``.../yyyymmdd/n``; folders of other names are left out."""
    day = F.to_date(F.try_to_timestamp(F.regexp_extract("folder", r"([^/]+)/[^/]+/?$", 1), F.lit("yyyyMMdd")))
    number = F.regexp_extract("folder", r"([0-9]+)/?$", 1)
    return headers.select("folder").distinct().withColumns({"date": day, "exp_num": F.expr("try_cast(nullif(regexp_extract(folder, '/([0-9]+)/?$', 1), '') as int)")}).where(day.isNotNull() & (number != ""))


def same_headers(headers: DataFrame, key: list[str], column: str) -> DataFrame:
    """The header of each key; an error where several differ."""
    g = headers.groupBy(*key).agg(F.min(column).alias(column), F.max(column).alias("_m"))
    return g.select(*key, F.when(F.col(column) == F.col("_m"), F.col(column)).otherwise(F.raise_error(F.lit("headers differ"))).alias(column))


def preparation(header: Column) -> dict[str, Column]:
    """Columns of a header map: preparation, eye, orientation (-1 unknown, '' 0), side of the disk, drug flag, with their defaults."""
    text = lambda k, other: F.coalesce(F.nullif(F.element_at(header, k), F.lit("")), F.lit(other))
    turn = F.element_at(header, "prepwmorient")
    angle = F.when(turn == "", F.lit(0.0)).when((F.lower(turn) == "unknown") | (turn == "111"), F.lit(-1.0)).otherwise(F.expr("null").cast("double"))
    drug = F.lower(F.coalesce(F.element_at(header, "pharmdrug"), F.lit("")))
    return {
        "prep": text("prep", "wholemount"),
        "eye": text("eye", "unknown"),
        "prepwmorient": F.coalesce(angle, F.when(turn.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), turn).cast("double"), F.lit(-1.0)),
        "pharm": F.when(drug.isin("", "none"), 0).otherwise(1),
    }


def disk_position(text: Column) -> Column:
    """(x, y, z) of a header's position ``x;y;z`` or ``x,y,z``; null where it is no such list."""
    parts = F.transform(F.split(text, "[;,]"), lambda x: F.when(F.trim(x).rlike(r"^-?[0-9]+(\.[0-9]+)?$"), F.trim(x)).cast("double"))
    ok = (F.size(parts) == 3) & ~F.exists(parts, lambda x: x.isNull())
    return F.when(ok, F.struct(parts[0].alias("odx"), parts[1].alias("ody"), parts[2].alias("odz")))


def merged_parameters(texts: Column, numbers: Column) -> Column:
    """One map of text and number parameters, keys in lower case, empty keys dropped; numbers win."""
    plain = lambda m: F.transform_keys(F.map_filter(m, lambda k, v: k != ""), lambda k, v: F.lower(k))
    a, b = plain(texts), F.transform_values(plain(numbers), lambda k, v: v.cast("string"))
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.array_contains(F.map_keys(b), k)), b)


def labelled(keys: Column, values: Column) -> Column:
    """Map of an attribute-labelled vector; empty labels dropped."""
    return F.map_filter(F.map_from_arrays(keys, values), lambda k, v: k != "")


def scan_columns(p: Column) -> dict[str, Column]:
    """Typed columns of a map of numeric scan parameters."""
    get = lambda k, other=0.0: F.coalesce(F.element_at(p, k), F.lit(other))
    nx, ny, nz = (get(k).cast("int") for k in ("user_dxpix", "user_dypix", "user_dzpix"))
    retrace, offset = get("user_npixretrace").cast("int"), get("user_nxpixlineoffs").cast("int")
    kind = F.when((nx > 1) & (ny > 1) & (nz > 1), "xyz").when((nx > 1) & (ny > 1), "xy").when((nx > 1) & (nz > 1), "xz")
    pixel = get("realpixdur") * 1e-6
    lines = F.when(kind == "xz", nz).otherwise(ny)
    return {
        "scan_type": kind, "pix_nx_full": nx, "pix_nx": F.greatest(F.lit(0), nx - retrace - offset), "pix_ny": ny, "pix_nz": nz,
        "pix_n_retrace": retrace, "pix_n_line_offset": offset, "pixel_duration": pixel, "line_duration": nx * pixel, "scan_period": nx * pixel * lines,
        "scan_frequency": F.when(nx * lines > 0, 1 / (nx * pixel * lines)), "zoom": get("zoom", 1.0), "angle_deg": get("angle_deg"),
        "absx": get("xcoord_um"), "absy": get("ycoord_um"), "absz": get("zcoord_um"), "z_step_um": get("zstep_um"),
    }


def check_size(scans: DataFrame, width: str, height: str) -> DataFrame:
    """Scans whose stack is ``width`` by ``height`` as its parameters say; others are an error."""
    ok = (F.col(width) == F.col("pix_nx")) & (F.col(height) == F.when(F.col("scan_type") == "xz", F.col("pix_nz")).otherwise(F.col("pix_ny")))
    return scans.withColumn(width, F.when(ok, F.col(width)).otherwise(F.raise_error(F.lit("stack and parameters differ in size")).cast("int")))


def frame_times(scans: DataFrame, n_frames: str) -> DataFrame:
    """One row a frame of each scan (with its columns): frame from 0 and ``frame_time``."""
    return scans.select("*", F.explode(F.sequence(F.lit(0), F.col(n_frames) - 1)).alias("frame")).withColumn("frame_time", F.col("frame") * F.col("scan_period"))


def pixel_delay(x: Column, line: Column, precision: str = "line") -> Column:
    """Seconds into its frame at which a pixel is scanned; ``x`` counts from the first pixel kept.  By line, all pixels have their line's."""
    at = line * F.col("pix_nx_full")
    return (at if precision == "line" else at + x + F.col("pix_n_line_offset")) * F.col("pixel_duration")


def auto_threshold(pixels: DataFrame, key: str) -> DataFrame:
    """(key, threshold): the usual level where the channel reaches well beyond it on both sides, else the middle of its range."""
    g = pixels.groupBy(key).agg(F.min("v").alias("_l"), F.max("v").alias("_h"))
    return g.select(key, F.when((F.col("_l") < LOW) & (F.col("_h") > HIGH), F.lit(float(LEVEL))).otherwise((F.col("_l") + F.col("_h")) / 2).alias("threshold"))


def triggers(pixels: DataFrame, key: str, gap: int, threshold: Column | float) -> DataFrame:
    """(key, p, v): pixels at which the channel reaches the threshold from below, no closer than ``gap`` to the crossing before.

    A channel that is high from the start hides its first onset; it is put as long before the end of that pulse as the others
    take in the median, from their onset's successor to their first low pixel (0 for one that never ends)."""
    w = Window.partitionBy(key).orderBy("p")
    high = F.col("v") >= threshold
    d = pixels.withColumns({"_h": high, "_up": high & ~F.coalesce(F.lag(high).over(w), high)})
    low_after = F.min(F.when(~F.col("_h"), F.col("p"))).over(w.rowsBetween(1, Window.unboundedFollowing))
    d = d.withColumns({"_low": low_after, "_first": F.min(F.when(~F.col("_h"), F.col("p"))).over(Window.partitionBy(key)), "_start": F.min_by("_h", "p").over(Window.partitionBy(key))})
    on = d.where("_up").withColumn("_g", F.col("p") - F.lag("p").over(w)).where(F.col("_g").isNull() | (F.col("_g") >= gap))
    hidden = on.groupBy(key).agg(F.first("_start").alias("_start"), F.first("_first").alias("_first"), F.floor(F.percentile(F.coalesce(F.col("_low") - F.col("p") - 1, F.lit(0)), F.lit(0.5))).alias("_n")).where("_start")
    hidden = hidden.select(key, (F.col("_first") - F.col("_n")).cast("long").alias("p"))
    hidden = hidden.join(pixels.select(key, F.col("p").cast("long").alias("p"), "v"), [key, "p"], "left")
    return on.select(key, F.col("p").cast("long").alias("p"), "v").unionByName(hidden)


def stack_pixels(stack: DataFrame, scans: DataFrame, key: str) -> DataFrame:
    """(key, p, v, t) of a channel's pixels (key, frame, y, x, v) in the order they were scanned, with the time of each (by line)."""
    s = scans.select(key, "pix_nx", "pix_nx_full", "pix_n_line_offset", "pixel_duration", "scan_period", F.when(F.col("scan_type") == "xz", F.col("pix_nz")).otherwise(F.col("pix_ny")).alias("_lines"))
    d = stack.join(s, key)
    p = (F.col("frame").cast("long") * F.col("_lines") + F.col("y")) * F.col("pix_nx") + F.col("x")
    return d.select(key, p.alias("p"), "v", (F.col("frame") * F.col("scan_period") + pixel_delay(F.col("x"), F.col("y"))).alias("t"))


def trigger_times(stack: DataFrame, scans: DataFrame, key: str, delay: float = 0.0, threshold: float | None = None) -> DataFrame:
    """(key, time, v) of the triggers in a scan's trigger channel: crossings two lines apart at least, at the threshold of the channel
    (or the one given), plus the stimulator's delay."""
    pixels = stack_pixels(stack, scans, key)
    lines = scans.select(key, (F.col("pix_nx") * 2).alias("_gap"))
    if threshold is None:
        level = auto_threshold(pixels, key)
        raised = pixels.join(level, key).withColumn("v", F.col("v") - F.col("threshold")).drop("threshold")
    else:
        raised = pixels.withColumn("v", F.col("v") - F.lit(threshold))
    gaps = sorted(r[0] for r in lines.select("_gap").distinct().collect())  # one a scan width
    out = None
    for g in gaps:
        rows = triggers(raised.join(lines.where(F.col("_gap") == g), key, "left_semi"), key, g, F.lit(0.0))
        out = rows if out is None else out.unionByName(rows)
    return out.select(key, "p").join(pixels, [key, "p"]).select(key, (F.col("t") + F.lit(delay)).alias("time"), "v")


def repair_times(triggers: DataFrame, key: str, time: str, trace_end: DataFrame | None = None) -> DataFrame:
    """Trigger times that are counts of an old file, in seconds: those whose last is over twice the trace's end (``trace_end``: key, end),
    or, without a trace, those that begin over 250 and end over 1,000."""
    by = Window.partitionBy(key)
    first, last = F.min(time).over(by), F.max(time).over(by)
    d = triggers.withColumns({"_f": first, "_l": last})
    old = (F.col("_f") > 250) & (F.col("_l") > 1000)
    if trace_end is not None:
        d = d.join(trace_end.select(key, F.col("end").alias("_e")), key, "left")
        old = F.when(F.col("_e").isNull(), old).otherwise(F.col("_l") > 2 * F.col("_e"))
    return d.withColumn(time, F.when(old, F.col(time) / OLD_RATE).otherwise(F.col(time))).select(*triggers.columns)


def trigger_check(triggers: DataFrame, key: str, per_repeat: int, repeated: bool) -> DataFrame:
    """(key, n, trigger_valid): whole repeats of a repeated stimulus, or just the triggers of one."""
    n = F.col("n")
    return triggers.groupBy(key).agg(F.count(F.lit(1)).alias("n")).withColumn("trigger_valid", (n % per_repeat == 0) if repeated else (n == per_repeat))


def mask_values(mask: DataFrame, key: str, label: str = "label") -> DataFrame:
    """(key, positive, negative): is a label image of the format with background 0, or with background 0 or 1 and negative labels?"""
    g = mask.groupBy(key).agg(F.min(label).alias("_l"), F.max(label).alias("_h"))
    return g.select(key, (F.col("_l") == 0).alias("positive"), ((F.col("_l") < 0) & F.col("_h").isin(0, 1)).alias("negative"))


def mask_labels(mask: DataFrame, key: str, artifact: int = 0, label: str = "label") -> DataFrame:
    """(key, roi): negative labels right of the artifact columns, as positive numbers in order."""
    return mask.where((F.col("x") >= artifact) & (F.col(label) < 0)).select(key, (-F.col(label)).alias("roi")).distinct()


def whole_labels(mask: DataFrame, label: str = "label") -> DataFrame:
    """Labels as whole numbers; one that is not whole is an error."""
    whole = F.col(label).cast("int")
    return mask.withColumn(label, F.when(whole == F.col(label), whole).otherwise(F.raise_error(F.lit("a label is not whole")).cast("int")))


def log_index(logs: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """New logs (key, path) numbered on behind the ones ``known`` (key, path, idx) of their key."""
    new = logs.join(known, [key, "path"], "left_anti")
    top = known.groupBy(key).agg(F.max("idx").alias("_m"))
    nth = F.row_number().over(Window.partitionBy(key).orderBy("path"))
    return new.join(top, key, "left").withColumn("idx", F.coalesce("_m", F.lit(0)) + nth).drop("_m")
