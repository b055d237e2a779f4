"""Where things are: depth in the layer, fields and regions relative to the optic disk, outlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochal.functions.scalars import retinal_position


def layer_depth(centres: DataFrame, borders: DataFrame, key: str, width: str) -> DataFrame:
    """(key, label, depth): height of a centre (cx, cy) over the line from (0, left) to (width - 1, right), in layer thicknesses."""
    slope = (F.col("right") - F.col("left")) / (F.col(width) - 1)
    d = centres.join(borders, key)
    return d.withColumn("depth", (F.col("cy") - (slope * F.col("cx") + F.col("left"))) / F.col("thick"))


def border_line(points: DataFrame, key: str) -> DataFrame:
    """(key, slope, intercept): least-squares line through points (x, y); level through a single abscissa."""
    g = points.groupBy(key).agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.avg("y").alias("_m"))
    return g.select(key, F.coalesce("slope", F.lit(0.0)).alias("slope"), F.coalesce("intercept", "_m").alias("intercept"))


def depth_bins(depths: DataFrame, params: DataFrame, depth: str = "depth") -> DataFrame:
    """Each depth with each set of borders (params: bin_id, borders): the half-open bin it lies in, -1 below all.
    Sets are few and each is one row, so they are met by their own key, not paired."""
    sets = [(r["bin_id"], sorted(r["borders"])) for r in params.orderBy("bin_id").collect()]  # a short manual table
    each = F.array(*[F.struct(F.lit(i).alias("bin_id"), (F.size(F.filter(F.array(*[F.lit(float(x)) for x in b]), lambda x: x <= F.col(depth))) - 1).alias("bin")) for i, b in sets])
    return depths.withColumn("_b", F.explode(each)).select("*", "_b.bin_id", "_b.bin").drop("_b")


def disk_choice(files: DataFrame, headers: DataFrame, key: list[str], kind: str = "h5") -> DataFrame:
    """(key, odx, ody, odz, from): the disk's position from its file (the preferred kind first), else from the header."""
    rank = F.when(F.col("kind") == kind, 0).otherwise(1)
    best = files.withColumn("_r", rank).groupBy(*key).agg(F.min_by(F.struct("odx", "ody", "odz"), F.struct("_r", "filepath")).alias("_f"))
    both = headers.select(*key, F.struct("odx", "ody", "odz").alias("_h")).join(best, key, "full_outer")
    got = F.coalesce("_f", F.when(F.col("_h.odx").isNotNull(), F.col("_h")))
    return both.withColumn("_p", got).where("_p is not null").select(*key, "_p.*", F.when(F.col("_f").isNotNull(), "file").otherwise("header").alias("source"))


def repaired_positions(fields: DataFrame, presentations: DataFrame, key: list[str], far: float = 200.0, wild: float = 20_000.0) -> DataFrame:
    """Fields with their position, or, where the median of their presentations lies over ``far`` away in x or y, that median over
    presentations that are not ``wild`` (over all, if all are)."""
    ok = (F.abs("absx") <= wild) & (F.abs("absy") <= wild)
    axes = ("absx", "absy", "absz")
    g = presentations.groupBy(*key).agg(
        *[F.median(a).alias(f"_m{a}") for a in axes], *[F.median(F.when(ok, F.col(a))).alias(f"_o{a}") for a in axes], F.max(ok).alias("_ok")
    )
    d = fields.join(g, key, "left")
    off = F.coalesce((F.abs(F.col("_mabsx") - F.col("absx")) > far) | (F.abs(F.col("_mabsy") - F.col("absy")) > far), F.lit(False))
    moved = {a: F.when(off, F.when(F.col("_ok"), F.col(f"_o{a}")).otherwise(F.col(f"_m{a}"))).otherwise(F.col(a)) for a in axes}
    return d.select(*[c for c in fields.columns if c not in axes], *[v.alias(a) for a, v in moved.items()])


def relative_to_disk(fields: DataFrame, disks: DataFrame, key: list[str]) -> DataFrame:
    """relx, rely, relz: a field's position less that of its experiment's disk."""
    d = fields.join(disks, key)
    return d.withColumns({f"rel{a}": F.col(f"abs{a}") - F.col(f"od{a}") for a in "xyz"})


def on_retina(rows: DataFrame, x: str = "relx", y: str = "rely") -> DataFrame:
    """Retinal axes of relative positions; rows of unknown orientation (-1) are left out."""
    vd, tn = retinal_position(F.col(x), F.col(y), F.col("prepwmorient"), F.col("eye"))
    return rows.where("prepwmorient <> -1").withColumns({"ventral_dorsal_pos_um": vd, "temporal_nasal_pos_um": tn})


def categories(vd: Column, tn: Column, dead: float = 0.0) -> dict[str, Column]:
    """Sides: nasal, temporal or centre, ventral, dorsal or centre, both, and with only the temporal or nasal half divided."""
    side = lambda v, low, high: F.when(v < -dead, low).when(v > dead, high).otherwise("c")
    nt, v = side(tn, "t", "n"), side(vd, "v", "d")
    both = F.concat(nt, v)
    return {"nt_side": nt, "vd_side": v, "ntvd_side": both, "n_tvd_side": F.when(nt == "t", both).otherwise(nt), "nvd_t_side": F.when(nt == "n", both).otherwise(nt)}


def looked_up(rows: DataFrame, table: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Rows with columns of the entry of their key; no entry: left out; more than one: an error."""
    one = table.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in columns])
    first, *rest = columns
    ok = F.when(F.col("_n") == 1, F.col(first)).otherwise(F.raise_error(F.lit("more than one entry of a key")))
    return rows.join(one.select(*key, ok.alias(first), *rest), key)


def region_offset(centres: DataFrame, scan: str = "xy") -> DataFrame:
    """Offsets of a region's centre (cx, cy; width, height, pixel_um, z_step_um, angle_deg) from that of its field, in micrometres,
    turned by the scan angle; in planes of x and y the axes change places and signs."""
    a = F.radians("angle_deg")
    step = F.col("pixel_um") if scan == "xy" else F.col("z_step_um")
    u, v = (F.col("cx") + 0.5 - F.col("width") / 2) * F.col("pixel_um"), (F.col("cy") + 0.5 - F.col("height") / 2) * step
    p, q = u * F.cos(a) + v * F.sin(a), -u * F.sin(a) + v * F.cos(a)
    zero = F.lit(0.0)
    x, y, z = (-q, -p, zero) if scan == "xy" else (zero, -p, q)
    return centres.withColumns({"relx_wrt_field": x, "rely_wrt_field": y, "relz_wrt_field": z})


def region_position(regions: DataFrame, fields: DataFrame, key: list[str]) -> DataFrame:
    """Position of a region relative to the disk: its offset and its field's."""
    d = regions.join(fields.select(*key, "relx", "rely", "relz"), key)
    return d.withColumns({"relx": F.col("relx") + F.col("relx_wrt_field"), "rely": F.col("rely") + F.col("rely_wrt_field")})


def outline(points: DataFrame, key: str) -> DataFrame:
    """(key, outline): points of numbered files in order of their number."""
    return points.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("num", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("outline"))  # a few points a key


def relative_outline(outlines: DataFrame, disks: DataFrame, key: str) -> DataFrame:
    """Outline points less the disk's position, and on the retina's axes."""
    d = outlines.join(disks, key)
    rel = F.transform("outline", lambda p: F.struct((p["x"] - F.col("odx")).alias("x"), (p["y"] - F.col("ody")).alias("y")))
    d = d.withColumn("relative", rel)
    turn = lambda p: F.struct(*[c.alias(n) for c, n in zip(retinal_position(p["x"], p["y"], F.col("prepwmorient"), F.col("eye")), ("vd", "tn"), strict=True)])
    return d.withColumn("retinal", F.transform("relative", turn))


def filter_offset(fits: DataFrame, pixel: str = "pixel_um") -> DataFrame:
    """Offset of a fitted centre (x, y in pixels; width, height) from the stimulus centre, in micrometres, and its distance."""
    dx, dy = (F.col("x") - (F.col("width") - 1) / 2) * F.col(pixel), (F.col("y") - (F.col("height") - 1) / 2) * F.col(pixel)
    return fits.withColumns({"dx_um": dx, "dy_um": dy, "d_um": F.hypot(dx, dy)})
