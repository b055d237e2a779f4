"""Scalar functions as column expressions."""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scan width in micrometres at zoom 1, and artefact lines, by setup.
XSCALE = {1: 112.0, 2: 71.5, 3: 71.5}
ARTIFACT_LINES = {1: 1, 2: 4, 3: 3}
DATE_FORMATS = ("yyyyMMdd", "yyyy-MM-dd", "yyyy_MM_dd", "dd.MM.yyyy", "yyyy.MM.dd", "dd-MM-yyyy")
SHORT_NAMES = {"frequency": "freq.", "sustained": "sus.", "transient": "trans.", "suppressed": "suppr."}


def lookup(c: Column, table: dict) -> Column:
    out = F.lit(None)
    for k, v in table.items():
        out = F.when(c == F.lit(k), F.lit(v)).otherwise(out)
    return out


def pixel_size(setup: Column, npix: Column, zoom: Column) -> Column:
    """Micrometres a pixel; null outside the valid ranges."""
    ok = (zoom >= 0.15) & (zoom <= 4) & (npix >= 1) & (npix < 5000)
    return F.when(ok, lookup(setup, XSCALE) / npix / zoom)


def artifact_lines(setup: Column) -> Column:
    return lookup(setup, ARTIFACT_LINES)


def retinal_position(x: Column, y: Column, rotation: Column, eye: Column) -> tuple[Column, Column]:
    """(ventral-dorsal, temporal-nasal) in the units of x and y; the latter null for an unknown eye."""
    r = F.radians(rotation)
    along, across = x * F.cos(r) + y * F.sin(r), y * F.cos(r) - x * F.sin(r)
    return -along, F.when(eye == "right", across).when(eye == "left", -across)


def quadrant(vd: Column, tn: Column) -> Column:
    return F.concat(F.when(vd >= 0, "d").otherwise("v"), F.when(tn >= 0, "n").otherwise("t"))


def digitize(x: Column, borders: list[float]) -> Column:
    """Index of the bin that x falls in: borders at or below it, less one (-1 below all)."""
    return F.size(F.filter(F.array(*[F.lit(float(b)) for b in borders]), lambda b: b <= x)) - 1


def flexible_date(c: Column) -> Column:
    """First of the known formats that parses to a year from 2000 to 2050, else null."""
    each = [F.to_date(F.try_to_timestamp(c, F.lit(f))) for f in DATE_FORMATS]
    return F.coalesce(*[F.when(F.year(d).between(2000, 2050), d) for d in each])


def short_name(c: Column) -> Column:
    for long, short in SHORT_NAMES.items():
        c = F.replace(c, F.lit(long), F.lit(short))
    return c


def hash_columns(*names: str) -> Column:
    """MD5 of the named columns as JSON, in order of name."""
    return F.md5(F.to_json(F.struct(*sorted(names))).cast("binary"))


def hash_params(value) -> str:
    """MD5 of a nested parameter value; the order of mappings and sets does not matter."""

    def plain(v):
        if isinstance(v, dict):
            return {str(k): plain(x) for k, x in v.items()}
        if isinstance(v, set | frozenset):
            return [plain(x) for x in sorted(v)]
        if isinstance(v, list | tuple):
            return [plain(x) for x in v]
        return v if v is None or isinstance(v, bool | int | float | str) else str(v)

    return hashlib.md5(json.dumps(plain(value), sort_keys=True).encode()).hexdigest()


def naka_rushton(s: Column, base: float, amplitude: float, half: float, n: float) -> Column:
    """base + amplitude x s^n / (s^n + half^n); half the amplitude for a half-maximum of 0."""
    p = F.pow(s, F.lit(n))
    return F.lit(base) + F.lit(amplitude) * (p / (p + F.lit(half**n)) if half else F.lit(0.5))


def sigmoid(x: Column, x0: float, k: float, a: float) -> Column:
    return F.lit(a) / (1 + F.exp(F.lit(-k) * (x - F.lit(x0))))


def gauss_area(sx: Column, sy: Column, px: float, py: float) -> Column:
    """Area of the ellipse of two standard deviations."""
    return F.lit(math.pi * 4 * px * py) * sx * sy


def scan_type(nx: Column, ny: Column, nz: Column) -> Column:
    return F.when((nx > 1) & (ny > 1) & (nz > 1), "xyz").when((nx > 1) & (ny > 1), "xy").when((nx > 1) & (nz > 1), "xz")


def surround_strength(lo_on: Column, gl_on: Column, lo_off: Column, gl_off: Column, lp: Column, gp: Column) -> Column:
    """(local - global) / local of the common polarity; null if polarities differ."""
    return F.when((lp > 0) & (gp > 0), F.try_divide(lo_on - gl_on, lo_on)).when((lp < 0) & (gp < 0), F.try_divide(lo_off - gl_off, lo_off))


def corr(a, b) -> Column:
    """Pearson correlation as an aggregate; null where either side does not vary."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
