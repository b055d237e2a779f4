"""File-name grammar, directory scans and path rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(folder, filename) of all files below ``root``, hidden ones left out; listed by Spark, no content read (empty files are not listed)."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path")
    return f.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract("path", r"([^/]*)$", 1).alias("filename")).where(~F.col("filename").startswith("."))


def tokens(name: Column, sep: str = "_") -> Column:
    return F.split(F.regexp_replace(name, r"\.[^.]*$", ""), sep)


def token(name: Column, at: int | None, sep: str = "_") -> Column:
    """Token at a place; null out of range or for a negative place."""
    return F.lit(None).cast("string") if at is None or at < 0 else F.get(tokens(name, sep), F.lit(at))


def alias_match(value: Column, aliases: list[str], numbered: bool = False) -> Column:
    """Is the value one of the aliases (case apart), or an alias with a number behind it?"""
    import re

    return F.coalesce(F.lower(value).rlike("^(" + "|".join(re.escape(a.lower()) for a in aliases) + ")" + ("[0-9]*" if numbered else "") + "$"), F.lit(False))


def kind(value: Column, rules: list[tuple[str, list[str]]], other: str = "response") -> Column:
    """First kind whose aliases match."""
    out = None
    for name, aliases in rules:
        m = alias_match(value, aliases, True)
        out = F.when(m, name) if out is None else out.when(m, name)
    return out.otherwise(other)


def share_alias(a: Column, b: Column, sep: str = "_") -> Column:
    """Do two separated lists share a token (case apart, empty ones ignored)?"""
    return F.arrays_overlap(F.array_remove(F.split(F.lower(a), sep), ""), F.array_remove(F.split(F.lower(b), sep), ""))


def match_file(name: Column, pattern: str, at: int | None = None, contains: bool = False) -> Column:
    t = F.transform(tokens(name), F.lower) if at is None else F.array(F.lower(token(name, at)))
    want = [p for p in pattern.lower().split("_") if p]
    return F.exists(t, lambda x: F.coalesce(x.contains(want[0]) if contains else x.isin(*want), F.lit(False)))


def to_preprocessed(path: Column, raw: str = "Raw", pre: str = "Pre", prefix: str = "SMP_", raw_suffix: str = ".smp", suffix: str = ".h5") -> Column:
    """``.../Raw/name.smp`` to ``.../Pre/SMP_name.h5``; an error for any other path."""
    import re

    good = f"^(.*)/{re.escape(raw)}/([^/]*){re.escape(raw_suffix)}$"
    return F.when(path.rlike(good), F.regexp_replace(path, good, f"$1/{pre}/{prefix}$2{suffix}")).otherwise(F.raise_error(F.concat(F.lit("not a raw path: "), path)))


def mask_path(path: Column, folder: str = "ROIs", suffix: str = "_ROIs.pkl") -> Column:
    return F.regexp_replace(path, r"^(.*)/[^/]*/([^/.]*)\.[^/]*$", f"$1/{folder}/$2{suffix}")


def ini_pairs(lines: DataFrame) -> DataFrame:
    """(path, key, value) of header lines ``prefix_key = value``; key is what follows the first ``_``, the last section wins."""
    ok = lines.where(F.col("line").rlike(r"^[^;#\[][^=]*=")).select(
        "path", "line_no", F.trim(F.regexp_replace(F.regexp_extract("line", r"^([^=]*)=", 1), r"^\s*[^_=]*_", "")).alias("key"), F.trim(F.regexp_extract("line", r"=(.*)$", 1)).alias("value")
    )
    return ok.groupBy("path", "key").agg(F.max_by("value", "line_no").alias("value"))
