"""Relational algebra over keyed tables: restriction, joins, projection, inserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _condition(df: DataFrame, by):
    """Column condition of a dict (equality on the columns that exist; others ignored) or SQL string."""
    if isinstance(by, str):
        return F.expr(by)
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(v)) for k, v in by.items() if k in df.columns], F.lit(True))


def shared(a: DataFrame, b: DataFrame) -> list[str]:
    return [c for c in a.columns if c in set(b.columns)]


def restrict(df: DataFrame, by) -> DataFrame:
    """Rows that meet ``by``: a dict, a SQL string, a list of those (any of them), or a table (shared columns)."""
    if isinstance(by, DataFrame):
        on = shared(df, by)
        return df.join(by.select(*on), on, "left_semi") if on else df
    if isinstance(by, list):
        return df.where(reduce(lambda a, b: a | b, [_condition(df, x) for x in by], F.lit(False)))
    return df.where(_condition(df, by))


def anti(df: DataFrame, by) -> DataFrame:
    """Rows that do not meet ``by``; a condition that is unknown counts as not met."""
    if isinstance(by, DataFrame):
        on = shared(df, by)
        return df.join(by.select(*on), on, "left_anti") if on else df.limit(0)
    conditions = by if isinstance(by, list) else [by]
    return df.where(~reduce(lambda a, b: a | b, [F.coalesce(_condition(df, x), F.lit(False)) for x in conditions], F.lit(False)))


def natural_join(a: DataFrame, b: DataFrame, parameters: int = 0) -> DataFrame:
    """Equi-join on all shared columns.  Without any it is an error, unless ``b`` is a parameter table of at most
    ``parameters`` rows, which is counted and then broadcast."""
    on = shared(a, b)
    if on:
        return a.join(b, on)
    if not parameters or b.limit(parameters + 1).count() > parameters:
        raise ValueError("the tables share no column, and the second is no small parameter table")
    return a.crossJoin(F.broadcast(b))


def with_params(keys: DataFrame, params: list[dict]) -> DataFrame:
    """Each key with each parameter set: the sets are literals, so this is a projection, not a join."""
    sets = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in p.items()]) for p in params])
    return keys.select("*", F.explode(sets).alias("_p")).select(*keys.columns, "_p.*")


def project(df: DataFrame, key: list[str], *columns: str, **renamed: str) -> DataFrame:
    """Key, named columns and ``new=old`` renames."""
    return df.select(*key, *columns, *[F.col(old).alias(new) for new, old in renamed.items()])


def roles(df: DataFrame, on: list[str], one: tuple, two: tuple) -> DataFrame:
    """Self-join of two restrictions of a table, each (condition, {new: old})."""
    a, b = (project(restrict(df, cond), on, **names) for cond, names in (one, two))
    return a.join(b, on)


def fetch1(df: DataFrame):
    """The only row; an error if there is none or more than one."""
    rows = df.take(2)
    if len(rows) != 1:
        raise LookupError(f"expected one row, found {'none' if not rows else 'more'}")
    return rows[0]


def exists(df: DataFrame) -> bool:
    return not df.isEmpty()


def within(df: DataFrame, most: int) -> DataFrame:
    """At most ``most`` + 1 rows of ``df``, and an error once the last of them is reached: what goes to the driver is bounded."""
    few = df.limit(most + 1)
    if few.count() > most:
        raise ValueError(f"over {most} rows: restrict them, allow more, or keep them in a table")
    return few


def fetch_frame(df: DataFrame, key: list[str], most: int = 1_000_000):
    """A pandas frame with the key as index (at the edge of the API only); over ``most`` rows are an error."""
    return within(df, most).toPandas().set_index(key)


def insert(target: DataFrame, rows: DataFrame, key: list[str], skip_duplicates: bool = False) -> DataFrame:
    """``target`` with ``rows``; a key that is there already is an error, or skipped."""
    once = rows.dropDuplicates(key) if skip_duplicates else rows
    if not skip_duplicates and (exists(rows.join(target, key, "left_semi")) or exists(rows.groupBy(*key).count().where("count > 1"))):
        raise ValueError("duplicate key")
    return target.unionByName(once.join(target, key, "left_anti"))


def update(target: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Payload of existing keys replaced; a key that is not there is an error."""
    if exists(rows.join(target, key, "left_anti")):
        raise KeyError("no such key")
    return upsert(target, rows, key)


def upsert(target: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    return target.join(rows, key, "left_anti").unionByName(rows)


def delete(target: DataFrame, by) -> DataFrame:
    return anti(target, by)


def best(df: DataFrame, key: list[str], score: str, *ties: str) -> DataFrame:
    """The row of least score of each key; whole rows travel with the partial aggregate."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(score, *ties)).alias("_r")).select(*key, "_r.*")


def unique_one(df: DataFrame, key: list[str], column: str, tolerance: float = 0.0) -> DataFrame:
    """The common value of each key; null where values differ by more than the tolerance."""
    low, high = F.min(column), F.max(column)
    same = (high - low <= tolerance) if tolerance else (low == high)
    return df.groupBy(*key).agg(F.when(same, low).alias(column))


def merge_keys(one: dict, two: dict) -> dict:
    for k in one.keys() & two.keys():
        if one[k] != two[k]:
            raise ValueError(f"conflicting values for {k}")
    return one | two


def closest_rows(df: DataFrame, other: DataFrame) -> bool:
    """Do two tables have the same columns and rows, repeats counted?"""
    if sorted(df.columns) != sorted(other.columns):
        return False
    a, b = df, other.select(*df.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def fetch_keys(df: DataFrame, key: list[str], most: int = 1_000_000) -> list[dict]:
    """The keys as dicts (at the edge of the API only); over ``most`` are an error."""
    return [r.asDict() for r in within(df.select(*key).distinct(), most).collect()]


def numbers_equal(a, b, relative: float = 1e-5) -> bool:
    """Equality of nested values: numbers within a relative tolerance, NaN like NaN, arrays item by item."""
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(numbers_equal(a[k], b[k], relative) for k in a)
    if isinstance(a, list | tuple) and isinstance(b, list | tuple):
        return len(a) == len(b) and all(numbers_equal(x, y, relative) for x, y in zip(a, b, strict=True))
    if isinstance(a, float) or isinstance(b, float):
        return (a != a and b != b) or abs(a - b) <= relative * max(abs(a), abs(b), 1e-300)
    return a == b


def grouped(df: DataFrame, by: list[str], *values: str) -> DataFrame:
    """Results by parameter: number, mean and extremes of each value."""
    each = [f(v).alias(f"{n}_{v}") for v in values for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *each)


def secondary(df: DataFrame, key: list[str]) -> list[str]:
    return [c for c in df.columns if c not in key]


def random_key(df: DataFrame, key: list[str], seed: int = 0) -> DataFrame:
    return df.select(*key).orderBy(F.rand(seed)).limit(1)
