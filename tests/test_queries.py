"""Every registered query runs; those with SQL agree with DuckDB on the smallest tables."""

import datetime

import duckdb
import pytest

from epochal import queries as signal

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v != v:
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    if isinstance(v, bool | int):
        return int(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    try:
        return float(f"{float(v):.6g}")
    except (TypeError, ValueError):
        return str(v)


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(signal.queries()))
def test_query(spark, sf, con, name):
    df = signal.queries()[name](spark, sf)
    got = canon(df.columns, df.collect())
    if name in signal.oracle_sql():
        r = con.sql(signal.oracle_sql()[name])
        assert got == canon(r.columns, r.fetchall())
    else:
        assert got[1]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
