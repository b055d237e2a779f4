"""Queries that SQL can say, against DuckDB on the smallest tables."""

import duckdb
import pytest

from epochal.llm import queries as llm
from tests.test_queries import TABLES, canon


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_is_what_sql_says(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = llm.queries()[name](spark, sf)
    r = con.sql(llm.oracle_sql()[name])
    assert canon(df.columns, df.collect()) == canon(r.columns, r.fetchall())
