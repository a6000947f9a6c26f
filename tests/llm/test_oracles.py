"""The queries that SQL can express, against DuckDB on the smallest tables."""

import duckdb
import pytest

from tessera.llm import queries
from tests.test_queries import TABLES, rows


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    assert rows(queries.queries()[name](spark, small).toPandas()) == rows(con.execute(queries.oracle_sql()[name]).df())


def test_all_ten_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
