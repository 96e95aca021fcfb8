"""Training-data queries that SQL can express, against DuckDB at sf0.01."""
import duckdb
import pytest

from cohortlab.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    rows = want.select(*[duckdb.ColumnExpression(c) for c in got.columns]).fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, rows))


def test_every_numbered_query_is_registered():
    names = [n for n in queries.queries() if n != "pipeline"]
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))
