"""Every query of the catalog that has SQL, against DuckDB on the same tables."""

import os

import pytest

from wordloom.plans import catalog

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for f in os.listdir(SF_DIR):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF_DIR}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_agrees(spark, duck, name):
    out = catalog.queries()[name](spark, SF_DIR)
    cols = ", ".join(f'"{c}"' for c in sorted(out.columns))
    got = sorted(repr(tuple(r)) for r in out.select(*sorted(out.columns)).collect())
    assert got == sorted(repr(r) for r in duck.execute(f"SELECT {cols} FROM ({catalog.oracle_sql()[name]})").fetchall())
    assert got, "a query without rows says nothing"


def test_queries_without_sql_are_few():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"e8_offsets", "x2_stream_decode"}
