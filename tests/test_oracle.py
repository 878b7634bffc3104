"""Every query that has SQL against DuckDB on the small tables."""

import duckdb
import pytest

from pagesim import oracle, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("pages", "documents"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(oracle.SQL)


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_equals_sql(spark, db, name):
    own = queries.QUERIES[name](spark, SF)
    columns = sorted(own.columns)
    other = db.sql(oracle.SQL[name])
    assert sorted(other.columns) == columns
    rows = other.project(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert sorted(map(repr, (tuple(r) for r in own.select(*columns).collect()))) == sorted(map(repr, rows))
