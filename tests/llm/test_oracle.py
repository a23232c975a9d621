"""Registered queries over documents against their SQL."""

import duckdb
import pytest

from movecast.llm import oracle, queries

SQL = oracle.sql()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return con


def rows_of(table):
    names = sorted(table.column_names)
    return names, sorted(map(repr, zip(*[table[n].to_pylist() for n in names], strict=True)))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, db, sf_dir, name):
    got = rows_of(queries.queries()[name](spark, sf_dir).toArrow())
    assert got[1]
    assert got == rows_of(db.sql(SQL[name]).to_arrow_table())
