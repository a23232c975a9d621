"""Registered queries against their SQL at a small scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from movecast.plans import oracle
from movecast.plans import queries as registered

QUERIES, SQL = registered.queries(), oracle.sql()


def table_rows(table):
    names = sorted(table.column_names)
    return names, sorted(map(repr, zip(*[table[n].to_pylist() for n in names], strict=True)))


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{sf_dir}/events.parquet'")
    return con


def test_every_query_has_sql():
    assert QUERIES.keys() == SQL.keys()


def test_entry_has_every_query():
    assert QUERIES.keys() <= entry.queries().keys()
    assert {k: v for k, v in entry.oracle_sql().items() if k in SQL} == SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, sf_dir, name):
    got = table_rows(QUERIES[name](spark, sf_dir).toArrow())
    assert got[1]
    assert got == table_rows(db.sql(SQL[name]).to_arrow_table())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
