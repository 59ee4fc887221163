"""Every query of the catalogue against its DuckDB oracle on the small tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from lodestone.plans.catalogue import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"create view {name.split('.')[0]} as select * from '{DATA}/{name}'")
    return con


def rows(table):
    cols = sorted(table.column_names)
    plain = lambda x: round(x, 9) if isinstance(x, float) else x
    return cols, sorted(repr([plain(x) for x in r]) for r in zip(*(table.column(c).to_pylist() for c in cols)))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = rows(QUERIES[name](spark, DATA).toArrow())
    assert got == rows(duck.sql(ORACLES[name]).to_arrow_table())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
