"""The operators' queries against their DuckDB SQL on the small tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from lodestone.llm import queries

SQL, QUERIES = queries.oracle_sql(), queries.queries()


def rows(table):
    cols = sorted(table.column_names)
    plain = lambda x: round(x, 9) if isinstance(x, float) else x
    return cols, sorted(repr([plain(x) for x in r]) for r in zip(*(table.column(c).to_pylist() for c in cols)))


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, name):
    data, con = "/root/testdata/sf0.01", duckdb.connect()
    for file in os.listdir(data):
        con.execute(f"create view {file.split('.')[0]} as select * from '{data}/{file}'")
    assert rows(QUERIES[name](spark, data).toArrow()) == rows(con.sql(SQL[name]).to_arrow_table())
