"""The registered SQL gives the queries' rows."""

import os

import duckdb
import pytest

from millrace.llm import queries

DIR = "/root/testdata/sf0.01"


def rows_of(frame):
    return sorted(map(tuple, frame.select(*sorted(frame.columns)).collect()))


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as from '{DIR}/documents.parquet'")
    want = con.sql(queries.ORACLE[name])
    columns = sorted(want.columns)
    got = rows_of(queries.QUERIES[name](spark, DIR))
    assert got == sorted(map(tuple, want.select(*columns).fetchall()))
    assert got
