"""Every registered query against its SQL, on the smallest driver tables."""

import glob
import os

import duckdb
import pytest

from quillmark.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df, want = catalogue.QUERIES[name](spark, DATA), duck.sql(catalogue.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    got = [tuple(r) for r in df.select(*(f"`{c}`" for c in columns)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want.select(",".join(f'"{c}"' for c in columns)).fetchall()))
