"""Each raster query against its SQL, row by row, on the smallest tables."""

import math

import duckdb
import pytest

from talus.oracles import SQL
from talus.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{FOLDER}/lineitem.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return repr(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    found = QUERIES[name](spark, FOLDER)
    columns = sorted(found.columns)
    mine = sorted(tuple(_plain(r[c]) for c in columns) for r in found.toArrow().to_pylist())
    theirs = con.sql(SQL[name]).to_arrow_table()
    assert sorted(theirs.column_names) == columns
    assert mine == sorted(tuple(_plain(r[c]) for c in columns) for r in theirs.to_pylist())
