"""Every query against its DuckDB text on the smallest tables, and the others for rows."""

import glob
import math
import os

import duckdb
import pytest

from loamgrid.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def cells(rows, columns):
    def one(v):
        if isinstance(v, float):
            return "null" if math.isnan(v) else f"{v:.5g}" if abs(v) > 1e-9 else "0"
        return "null" if v is None else str(v)

    return sorted(tuple(one(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DIR)
    columns = sorted(got.columns)
    rows = [tuple(r[c] for c in columns) for r in got.collect()]
    assert rows
    if name in SQL:
        want = duck.sql(SQL[name])
        assert sorted(want.columns) == columns
        assert cells(rows, columns) == cells([tuple(dict(zip(want.columns, r))[c] for c in columns) for r in want.fetchall()], columns)
