"""Every registered query with a DuckDB statement gives the same rows on the smallest tables."""

import glob
import os
import sys

import duckdb
import pytest

import __spark_entry__ as entry

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check import norm  # noqa: E402

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    db = duckdb.connect()
    for path in glob.glob(f"{ROOT}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return db


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, con, name):
    df = entry.queries()[name](spark, ROOT)
    columns = sorted(df.columns)
    mine = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(norm(dict(zip(names, r))[c]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert mine == theirs
