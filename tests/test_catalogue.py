"""Each query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from pagelathe.plans import catalogue, corrections  # noqa: F401

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_same_rows(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DIR)
    columns = sorted(got.columns)
    rows = sorted([tuple(map(plain, r)) for r in got.select(*columns).collect()], key=repr)
    if name not in catalogue.ORACLE:
        assert rows
        return
    want = duck.sql(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({catalogue.ORACLE[name]})")
    assert rows == sorted([tuple(map(plain, r)) for r in want.fetchall()], key=repr)


def test_entry_without_llm():
    import __spark_entry__ as e

    assert set(catalogue.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
