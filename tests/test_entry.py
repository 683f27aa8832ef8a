"""The driver's entry points: every query runs, and matches its SQL where it has one."""

import datetime
import math
import os

import __spark_entry__ as entry
import duckdb
import pytest

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = [k for k in entry.queries() if not k.startswith("op") and k != "pipeline"]

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, datetime.datetime):
        return x.date() if x.time() == datetime.time() else x
    return x


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["station", "depth", "year", "missing_days"]


@pytest.mark.parametrize("name", OWN)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((str([plain(x) for x in r]) for r in df.select(*cols).collect()))
    if name in entry.oracle_sql():
        rel = con.sql(entry.oracle_sql()[name])
        assert sorted(rel.columns) == cols
        at = [rel.columns.index(c) for c in cols]
        assert got == sorted(str([plain(r[i]) for i in at]) for r in rel.fetchall())
