"""Each query with SQL gives the SQL's rows."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from skein.plans import read_queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", list(read_queries.ORACLE_SQL))
def test_query(spark, duck, name):
    df = read_queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = duck.execute(read_queries.ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr) == want


def test_entry(spark):
    assert entry.entry(spark).count() == 26
    assert set(entry.oracle_sql()) <= set(entry.queries())
