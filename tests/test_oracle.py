"""Every query with a SQL twin gives the twin's rows on the smallest tables, where they are at hand."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v if v is None or isinstance(v, (bool, int)) else str(v)


def twins():
    own = {"spandrel.llm.queries"}
    return [n for m in entry._modules() if m.__name__ not in own for n in m.QUERIES if n in m.SQL]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", twins())
def test_twin(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    rel = duck.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[k]) for k in at) for r in rel.fetchall()), key=str)
