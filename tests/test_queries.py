"""Every query of the core with an SQL twin gives the same rows as DuckDB."""

import glob
import os

import duckdb
import pytest

from cuemill.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables aren't here")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def norm(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str)
    if name not in catalog.SQL:
        assert rows
        return
    r = db.execute(catalog.SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    want = sorted((tuple(norm(x[names.index(c)]) for c in cols) for x in r.fetchall()), key=str)
    assert rows == want


def test_entry_lists_queries(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
