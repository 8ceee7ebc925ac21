"""Every registered query with SQL gives the same rows as DuckDB on the small tables."""

import glob
import os

import pytest

from quarry.plans import load

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()


def _rows(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if frame[c].dtype == float:
            frame[c] = frame[c].round(6) + 0.0
    frame = frame.astype(object).where(frame.notna(), None)
    return sorted((tuple(str(x) for x in r) for r in frame.itertuples(index=False)))


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in ORACLES:
        want = duck.execute(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert _rows(got) == _rows(want)
