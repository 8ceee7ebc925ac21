"""Queries with SQL give the same rows as DuckDB."""

import collections

import pytest

from quarry.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    import duckdb

    con = duckdb.connect()
    for name_ in ("documents", "conversations"):
        con.execute(f"create view {name_} as select * from '{DATA}/{name_}.parquet'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda x: round(x, 6) if isinstance(x, float) else x
    assert collections.Counter(tuple(plain(r[c]) for c in want.columns) for r in got.collect()) == collections.Counter(tuple(map(plain, r)) for r in want.fetchall())
