"""Fetching, paging, sinks and streams without a network."""

import json

import pytest

from quarry.sources import catalog, sinks, web
from quarry.streaming import ingest


def test_cache_and_limiter():
    now = [0.0]
    cache = web.TTLCache(10, most=2, clock=lambda: now[0])
    cache.put("a", 1)
    assert cache.get("a") == 1
    now[0] = 11
    assert cache.get("a") is None
    for k in "bcd":
        cache.put(k, k)
    assert cache.get("b") is None and cache.get("d") == "d"
    limiter = web.RateLimiter(2, clock=lambda: now[0])
    assert limiter.wait() == limiter.wait() == 0 and limiter.wait() == 60


def test_fetcher_retries_and_gives_up():
    waits = []

    def fails(url, params):
        raise OSError("down")

    with pytest.raises(OSError):
        web.Fetcher(fails, retries=2, sleep=waits.append).records("u")
    assert waits == [1.0, 2.0]
    calls = []
    f = web.Fetcher(lambda u, p: calls.append(u) or json.dumps({"data": [{"a": 1}]}))
    assert f.records("u") == f.records("u") == [{"a": 1}] and calls == ["u"]


def test_pages_with_cursor_cover_everything(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(20)], "k int, s int")
    seen, cursor, more = [], None, True
    while more:
        rows, cursor, more = catalog.page_with_cursor(df, "s", "k", 6, cursor=cursor)
        seen += [(r["s"], r["k"]) for r in rows]
    assert seen == sorted((i % 3, i) for i in range(20))


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, 'a "quoted", text'), (2, "plain"), (3, None)]
    sinks.write_csv(spark.createDataFrame(rows, "id int, v string"), str(tmp_path / "x"))
    back = spark.read.option("header", True).option("escape", '"').schema("id int, v string").csv(str(tmp_path / "x")).collect()
    assert sorted((r["id"], r["v"]) for r in back)[:2] == rows[:2]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.createDataFrame([(i, f"2024-01-{1 + i % 3:02d} 10:00:00") for i in range(30)], "id int, t string").selectExpr("id", "cast(t as timestamp) as ts")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = ingest.windowed_counts(stream).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, ingest.windowed_counts(events).collect()))
