"""Searches tell how far they are."""

from quarry.operators import search
from quarry.streaming.progress import Progress


def test_rounds_and_stages(spark):
    mentions = spark.createDataFrame([(k, f"e{x}") for k in range(6) for x in (k, k + 1)], "record_id int, entity string")
    seeds = spark.createDataFrame([("e0",)], "entity string")
    events = []
    with Progress(spark, events.append, every=0.05) as p:
        out = search.expand(mentions, seeds, rounds=3, progress=p.round)
    assert {r["entity"]: r["hop"] for r in out.collect()} == {f"e{k}": k for k in range(4)}
    assert [e for e in events if e["kind"] == "round"] == [{"kind": "round", "round": k, "new": 1, "known": k + 1} for k in (1, 2, 3)]
    stages = [e for e in events if e["kind"] == "stage"]
    assert stages and all(0 <= e["done"] <= e["tasks"] for e in stages)
    assert events[-1] == {"kind": "end", "error": None}
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") != p.group


def test_a_failing_callback_stops_nothing(spark):
    def bad(event):
        raise RuntimeError(event["kind"])

    with Progress(spark, bad) as p:
        assert spark.range(10).count() == 10
    assert str(p.errors[-1]) == "end"
    seen = []
    try:
        with Progress(spark, seen.append):
            raise ValueError("no")
    except ValueError:
        pass
    assert seen[-1] == {"kind": "end", "error": "no"}
