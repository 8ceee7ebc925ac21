"""Ranks, cycles counted by their hubs and leaders, against brute force."""

import collections
import itertools
import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import graph


def brute(links):
    near = collections.defaultdict(set)
    for a, b in links:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    order = sorted(near, key=lambda x: (len(near[x]), x))
    no = {x: k for k, x in enumerate(order)}
    count = collections.Counter()
    for three in itertools.combinations(order, 3):
        if all(y in near[x] for x, y in itertools.combinations(three, 2)):
            count[max(three, key=no.get), 3] += 1
    for four in itertools.combinations(order, 4):
        for a, b, c, d in ((0, 1, 2, 3), (0, 2, 1, 3), (0, 1, 3, 2)):
            path = [four[k] for k in (a, b, c, d)]
            if all(path[k - 1] in near[path[k]] for k in range(4)):
                count[max(four, key=no.get), 4] += 1
    return near, no, count


@pytest.mark.parametrize("tile", [4_000_000, 7])
def test_cycle_classes(spark, monkeypatch, tile):
    monkeypatch.setattr(graph, "TILE_LINKS", tile)
    rng = random.Random(1)
    links = [(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(50)] + [("hub", f"n{k}") for k in range(14)] + [("x", "y"), ("y", "x")]
    near, no, want = brute(links)
    df = spark.createDataFrame(links, "a string, b string")
    got = graph.cycle_classes(df).collect()
    assert {(r["hub"], r["size"]): r["cycles"] for r in got} == want
    for r in got:
        path = r["example"]
        assert path[0] == r["hub"] == max(path, key=no.get) and len(set(path)) == r["size"]
        assert all(path[k - 1] in near[path[k]] for k in range(len(path)))
    listed = collections.Counter(len(r["cycle"]) for r in graph.cycles(df, 4).collect())
    assert listed == {k: sum(n for (_, size), n in want.items() if size == k) for k in (3, 4)}


def test_no_cycles(spark):
    for rows in ([], [("a", "b"), ("b", "c"), ("c", "c")]):
        assert graph.cycle_classes(spark.createDataFrame(rows, "a string, b string")).count() == 0


def test_ranks_need_no_single_task(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v"), (F.col("id") % 3).alias("w")).repartition(5)
    got = [(r["rank"], r["w"], r["v"]) for r in graph.ranked(df, F.col("w").desc(), "v").collect()]
    assert sorted(got) == [(k, w, v) for k, (w, v) in enumerate(sorted(((w, v) for _, w, v in got), key=lambda x: (-x[0], x[1])), 1)]
    assert graph.ranked(df.limit(0), "v").count() == 0


def test_paths_from_both_ends(spark):
    rng = random.Random(8)
    links = {(f"n{a}", f"n{b}") for a, b in ((rng.randrange(9), rng.randrange(9)) for _ in range(16)) if a != b} | {("n0", "m"), ("p", "q")}
    near = collections.defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)

    def walk(path, goal, most):
        if path[-1] == goal:
            yield tuple(path)
        elif len(path) <= most:
            for x in near[path[-1]] - set(path):
                yield from walk([*path, x], goal, most)

    df = spark.createDataFrame(sorted(links), "a string, b string")
    for goal, most in (("n1", 1), ("n1", 2), ("n4", 4), ("p", 3)):
        got = [tuple(r["path"]) for r in graph.simple_paths(df, "n0", goal, most).collect()]
        assert sorted(got) == sorted(walk(["n0"], goal, most))
    for goal in ("m", "n4", "q"):
        all_ = sorted(walk(["n0"], goal, 10), key=lambda p: (len(p), p))
        assert [tuple(r["path"]) for r in graph.shortest_path(df, "n0", goal).collect()] == all_[:1]


def test_triangles_are_listed_in_tiles(spark, monkeypatch):
    """Ways over links are never an exchange's rows, neither where cycles are listed nor where they are counted."""
    monkeypatch.setattr(graph, "TILE_LISTED", 40)
    rng = random.Random(4)
    links = [(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for _ in range(60)] + [(f"m{k}", f"m{(k + 1) % 3}") for k in range(3)]
    near, _, _ = brute(links)
    df = graph.cycles(spark.createDataFrame(links, "a string, b string"), 3)
    assert sorted(tuple(r["cycle"]) for r in df.collect()) == sorted(t for t in itertools.combinations(sorted(near), 3) if all(y in near[x] for x, y in itertools.combinations(t, 2)))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Join" not in plan.split("FlatMapCoGroupsInArrow")[0]


def test_cycles_send_no_copies_of_links(spark, monkeypatch, tmp_path):
    """However many tiles there are, they read their links from the shared folder: nothing is dealt to tiles by an
    exchange, and the tables that were written hold each link a few times at most."""
    monkeypatch.setattr(graph, "TILE_LINKS", 30)
    monkeypatch.setattr(graph, "TILE_WAYS", 20)
    rng = random.Random(6)
    links = sorted({tuple(sorted(rng.sample(range(16), 2))) for _ in range(90)})
    rows = []
    write = graph.written
    monkeypatch.setattr(graph, "written", lambda df, *a, **b: rows.append((out := write(df, *a, **b)).count()) or out)
    _, no, want = brute([(f"n{a}", f"n{b}") for a, b in links])
    got = graph.cycle_classes(spark.createDataFrame(links, "a long, b long"), lambda c: F.concat(F.lit("n"), c), True).collect()
    assert {(r["hub"], r["size"]): r["cycles"] for r in got} == want
    assert all(r["example"][0] == r["hub"] == max(r["example"], key=no.get) for r in got)
    assert max(rows) <= 2 * len(links)


def test_listed_cycles_send_each_link_once(spark, monkeypatch):
    """Blocks of links are read by the tasks that list, so no link is dealt to several tiles."""
    monkeypatch.setattr(graph, "TILE_LINKS", 30)
    monkeypatch.setattr(graph, "TILE_LISTED", 40)
    rng = random.Random(7)
    links = sorted({tuple(sorted(rng.sample(range(14), 2))) for _ in range(70)})
    df = graph.cycles(spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in links], "a string, b string"), 3)
    near, _, _ = brute([(f"n{a}", f"n{b}") for a, b in links])
    assert sorted(tuple(r["cycle"]) for r in df.collect()) == sorted(t for t in itertools.combinations(sorted(near), 3) if all(y in near[x] for x, y in itertools.combinations(t, 2)))
    assert "Generate" not in df._jdf.queryExecution().optimizedPlan().toString()
