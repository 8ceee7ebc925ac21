"""Tasks that don't grow with the table, and pairs that are told once."""

import itertools
import random

from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import graph, resolve


def test_values_are_compared_once_for_all_their_rows(spark, monkeypatch):
    monkeypatch.setattr(resolve, "PAIR_CELL", 4)
    rng = random.Random(2)
    rows = [(k, rng.choice(["red bolt", "red belt", "Blue Nut", None]), rng.choice("xy")) for k in range(40)]
    df = spark.createDataFrame(rows, "id int, v string, block string")
    got = {(r["a"], r["b"]): r["similarity"] for r in resolve.scored_pairs(df, "id", "v", ["block"]).collect()}
    x, y = df.alias("x"), df.alias("y")
    want = x.join(y, (F.col("x.block") == F.col("y.block")) & (F.col("x.id") < F.col("y.id"))).select("x.id", "y.id", text.similarity(F.col("x.v"), F.col("y.v"))).collect()
    assert got == {(a, b): s for a, b, s in want} and len(got) == len(want) == resolve.scored_pairs(df, "id", "v", ["block"]).count()


def test_all_who_share_near_addresses_are_related(spark):
    """Copies of an address are each related with the copies of one that is near it."""
    rows = [("p1", "12 lake road pune"), ("p2", "12 Lake Road, Pune"), ("p3", "12 lake rd pune"), ("p4", "12 Lake Rd. Pune"), ("p5", "9 hill street")]
    none = F.lit(None).cast("string")
    df = spark.createDataFrame(rows, "id string, address string").select("id", F.lit("person").alias("type"), *(none.alias(c) for c in ("name", "phone", "email", "company", "account")), "address")
    pairs = lambda **how: sorted((r["a"], r["b"]) for r in resolve.relations(df, **how).collect())
    assert pairs() == list(itertools.combinations(["p1", "p2", "p3", "p4"], 2))
    assert pairs(firsts=True) == [("p1", "p2"), ("p1", "p3"), ("p3", "p4")]


def test_pairs_are_counted_in_tasks_that_follow_the_mentions(spark, monkeypatch):
    monkeypatch.setattr(graph, "TASK_MENTIONS", 100)
    rng = random.Random(6)
    rows = [(rng.randrange(60), f"e{rng.randrange(20)}", k) for k in range(900)]
    df = spark.createDataFrame(rows, "record_id int, entity string, ts int").select("*", F.substring("entity", 2, 1).alias("type"))
    out = graph.pair_counts(df)
    assert out.rdd.getNumPartitions() == 9
    names = {}
    for record, entity, _ in rows:
        names.setdefault(record, set()).add(entity)
    want = {}
    for found in names.values():
        for pair in itertools.combinations(sorted(found), 2):
            want[pair] = want.get(pair, 0) + 1
    assert {(r["a"], r["b"]): r["weight"] for r in out.collect()} == want


def test_a_small_level_sends_no_links(spark):
    edges = spark.range(1000).select(F.concat(F.lit("a"), F.col("id") % 50).alias("a"), F.concat(F.lit("b"), "id").alias("b"))
    out = graph._next(graph._level_of(["a7"], edges), edges, True)
    assert out.count() == 20 and {r["a"] for r in out.collect()} == {"a7"}
    assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()


def test_records_link_what_pairs_link(spark):
    rng = random.Random(7)
    df = spark.createDataFrame([(rng.randrange(40), f"e{rng.randrange(60)}") for _ in range(70)], "record_id int, entity string")
    links = graph.record_links(df)
    assert links.count() <= df.count()
    assert sorted(graph.components(links).collect()) == sorted(graph.components(graph.pair_counts(df)).collect())



def test_neighbours_send_only_what_leaves_a_frontier(spark, monkeypatch):
    """Nodes within two hops as by plain search, without all links being sent."""
    rng = random.Random(8)
    links = {tuple(rng.sample(range(80), 2)) for _ in range(150)}
    edges = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in links] + [("n0", "n0")], "a string, b string")
    near = {k: {b for a, b in links if a == k} | {a for a, b in links if b == k} for k in range(80)}
    one = near[0] - {0}
    two = set().union(*(near[k] for k in one)) - one - {0}
    want = sorted([(f"n{k}", 1) for k in one] + [(f"n{k}", 2) for k in two])
    monkeypatch.setattr(graph, "both_ways", None)
    for level in (100_000, 1):
        monkeypatch.setattr(graph, "LEVEL", level)
        assert sorted(map(tuple, graph.neighbours(edges, "n0", 2).collect())) == want


def test_blocks_of_vectors_meet_in_tiles(spark, monkeypatch):
    """All near pairs and the leaders of the sequential rule, of blocks in many tiles and products in strips, and ids that
    are looked up or joined; a tile is a task."""
    import numpy as np

    from quarry.operators import vectors

    rng = np.random.default_rng(4)
    v = rng.normal(0, 1, (300, 5))
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, vector array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if u[i] @ u[j] >= 0.8}
    leaders, joined = [], []
    for k in range(300):
        near = [x for x in leaders if u[x] @ u[k] >= 0.8]
        joined.append((near[0] if near else k, k))
        leaders += [] if near else [k]
    monkeypatch.setattr(vectors, "STRIP", 7)
    for tile, ids in ((1, 1_000_000), (2, 1)):
        monkeypatch.setattr(vectors, "TILE", tile)
        monkeypatch.setattr(vectors, "ROUND_IDS", ids)
        out = vectors.near_pairs(df, 0.8, block=10)
        got = [(r["a"], r["b"]) for r in out.collect()]
        assert set(got) == want and len(got) == len(want)
        assert out.rdd.getNumPartitions() > 100 // tile**2
        assert sorted(map(tuple, vectors.leader_clusters(df, 0.8, chunk=10).collect())) == sorted(joined)


def test_names_read_a_text_once(spark):
    """Words without letters part names; the words of a text are made once, not per rule and name."""
    from quarry.operators import extract

    first, last = extract.FIRST_NAMES[0], extract.gazetteer.SURNAMES[0]
    texts = [f"{first}\n {last.upper()}, x", f"{first} - {last}", f"x. {last}!", f"{first} {last} named Zora Quill", None, ""]
    out = extract.names(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    full = f"{first} {last}".title()
    assert sorted((r["doc"], r["name"]) for r in out.collect()) == sorted([(0, full), (1, first.title()), (1, last.title()), (2, last.title()), (3, full), (3, "Zora Quill")])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
