"""Whole inputs are used: brute force over all records, not over a batch of them."""

import collections
import os

import pytest

from quarry.plans import load

DATA = "/root/testdata/sf0.001"
QUERIES, _ = load()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def orders(spark):
    """order -> the customer and suppliers it names, of all orders."""
    out = collections.defaultdict(set)
    for k, s in spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_orderkey", "l_suppkey").collect():
        out[k].add(f"s{s}")
    for k, c in spark.read.parquet(f"{DATA}/orders.parquet").select("o_orderkey", "o_custkey").collect():
        out[k].add(f"c{c}")
    return out


@pytest.mark.parametrize("name, rounds, limit, down", [("e03_expand_leads", 3, None, False), ("e04_expand_by_priority", 3, 5, False), ("e05_agent_expansion", 2, 5, True)])
def test_expansion_reads_all_orders(spark, orders, name, rounds, limit, down):
    want, last = {"s1": 0}, {"s1"}
    for hop in range(1, rounds + 1):
        new = {e for named in orders.values() if named & last for e in named} - set(want)
        last = set(sorted(new, reverse=down)[:limit])
        want.update(dict.fromkeys(last, hop))
    assert {r["entity"]: r["hop"] for r in QUERIES[name](spark, DATA).collect()} == want


@pytest.fixture(scope="module")
def links(orders):
    out = collections.defaultdict(set)
    for named in orders.values():
        for e in named:
            out[e] |= named - {e}
    return out


def test_graphs_have_all_orders(spark, links):
    left, parts = set(links), []
    while left:
        part, edge = set(), {min(left)}
        while edge:
            part |= edge
            edge = {y for x in edge for y in links[x]} - part
        left -= part
        parts.append((min(part), len(part)))
    got = QUERIES["f10_clusters"](spark, DATA).collect()
    assert sorted((r["component"], r["size"]) for r in got) == sorted(p for p in parts if p[1] >= 3)

    start = min(links)
    one = links[start]
    two = {y for x in one for y in links[x]} - one - {start}
    got = QUERIES["f14_neighbours"](spark, DATA).collect()
    assert {r["id"]: r["hops"] for r in got} == {**dict.fromkeys(one, 1), **dict.fromkeys(two, 2)}

    got = QUERIES["f15_adjacency"](spark, DATA).collect()
    assert {r["id"]: r["neighbours"] for r in got} == {x: ",".join(sorted(ys)) for x, ys in links.items()}


def test_cycles_of_all_orders(spark, links):
    want = sorted(f"{a}>{b}>{c}" for a in links for b in links[a] if a < b for c in links[b] & links[a] if b < c)
    assert sorted(r["cycle"] for r in QUERIES["f22_cycles"](spark, DATA).collect()) == want


def test_context_of_neighbours_and_amounts(spark):
    from quarry.operators import extract as X

    texts = ["call 9000000001 or call 9000000002", "x" * 80 + " mobile: 9000000003\n" + "y" * 80, "paid Rs. 5,000 then received: INR 700.50, phone 9000000004", "", None]
    got = X.with_context(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    assert sorted((r["doc"], r["type"], r["value"]) for r in got) == [(0, "phone", "9000000001"), (0, "phone", "9000000002"), (1, "phone", "9000000003"), (2, "amount", "5000"), (2, "amount", "700.50"), (2, "phone", "9000000004")]
    by = {r["value"]: r["context"] for r in got}
    assert by["9000000001"] == by["9000000002"] == texts[0]
    assert by["9000000003"] == "x" * 49 + " mobile: 9000000003\n" + "y" * 49


def test_no_near_pair_is_lost(spark):
    import itertools
    import random

    from pyspark.sql import functions as F

    from quarry.operators import resolve as X

    rng = random.Random(5)
    words = ["rajeshkum", "arajeshkum", "aaaa", "aaaaa", "aabaa", "abcd", "abcde", "bcde", "a", "", "2 lake road pune", "12 lake road pune"]
    for _ in range(120):
        w = list(rng.choice(words[:9] + words[10:]))
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randrange(2)] = rng.choice(["", "a", "b", "x"])
        words.append("".join(w))
    words = sorted(set(words))

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    df = spark.createDataFrame([(f"{i:03}", "person", w) for i, w in enumerate(words)], "id string, type string, normalized string")
    for t in (0.8, 0.85, 0.9):
        want = {(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(words), 2) if 1 - edits(a, b) / max(len(a), len(b), 1) >= t}
        met = {(int(r[0]), int(r[1])) for r in X.candidate_pairs(df, X.edit_keys(F.col("normalized"), t)).select("x.id", "y.id").collect()}
        assert want and want <= met
    two = df.where(F.col("normalized").isin("rajeshkum", "arajeshkum"))
    assert [r["merged_from"] for r in X.merge(two.withColumn("confidence", F.lit(0.9))).collect()] == [2]
    schema = "id string, type string, name string, phone string, email string, address string, company string, account string"
    people = [("p1", "person", "A", None, None, "12 Lake Road Pune", "arajeshkum", None), ("p2", "person", "B", None, None, "2 Lake Road Pune", None, None), ("c1", "company", "Rajeshkum", None, None, None, None, None)]
    assert sorted((r["a"], r["b"], r["type"]) for r in X.relations(spark.createDataFrame(people, schema)).collect()) == [("p1", "c1", "employed_by"), ("p1", "p2", "shared_address")]


def test_gazetteers_of_names_and_places(spark):
    from quarry.operators import extract as X
    from quarry.operators import gazetteer as G

    assert [len(x) for x in (G.FIRST_NAMES, G.SURNAMES, G.NAME_STOP_WORDS, G.CITIES, G.STATES)] == [598, 462, 114, 160, 40]
    texts = ["then AAKASH kumar, Tiwari came", "a certain wadhwa of Navi Mumbai in Tamil Nadu", "he is called Zorblat Qix; mr. Quux left", "named The Thing", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    names = {(r["doc"], r["name"]) for r in X.names(df).collect()}
    assert {(0, "Aakash Kumar Tiwari"), (1, "Wadhwa"), (2, "Zorblat Qix"), (2, "Quux")} <= names and not any(d > 2 for d, _ in names)
    assert {(r["doc"], r["location"]) for r in X.locations(df).collect()} == {(1, "mumbai"), (1, "navi mumbai"), (1, "tamil nadu")}

    first, last = set(X.FIRST_NAMES), set(G.SURNAMES)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = collections.defaultdict(set)
    for r in QUERIES["c19_names_documents"](spark, DATA).collect():
        got[r["doc"]].add(r["name"].lower())
    for i, text in docs.items():
        words = ["".join(c for c in w.lower() if "a" <= c <= "z") for w in (text or "").split()]
        for k, w in enumerate(words):
            if w in first:
                end = next((j for j in range(k, len(words)) if words[j] not in first | last), len(words))
                assert " ".join(words[k:end]) in got[i]
            elif w in last and not (k and words[k - 1] in first):
                assert w in got[i]


def test_types_by_all_values(spark):
    from quarry.operators import profile as Q

    df = spark.createDataFrame([("no mail",)] * 60 + [(f"a{i}@b.org",) for i in range(100)], "x1 string").coalesce(1)
    assert [tuple(r) for r in Q.detect_types(df).collect()] == [("x1", "email", 0.8)]
    got = {r["field"] for r in QUERIES["i01_field_types"](spark, DATA).collect()}
    assert got == set(spark.read.parquet(f"{DATA}/customer.parquet").columns)
