"""Vectors, resolution, rules, relations and fetching against plain code."""

import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import extract, graph, patterns, profile, resolve, vectors
from quarry.sources import shared, web


def _vectors(spark, n=400, size=8, seed=1):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, size))
    v[n // 2 :] = v[: n - n // 2] + 0.15 * rng.standard_normal((n - n // 2, size))
    v[3] = 0
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(None, v[0].tolist()), (n, None)]
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    return spark.createDataFrame(rows, "id long, vector array<double>").repartition(3), u @ u.T


@pytest.mark.parametrize("block", [2048, 37])
def test_near_pairs_are_all_pairs(spark, block):
    df, s = _vectors(spark)
    for threshold in (0.95, 0.6):
        want = {(a, b) for a, b in itertools.combinations(range(len(s)), 2) if s[a, b] >= threshold}
        got = {(r["a"], r["b"]): r["similarity"] for r in vectors.near_pairs(df, threshold, block=block).collect()}
        assert set(got) == want and all(abs(v - s[k]) < 1e-9 for k, v in got.items())
    assert vectors.near_pairs(df.limit(0), 0.9).count() == 0


def test_sketched_pairs_reach_their_recall(spark):
    df, s = _vectors(spark, 600)
    want = {(a, b) for a, b in itertools.combinations(range(len(s)), 2) if s[a, b] >= 0.9}
    got = {(r["a"], r["b"]) for r in vectors.near_pairs(df, 0.9, recall=0.95).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)


def test_leader_clusters_equal_plain_code(spark):
    df, s = _vectors(spark, 200)
    df = df.where("id is not null and vector is not null")
    for chunk in (1000, 17):
        lead = {}
        leaders = []
        for i in range(200):
            first = next((k for k in leaders if s[k, i] >= 0.85), None)
            lead[i] = i if first is None else first
            leaders += [i] if first is None else []
        assert {r["id"]: r["leader"] for r in vectors.leader_clusters(df, 0.85, chunk=chunk).collect()} == lead


def test_resolve_loses_no_link(spark):
    rng = random.Random(3)
    names = ["rajesh kumar", "meena shah", "anil verma", "sunita patil"]
    rows = [(f"e{i:03d}", rng.choice(["name", "organization", "phone"]), "".join(c * rng.choice([1, 1, 1, 1, 1, 2]) for c in rng.choice(names))) for i in range(300)] + [("e900", "name", None)]
    df = spark.createDataFrame(rows, "id string, type string, normalized string")
    pairs = df.alias("x").join(df.alias("y"), F.col("x.id") < F.col("y.id")).where(resolve.similarity_score("x", "y") >= 0.85).select("x.id", "y.id").collect()
    parent = {i: i for i, *_ in rows}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert len(pairs) > 100
    assert {r["id"]: r["cluster"] for r in resolve.resolve(df).collect()} == {i: root(i) for i in parent}


def test_shared_contacts_are_stars(spark):
    rows = [(f"p{i:02d}", "person", f"n{i}", "9000000001", None, None, None, None) for i in range(20)] + [("q", "person", "q", "9000000002", None, None, None, None)]
    out = resolve.relations(spark.createDataFrame(rows, "id string, type string, name string, phone string, email string, address string, company string, account string")).collect()
    assert sorted((r["a"], r["b"]) for r in out) == [("p00", f"p{i:02d}") for i in range(1, 20)]


def test_context_raises_the_score(spark):
    df = spark.createDataFrame([("a", "name", "rajesh kumar", "call him at home"), ("b", "name", "rajesh kumarr", "call him at homes"), ("c", "name", "rajesh kumarr", None)], "id string, type string, normalized string, context string")
    score = lambda i, j: df.where(F.col("id") == i).alias("x").crossJoin(df.where(F.col("id") == j).alias("y")).select(resolve.similarity_score("x", "y", contexts=True)).first()[0]
    assert abs(score("a", "b") - score("a", "c") - 0.1) < 1e-9


def test_long_paths_are_found(spark):
    edges = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(25)], "a string, b string")
    assert len(graph.shortest_path(edges, "n000", "n025").first()["path"]) == 26
    assert graph.shortest_path(edges, "n000", "zz").count() == 0


def test_possessives_relate(spark):
    texts = spark.createDataFrame([(1, "Asha's vehicle and Ravi's son, but Kiran's dog")], "doc_id int, text string")
    known = spark.createDataFrame([(1, "Asha"), (1, "ravi"), (1, "kiran")], "doc int, entity string")
    got = {(r["source"], r["target"], r["type"]) for r in graph.text_relations(texts, known).collect()}
    assert got == {("asha", "asha", "ownership"), ("ravi", "ravi", "family")}


def test_rules_ignore_and_flag(spark):
    df = spark.createDataFrame([(1, "x", 5), (2, "x", 50), (3, None, 50), (4, "skip", 50)], "id int, s string, n int")
    rules = [patterns.Rule("big", (("n", "greaterThan", 10),)), patterns.Rule("named", (("s", "exists", None), ("n", "lessThan", 10)), "alert", "high"), patterns.Rule("no", (("s", "equals", "SKIP"),), "ignore")]
    assert sorted(map(tuple, patterns.apply_rules(df, rules, "id").collect())) == [(1, "named", "alert", "high"), (2, "big", "flag", "medium"), (3, "big", "flag", "medium")]


def test_profile_counts_every_value(spark):
    df = spark.createDataFrame([(1, "a"), (2, ""), (2, None), (None, "null"), (3, "a")], "k int, v string")
    got = {r["field"]: tuple(r)[2:] for r in profile.profile(df, "t").collect()}
    assert got == {"k": (4, 1, 4, 5), "v": (3, 2, 3, 5)}
    assert {tuple(r) for r in profile.profile(df.limit(0), "t").collect()} == {("t", "k", 0, 0, 0, 0), ("t", "v", 0, 0, 0, 0)}


def test_endpoints_are_fetched_by_tasks(spark):
    urls = spark.createDataFrame([(f"u{i}",) for i in range(9)] + [("u1",), (None,)], "url string")
    out = web.fetch_all(urls, lambda u, p: json.dumps([{"u": u}, {"u": u + "x"}]), parallel=3, per_minute=3000)
    assert sorted(r["record_json"] for r in out.collect()) == sorted(json.dumps({"u": f"u{i}{x}"}) for i in range(9) for x in ("", "x"))


def test_both_sides_of_a_keyword(spark):
    docs = spark.createDataFrame([(1, "Asha Rao living in Pune, 9000000001. Ravi is brother of Asha Rao"), (2, "")], "doc_id int, text string")
    parties = spark.createDataFrame([(1, "name", "Asha Rao"), (1, "location", "Pune"), (1, "name", "Ravi"), (1, "phone", "9000000001")], "doc int, kind string, value string")
    got = {(r["source"], r["target"], r["type"]) for r in extract.relationships(docs, parties).collect()}
    assert {("asha rao", "pune", "location"), ("asha rao", "9000000001", "contact")} <= got


def test_a_cluster_must_name_its_folder():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError):
        shared.shared_dir(Session())


def test_extraction_tries_only_the_wanted_types(spark):
    """The same rows as all types give, without the patterns of the others; a model's entities are chosen as well."""
    from quarry.plans import assist, load

    docs = spark.createDataFrame([(1, "Mail A@b.org or a@B.org, call 9000000001"), (2, None), (3, "nothing"), (4, "x@y.in 10.0.0.1")], "doc_id long, text string")
    want = sorted(map(tuple, assist.extracted(docs).where("type = 'email'").collect()))
    assert [r[:3] for r in want] == [(1, "email", "a@b.org"), (4, "email", "x@y.in")]
    assert sorted(map(tuple, assist.extracted(docs, kinds=["email"]).collect())) == want
    said = lambda prompt: json.dumps({"entities": [{"type": t, "value": t[0], "confidence": 1} for t in ("name", "email")]}) if "nothing" in prompt else ""
    assert sorted(map(tuple, assist.extracted(docs, said, kinds=["email"]).collect())) == sorted([*want, (3, "email", "e", 1.0)])
    plan = load()[0]["n08_extracted"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1
