"""Near strings against brute force: no pair lost, none twice, classes as those of all pairs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import near, resolve


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.fixture(scope="module")
def words():
    rng = random.Random(9)
    seeds = ["customer#000000017", "customer#000000018", "customer#000012345", "aaaaaaaaaa", "abababababab", "12 lake road pune", "ab", "abc", "a", "", "éàü road", "general trading company limited"]
    out = set(seeds) | {f"customer#{k:09}" for k in range(40)}
    for _ in range(150):
        w = list(rng.choice(seeds))
        for _ in range(rng.randrange(1, 5)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randrange(2)] = rng.choice(["", "a", "0", "x", " "])
        out.add("".join(w))
    return sorted(out)


def pairs_of(words, t):
    return {(i, j): 1 - edits(a, b) / max(len(a), len(b)) for (i, a), (j, b) in itertools.combinations(enumerate(words), 2) if 1 - edits(a, b) / max(len(a), len(b)) >= t - 1e-9}


def roots(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in links:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("t, cell", [(0.6, 1000), (0.8, 1000), (0.85, 5), (0.92, 3)])
def test_pairs_and_classes(spark, words, monkeypatch, t, cell):
    monkeypatch.setattr(near, "CELL", cell)
    monkeypatch.setattr(near, "FREQUENT", 30)
    nodes = spark.createDataFrame(list(enumerate(words)), "id int, v string").withColumn("kind", F.lit("k")).repartition(3)
    want = pairs_of(words, t)
    got = near.near_pairs(nodes, t).collect()
    assert len(got) == len(want) and {(min(r["a"], r["b"]), max(r["a"], r["b"])): pytest.approx(r["similarity"]) for r in got} == want
    classes = {r["id"]: r["component"] for r in near.near_classes(nodes, t).collect()}
    assert [classes.get(i, i) for i in range(len(words))] == roots(len(words), want)


def test_kinds_and_conditions(spark):
    nodes = spark.createDataFrame([(1, "a", "lake road", 1), (2, "a", "lake roads", 2), (3, "b", "lake roads", 1), (4, "a", "lake roaf", 1)], "id int, kind string, v string, side int")
    got = near.near_pairs(nodes, 0.8, F.expr("x.side <> y.side")).collect()
    assert sorted(sorted((r["a"], r["b"])) for r in got) == [[1, 2], [2, 4]]


def test_a_dense_group_is_not_compared_pair_by_pair(spark):
    """5,000 numbered names are one class: what compares them grows with the names, not with their pairs."""
    names = spark.range(5_000).select(F.format_string("Customer#%09d", "id").alias("normalized"), F.lit("name").alias("type"), F.col("id"), F.lit(0.5).alias("confidence"))
    out = resolve.merge(names).collect()
    assert [(r["id"], r["merged_from"]) for r in out] == [(0, 5_000)]


def test_merge_by_case_type_and_null(spark):
    rows = [(1, "name", "Asha Rao", 0.1), (2, "name", "ASHA RAO", 0.9), (3, "org", "Asha Rao", 0.2), (4, "org", "zzz", 0.3), (5, None, "asha rao", 0.4), (6, "name", None, 0.5), (7, "name", None, 0.6), (8, "name", "Asha Raoo", 0.7), (9, None, "zzz", 0.8)]
    got = {r["id"]: (r["aliases"], r["confidence"], r["merged_from"]) for r in resolve.merge(spark.createDataFrame(rows, "id int, type string, normalized string, confidence double")).collect()}
    assert got == {1: (["ASHA RAO", "Asha Rao", "Asha Raoo"], 0.9, 4), 4: (["zzz"], 0.3, 1), 5: (["asha rao"], 0.4, 1), 6: ([], 0.5, 1), 7: ([], 0.6, 1), 9: (["zzz"], 0.8, 1)}


@pytest.mark.parametrize("t", [0.25, 0.55, 0.7, 0.85])
def test_resolve_at_any_threshold(spark, t):
    rng = random.Random(3)
    names = ["rajesh kumar", "rajesh kumarr", "rajesh kumaar", "rajesh kumar", "Rajesh Kumar", "meena shah", "mena shah", "meenas shah", "asha", "asho", "lotus", "latis"]
    rows = [(f"{k:02}", rng.choice(["name", "phone"]), rng.choice(names)) for k in range(40)]
    df = spark.createDataFrame(rows, "id string, type string, normalized string")
    scored = df.alias("x").join(df.alias("y"), F.col("x.id") < F.col("y.id")).where(resolve.similarity_score("x", "y") >= t - 1e-9).select("x.id", "y.id").collect()
    want = roots(len(rows), [(int(a), int(b)) for a, b in scored])
    assert {int(r["id"]): int(r["cluster"]) for r in resolve.resolve(df, t).collect()} == dict(enumerate(want))


def test_aliases_of_documents_as_their_sql(spark, tmp_path):
    """An accent costs two edits of bytes; words part at white space but not at a vertical tab."""
    import duckdb

    from quarry.plans import load

    texts = ["menteau mentêeau", "abcdefghijklmn abcdefgêhijklmn", "abcdefgh Abcdefghi", "abcdefgh\u000babcdefghi abcdefgh", "istanbuls İstanbuls istanbulis", "abcdefgh  abcdefg", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    queries, sql = load()
    name = "c34_aliases_documents"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(f"select doc, normalized, alias from ({sql[name]})").fetchall())
    assert sorted(map(tuple, queries[name](spark, str(tmp_path)).select("doc", "normalized", "alias").collect())) == want
    assert len(want) >= 3


def test_aliases_of_longest_words_send_few_words(spark, tmp_path):
    """A document may have several rows; only words as long as the longest plain one of their row, or nearly so, go on."""
    import duckdb

    from quarry.plans import load

    rows = [(1, "short words and abcdefghijklmn"), (1, "Abcdefghijklmno here"), (1, "abcdefghijklm!"), (1, "12 34"), (2, "abcdefgh ABCDEFGHI"), (2, "abcdefgh ABCDEFGHI"), (None, "abcdefgh abcdefghi"), (3, "123 456")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    queries, sql = load()
    name = "c34_aliases_documents"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(f"select doc, normalized, alias from ({sql[name]})").fetchall())
    df = queries[name](spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == want and len(want) >= 3
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "gram" not in plan and "split" not in plan
