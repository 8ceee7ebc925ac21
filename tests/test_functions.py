"""Properties of text functions, graphs and resolution against plain Python."""

import itertools
import random

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import graph as G


def _phonetic(s):
    s, out, i = s.lower(), s.lower()[:1], 1
    while i < len(s):
        if s[i : i + 2] in T.PHONETIC_PAIRS:
            out += T.PHONETIC_PAIRS[s[i : i + 2]]
            i += 2
        else:
            out += T.PHONETIC.get(s[i], "")
            i += 1
    return out


def test_phonetic(spark):
    words = ["", "a", "Bhatt", "Chaudhary", "abhishek", "sshh", "b1h", "Thakur", "shah shah", "xyz9", "tth", "éclair"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(T.phonetic(F.col("w"))).collect()
    assert [r[0] for r in got] == [_phonetic(w) for w in words]


def test_similarity_is_symmetric(spark):
    pairs = [("", ""), ("", "x"), ("Abc", "aBC"), ("kitten", "sitting"), ("a b", "a-b")]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select(T.similarity(F.col("a"), F.col("b")).alias("x"), T.similarity(F.col("b"), F.col("a")).alias("y"), T.normalized_similarity(F.col("a"), F.col("b")).alias("n")).collect():
        assert r["x"] == r["y"] and 0 <= r["x"] <= 1 and 0 <= r["n"] <= 1


def test_html(spark):
    html = "<p>a&amp;lt;b</p><script>x<y</script>&#66;&nbsp;<!-- c -->  z&#x;"
    assert spark.createDataFrame([(html,)], "h string").select(T.html_to_text(F.col("h"))).first()[0] == "a<b B z&#x;"


def test_components_and_paths(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(40):02d}", f"n{rng.randrange(40):02d}") for _ in range(30)] + [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(25)]
    parent = {x: x for x in itertools.chain(*edges)}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a string, b string")
    got = {r["id"]: r["component"] for r in G.components(df).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}
    path = G.shortest_path(df, "p000", "p010").first()["path"]
    assert path == [f"p{i:03d}" for i in range(11)]
    assert not G.shortest_path(df, "p000", "n00").limit(1).count() or root("p000") == root("n00")


def test_empty_graph(spark):
    df = spark.createDataFrame([], "a string, b string")
    assert G.components(df).count() == 0
