"""Very many terms, and words that are nearly an entity, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import extract, terms


def test_terms_as_contains_finds_them(spark, monkeypatch):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abé ") for _ in range(rng.randrange(1, 5))) for _ in range(120)} - {""})
    texts = ["".join(rng.choice("abé x\n") for _ in range(rng.randrange(40))) for _ in range(60)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: r["t"] for r in df.select("id", terms.held_terms(spark, F.col("text"), words).alias("t")).collect()}
    assert got == {i: None if x is None else [w for w in words if w in x] for i, x in enumerate(texts)}
    for bad in ([], [""], ["a", "a"]):
        with pytest.raises(ValueError):
            terms.held_terms(spark, F.col("text"), bad)

    monkeypatch.setattr(terms, "MOST_TERMS", 50)
    recs = spark.createDataFrame([("t", str(i), [("f", x), ("g", "B\0a")]) for i, x in enumerate(texts)], "table_name string, record_id string, cells array<struct<field:string,value:string>>")
    listed = spark.createDataFrame([(k, w.upper()) for k, w in enumerate(words)] + [(0, words[0]), (999, None), (998, "")], "id int, term string")
    want = {("t", str(i), k) for i, x in enumerate(texts) for k, w in enumerate(words) if w in (x or "") or w in "b a"}
    found = [tuple(r) for r in terms.watch(recs, listed).collect()]
    assert len(found) == len(set(found)) and set(found) == want
    assert terms.watch(recs, listed.limit(0)).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_aliases_of_long_texts(spark):
    rng = random.Random(6)
    docs, known, want = [], [], set()
    for d in range(4):
        stems = ["".join(rng.choice("abcdef") for _ in range(rng.randrange(5, 14))) for _ in range(12)]
        words = []
        for _ in range(300):
            w = list(rng.choice(stems))
            w[rng.randrange(len(w))] = rng.choice("abcxyz")
            words.append("".join(w) if rng.random() < 0.7 else "".join(w).upper())
        names = stems[:6] + [words[0], "Zed Zed"]
        docs.append((d, ", ".join(words)))
        known += [(d, n) for n in names]
        for n in names:
            for w in set(words):
                if len(w) > 2 and w.lower() != n.lower() and 1 - edits(w.lower(), n.lower()) / max(len(w), len(n)) >= 0.85 - 1e-9:
                    want.add((d, n, w))
    got = extract.fuzzy_aliases(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(known, "doc int, normalized string")).collect()
    assert want and len(got) == len(set(got)) and {tuple(r) for r in got} == want
