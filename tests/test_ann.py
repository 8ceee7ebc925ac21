"""The inverted-file index and leader clusters, against brute force."""

import os

import numpy as np
import pytest

from quarry.operators import ann, vectors

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 16))
    v = centres[rng.integers(0, 40, 1500)] + 0.35 * rng.standard_normal((1500, 16))
    v[:700] = centres[0] + 0.2 * rng.standard_normal((700, 16))  # one cell holds half of all rows
    v[20:40], v[50] = v[20], 0
    return v


def unit(v):
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def frame(spark, v):
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(9000, None), (None, v[0].tolist())]
    return spark.createDataFrame(rows, "id long, vector array<double>").repartition(4)


def test_recall_of_searches_and_pairs(spark, cloud, monkeypatch):
    monkeypatch.setattr(ann, "PART_ROWS", 100)
    df, u = frame(spark, cloud), unit(cloud)
    index = ann.build(df, recall=0.95)
    assert index.rows.count() == len(cloud) and 1 <= index.probes < len(index.centroids)
    asked = df.where("id % 100 = 0").withColumnRenamed("id", "query")
    got = ann.search(index, asked, 5).collect()
    s = u @ u.T
    hits = 0
    for q in range(0, 1500, 100):
        mine = sorted((r for r in got if r["query"] == q), key=lambda r: -r["score"])
        assert len(mine) == 5 and all(abs(s[q, r["id"]] - r["score"]) < 1e-9 for r in mine)
        hits += sum(s[q, r["id"]] >= np.sort(s[q])[-5] - 1e-9 for r in mine)
    assert hits >= 0.9 * 75
    i, j = np.nonzero(np.triu(s >= 0.95, 1))
    want = set(zip(i.tolist(), j.tolist(), strict=True))
    pairs = [(r["a"], r["b"]) for r in ann.near_pairs(index, 0.95).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) <= want and len(pairs) >= 0.9 * len(want)
    assert {(r["a"], r["b"]) for r in ann.near_pairs(index, 0.95, probes=len(index.centroids)).collect()} == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_recall_on_the_tables(spark):
    from quarry.plans import load

    queries, _ = load()
    exact = {(r["query"], r["id"]) for r in queries["j03_nearest_of_each"](spark, DATA).collect()}
    found = {(r["query"], r["id"]) for r in queries["j03_nearest_by_index"](spark, DATA).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_no_vectors(spark):
    none = spark.createDataFrame([], "id long, vector array<double>")
    index = ann.build(none)
    assert ann.search(index, none.withColumnRenamed("id", "query")).count() == 0 and ann.near_pairs(index, 0.5).count() == 0


@pytest.mark.parametrize("threshold", [0.6, 0.95])
def test_leaders_of_dense_groups(spark, cloud, threshold):
    s, lead, leaders = unit(cloud) @ unit(cloud).T, {}, []
    for i in range(len(cloud)):
        first = next((k for k in leaders if s[k, i] >= threshold), None)
        lead[i] = i if first is None else first
        leaders += [i] if first is None else []
    got = {r["id"]: r["leader"] for r in vectors.leader_clusters(frame(spark, cloud), threshold).collect()}
    assert got == {**lead, 9000: 9000}
