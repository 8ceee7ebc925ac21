"""The methods named do the work: results change when a step is taken out, and agree with plain code."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import common, jaccard, langid, mixing, packing, quality

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


def test_crossover_reaches_the_result(real):
    sizes = [r["length"] for r in packing.pieces(real).collect() if r["length"] < packing.CAPACITY]
    least = -(-sum(sizes) // packing.CAPACITY)
    started = packing.evolve(sizes, [], 1, children=0)
    ended = packing.evolve(sizes, [], 1)
    assert len(started) > least and len(ended) < len(started)
    rng, seen = random.Random(4), []
    two = [packing.best_fit(rng.sample(range(len(sizes)), len(sizes)), sizes, packing.CAPACITY) for _ in range(2)]
    child = {tuple(sorted(b)) for b in packing.crossover(two[0], two[1], sizes, packing.CAPACITY, rng)}
    seen = [b for b in two[1] if sum(sizes[i] for i in b) >= 0.98 * packing.CAPACITY]
    assert sum(any(set(b) <= set(c) for c in child) for b in seen[:200]) >= len(seen[:200]) // 4


def test_inclusion_odds_follow_size(spark):
    docs = spark.range(6000).selectExpr("id as doc_id", "repeat('w ', case when id % 2 = 0 then 10 else 40 end) as text", "concat('s', id % 3) as source")
    got = mixing.mix(docs).toPandas()
    part = got[(got["target"] / got["source_size"]) % 1 > 0.05]
    share = lambda size: (part[part["size"] == size]["taken"] // size - (part[part["size"] == size]["target"] // part[part["size"] == size]["source_size"])).mean()
    assert share(40) > 1.1 * share(10)
    plain = {}
    for r in part.itertuples():
        u = (int(__import__("hashlib").md5(str(r.doc_id).encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        plain[r.doc_id] = u / (1 - u) / min(8, max(1 / 8, r.size / 25))
    for _, rows in part.groupby("target"):
        extra = rows["taken"] / rows["size"] > rows["target"] // rows["source_size"]
        odds = np.array([plain[i] for i in rows["doc_id"]])
        # but for the one exchanged at the end, all that are taken come before all that are not
        assert (odds[extra] > np.partition(odds[~extra], 1)[1]).sum() <= 1


def test_language_equals_plain_code(spark):
    rng = random.Random(3)
    words = {"aa": ["ab", "ba", "abba", "Zebra"], "bb": ["xy", "yx", "yxxy", "ünd"], "cc": ["klm", "mlk"]}
    rows = [(i, " ".join(rng.choice(words[x]) for _ in range(rng.randrange(1, 9))), x) for i, x in enumerate(rng.choices(sorted(words), k=90))]
    rows += [(100, "½ Ⅷ ² 12", "aa"), (101, None, "aa"), (102, "ab xy", None), (103, "", "bb")]

    def grams(text):
        codes, out = [ord(c) for c in text.lower()], []
        for n in (1, 2, 3):
            for i in range(len(codes) - n + 1):
                key = codes[i] * 2654435761 & 0xFFFFFFFF
                for k in range(2, n + 1):
                    key = (key * 0x85EBCA6B & 0xFFFFFFFF) ^ ((codes[i + k - 1] * 2654435761 + k) & 0xFFFFFFFF)
                key ^= key >> 15
                out.append(((key * 0x9E3779B1 & 0xFFFFFFFF) >> 17) & (langid.BUCKETS - 1))
        return out

    import zlib

    counts, docs_of = collections.defaultdict(collections.Counter), collections.Counter()
    for i, text, lang in rows:
        if zlib.crc32(str(i).encode()) % 3 != 1 and text is not None and lang is not None:
            counts[lang].update(grams(text))
            docs_of[lang] += 1
    got = {r["doc_id"]: r for r in langid.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)).collect()}
    assert got[100]["lang_pred"] == "und" and got[101]["lang_pred"] == "und" and got[103]["score"] == 0
    for i, text, _ in rows:
        if text and any(c.isalpha() for c in text):
            total = {x: math.log(docs_of[x] / sum(docs_of.values())) + sum(math.log((counts[x][g] + 0.5) / (sum(counts[x].values()) + 0.5 * langid.BUCKETS)) for g in grams(text)) for x in sorted(counts)}
            best = max(total, key=total.get)
            assert got[i]["lang_pred"] == best or max(total.values()) - total[got[i]["lang_pred"]] < 1e-3
            assert abs(got[i]["score"] - 1 / sum(math.exp(v - total[best]) for v in total.values())) < 1e-3


def test_many_languages(spark, monkeypatch):
    rows = [(i, f"text {i} {'x' * (i % 7)}", f"l{i}") for i in range(40)] + [(90, "", "empty"), (91, None, "l1"), (92, "7", "l2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = sorted(langid.language_id(df).collect())
    assert sum(r["lang_pred"] == "und" for r in whole) == 3
    monkeypatch.setattr(langid, "LANGS", 7)
    assert len(langid.train(df)) == 6
    parts = sorted(langid.language_id(df).collect())
    assert [r[:3] for r in parts] == [r[:3] for r in whole] and all(abs(x["score"] - y["score"]) < 1e-9 for x, y in zip(parts, whole, strict=True))


def test_forest_equals_plain_walk_and_threshold(spark, real):
    rng = np.random.default_rng(5)
    points = rng.normal(0, 1, (300, 4))
    forest = quality.Forest.fit(points, trees=20)
    inner = forest.feature.shape[1]

    def walk(x):
        total = 0.0
        for t in range(20):
            node = 0
            while node < inner:
                node = 2 * node + (2 if x[forest.feature[t, node]] > forest.split[t, node] else 1)
            total += forest.path[t, node - inner]
        n = forest.subsample
        return 2 ** (-(total / 20) / (2 * (math.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n))

    assert np.allclose(forest.score(points), [walk(x) for x in points])
    labels = spark.read.parquet(f"{DATA}/labels.parquet").cache()
    learn, ask = labels.where("crc32(cast(doc_id as string)) % 2 = 0"), labels.where("crc32(cast(doc_id as string)) % 2 = 1")
    out = quality.quality_rules(real, learn).join(ask.select("doc_id", "quality"), "doc_id").where("not base_failed").toPandas()
    good, bad = out[out["quality"] == 1], out[out["quality"] == 0]
    # rows outside the fit: nearly all good ones stay, and of the bad ones a larger share goes
    assert good["kept"].mean() > 0.9 and (~bad["kept"]).mean() > (~good["kept"]).mean()


def test_sets_with_one_short_hash_keep_apart(spark):
    rows = [(1, 1, 7, 1), (2, 1, 7, 1), (3, 1, 7, 2), (4, 1, 8, 3), (5, 0, 7, 9)]
    out = {r["doc_id"]: r["nid"] for r in jaccard._told_apart(spark.createDataFrame(rows, "doc_id long, n long, nid long, check long")).collect()}
    assert out[1] == out[2] != out[3] and out[4] == 8 and out[3] != 7


def test_hot_keys_are_few():
    for total in (1, 10, 1000, 5 * 10**6, 10**9, 10**11, 10**13):
        assert total / common.hot_from(total) <= common.HOT_KEYS and common.hot_from(total) >= 2
    assert common.hot_from(10**11) <= 10**6


def test_large_group_of_copies_in_parts_and_leaves(spark, monkeypatch):
    """One group of many near copies beside pairs; whole, and with sets held in many tasks and blocks cut into leaves."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    texts = []
    for i in range(90):
        x = list(base)
        x[rng.randrange(120)] = f"n{i}"
        texts.append(" ".join(x))
    for i in range(40):
        own = [f"v{rng.randrange(300)}" for _ in range(60)]
        texts += [" ".join(own), " ".join(own[:-2] + [f"z{i}"])]
    # texts that share a rare beginning and nothing else
    texts += ["same rare words come first " + " ".join(f"u{i}x{k}" for k in range(12)) for i in range(30)]
    sets = [frozenset(zip(*(x.split()[k:] for k in range(5)), strict=False)) for x in texts]
    parent = list(range(len(texts)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    want = {i: root(i) for i in range(len(texts))}
    assert len(set(want.values())) < len(texts) - 80
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for part, leaf, turns in ((256, 512, 2), (3, 4, 0)):
        monkeypatch.setattr(jaccard, "PART", part)
        monkeypatch.setattr(jaccard, "LEAF", leaf)
        monkeypatch.setattr(jaccard, "REPRESENTATIVE_TURNS", turns)
        assert {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(df).collect()} == want


def test_quality_learns_from_every_labelled_row(spark, monkeypatch):
    """Draws are of all rows, in proportion to their weights; the threshold counts them all."""
    rows = [(i, i, 0, 0, 0, 0, 1, i % 2 == 0) for i in range(6000)]
    df = spark.createDataFrame(rows, "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, good boolean")
    got = quality.draw(df.repartition(7), {True: 1.0, False: 0.1}).select("tree", "n_words").collect()
    again = quality.draw(df.repartition(3), {True: 1.0, False: 0.1}).select("tree", "n_words").collect()
    assert sorted(got) == sorted(again) and len(got) == 100 * 256 == len(set(got))
    good = sum(r["n_words"] % 2 == 0 for r in got) / len(got)
    assert 0.89 < good < 0.93 and len({r["n_words"] for r in got}) > 3500
    good, bad = np.array([10, 85, 4, 1, 0]), np.array([0, 1, 1, 3, 45])
    assert quality.calibrate(np.array([1, 2, 3, 4, 5]), good, bad) == 3 / quality.STEPS
    # more labelled rows than a bounded fit would take
    texts = [(i, " ".join(f"w{(i * 7 + k) % 97}{k}" for k in range(55)) + (" # $ % *" * 10 if i % 40 == 0 else "")) for i in range(24_000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    seen = []
    plain = quality.calibrate
    monkeypatch.setattr(quality, "calibrate", lambda bins, good, bad: seen.append((int(good.sum()), int(bad.sum()))) or plain(bins, good, bad))
    out = quality.quality_rules(docs, docs.select("doc_id", (F.col("doc_id") % 40 != 0).cast("int").alias("quality")))
    assert out.where("kept and doc_id % 40 = 0").count() == 0 and out.where("kept").count() > 22_900
    assert seen == [(23_400, 600)]
