"""Source divergence against exact arithmetic in plain Python."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import divergence as dv


def brute(rows, min_docs=10, top=10):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs, count, groups = collections.Counter(), collections.Counter(), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [t.translate(lower) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]
        for t in terms:
            count[lang, source, t] += 1
        for t in set(terms):
            docs[lang, t] += 1
    out = set()
    for lang in {x for x, _ in groups}:
        kept, names = [t for (x, t), n in docs.items() if x == lang and n >= min_docs], sorted(s for x, s in groups if x == lang)
        v = len(kept)

        def share(source, kept=kept, v=v, lang=lang, names=names):
            own = {t: sum(count[lang, s, t] for s in (names if source is None else [source])) for t in kept}
            return {t: 1 + 10**9 * (n + 2) // (sum(own.values()) + 2 * v) for t, n in own.items()}, own

        gap = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: share(s) for s in names}, share(None)[0]
        for s in names:
            pairs = sorted((-sum(gap(p[s][0][t], p[o][0][t]) for t in kept), o.encode(), o) for o in names if o != s)
            out |= {(lang, s, "pair", o, -x, k) for k, (x, _, o) in enumerate(pairs, 1)}
            more = sorted((-gap(p[s][0][t], q[t]), t.encode(), t) for t in kept if p[s][1][t] and p[s][0][t] > q[t])[:top]
            out |= {(lang, s, "term", t, -x, k) for k, (x, _, t) in enumerate(more, 1)}
    return out


@pytest.fixture
def rows():
    rng = random.Random(11)
    pool = [f"w{chr(97 + k)}{'é' * (k % 3)}" for k in range(26)] + ["ÉTÉ", "Zzz", "日本", "a\xa0b", "İi"]
    out = [(" ,.\n1".join(rng.choices(pool, k=rng.randrange(30))) + rng.choice(["", "x@y", "\x7f"]), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "", None])) for _ in range(300)]
    out += [(None, "en", "silent"), ("", "fr", "s1"), ("rare words", "fr", "s2"), ("12 !", "fr", None), ("x " * 5000, "en", "s1"), ("é", "de", "é"), ("é", "de", "z")]
    return out + out[:15]


def test_rows(spark, rows, monkeypatch):
    docs = spark.createDataFrame([(*r, "n", 1) for r in rows], "text string, lang string, source string, term string, value int").repartition(3)
    assert {tuple(r) for r in dv.source_divergence(docs).collect()} == brute(rows)
    got = dv.source_divergence(docs, min_docs=3, top=2).collect()
    assert {tuple(r) for r in got} == brute(rows, 3, 2) and len(got) == len({tuple(r) for r in got})


def test_tiles_and_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(dv, "TILE_TERMS", 5)
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    assert {tuple(r) for r in dv.source_divergence(docs).collect()} == brute(rows)


def test_blocks_of_sources():
    rng = np.random.default_rng(2)
    dense = rng.integers(0, 4, (7, 40)) * (rng.random((7, 40)) < 0.4)
    dense[3] = 0
    totals, v = dense.sum(axis=1) + rng.integers(0, 5, 7), 60
    csr = lambda m: (np.concatenate(([0], np.cumsum((m > 0).sum(axis=1)))), np.nonzero(m)[1], m[m > 0])
    got = dv.tile_gaps(40, csr(dense[:3]), csr(dense[3:]), totals[:3], totals[3:], v)
    share = [[1 + 10**9 * (int(c) + 2) // (int(totals[s]) + 2 * v) for c in dense[s]] for s in range(7)]
    assert got.tolist() == [[sum((p - q) ** 2 // (p + q) for p, q in zip(share[s], share[t], strict=True)) for t in range(3, 7)] for s in range(3)]
    counts = pa.table({"no": pa.array([9, 4, 9], pa.int32()), "n": [5, 6, 7]})
    assert [x.tolist() for x in dv._matrix(counts, np.array([4, 6, 9]), np.array([1, 2, 3]))] == [[0, 1, 1, 3], [2, 1, 3], [6, 5, 7]]


def test_many_sources_meet_in_blocks(spark, monkeypatch):
    rng = random.Random(4)
    out = [(" ".join(rng.choices(["aa", "bb", "cc", "dd"], k=6)), "en", f"s{k % 150}") for k in range(600)]
    assert {tuple(r) for r in dv.source_divergence(spark.createDataFrame(out, "text string, lang string, source string")).collect()} == brute(out)
    bare = [("", "xx", f"s{k}") for k in range(70)]
    assert {tuple(r) for r in dv.source_divergence(spark.createDataFrame(bare, "text string, lang string, source string")).collect()} == brute(bare)


def test_shares_are_exact():
    cases = [(0, 0, 1), (10**12, 3 * 10**15, 10**6), (2, 7, 3), (3 * 10**15, 3 * 10**15, 5)]
    for c, n, v in cases:
        assert dv.shares(np.array([c]), np.array([n]), v).tolist() == [1 + 10**9 * (c + 2) // (n + 2 * v)]


def test_equal_hashes_are_told_apart():
    terms = [b"a", b"b", b"a", b"cc", b"b", b"cc"]
    for hashed in (lambda t: 1, lambda t: len(t)):
        group, names = dv.grouped(terms, hashed)
        assert [names[k] for k in group] == terms and len(names) == len(set(names)) == 3


def test_held_counts_are_given_away(spark, rows, monkeypatch):
    monkeypatch.setattr(dv, "HELD", 7)
    counts = dv._Counts()
    out = collections.Counter()
    for text, lang, source in rows:
        counts.add([lang or ""], [source or ""], pa.array([text], pa.string()))
        if counts.held >= dv.HELD:
            for part in counts.rows():
                for k, n in zip(zip(*(pa.array(part[c]).to_pylist() for c in ("lang", "source", "term")), strict=True), pa.array(part["n"]).to_pylist(), strict=True):
                    out[k] += n
    assert sum(out.values()) > 1000 and max(out.values()) >= 5000


def test_no_documents(spark):
    assert dv.source_divergence(spark.createDataFrame([], "text string, lang string, source string, rank int")).count() == 0
