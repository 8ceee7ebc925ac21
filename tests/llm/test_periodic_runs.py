"""Periodic runs against brute force."""

import random

import numpy as np
import pytest

from quarry.llm import periodic_runs as pr


def brute(words, min_length=12, min_exp=2):
    """Every stretch, its smallest period and whether a neighbour extends it, by definition."""
    n, out = len(words), []
    for q in range(1, n // min_exp + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            stretch = words[i : j + q]
            if len(stretch) >= max(min_length, min_exp * q) and not any(all(stretch[k] == stretch[k + p] for k in range(len(stretch) - p)) for p in range(1, q)):
                out.append((i, len(stretch), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def left(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def samples():
    rng = random.Random(5)
    out = [[], ["a"], ["a"] * 11, ["a"] * 12, ["a"] * 50, ["a", "b"] * 6, ["a", "b"] * 20 + ["a"], list("abcabcabcabc"), list("abcdefabcdef"), list("abcdefgabcdefg") * 3]
    for _ in range(60):
        out.append([rng.choice("ab") for _ in range(rng.randrange(60))])
        block = [f"w{rng.randrange(6)}" for _ in range(rng.randrange(1, 40))]
        out.append([f"x{k}" for k in range(rng.randrange(20))] + block * rng.randrange(1, 5) + block[: rng.randrange(len(block))] + ["y", "z"])
    return out


def test_scan(monkeypatch):
    for cells in (1 << 20, 64):
        monkeypatch.setattr(pr, "CELLS", cells)
        for words in samples():
            names = {w: k for k, w in enumerate(dict.fromkeys(words))}
            ids = np.array([names[w] for w in words], np.int64)
            for min_length, min_exp in ((12, 2), (1, 2), (5, 3)):
                got = pr.least_periods(pr.scan(ids, 1, len(ids) // min_exp + 1, min_length, min_exp))
                assert got == brute(words, min_length, min_exp), words


@pytest.mark.parametrize("n", [0, 1, 2, 13, 1000])
def test_shares_cover_all_lags(n):
    for shares in (1, 3, 7):
        cuts = pr.lag_cuts(n, shares)
        assert cuts[0] == 1 and cuts[-1] == n // 2 + 1 and cuts == sorted(cuts) and len(cuts) == shares + 1


def test_many_distinct_words():
    ids = np.concatenate([np.arange(70_000), np.arange(60_000, 70_000)])
    assert pr.least_periods(pr.scan(ids, 9_990, 10_010)) == [(60_000, 20_000, 10_000)]


def test_documents(spark):
    texts = {k: " ".join(w) for k, w in enumerate(samples())}
    texts[1000] = "\n ".join(["une", "é\x0b", "x y"] * 9)
    rows = [(k, x, k) for k, x in texts.items()] + [(None, "b " * 30, 1), (None, "b " * 30, 1), (7, None, 2), (7, " \t ", 3), (8, "c d " * 300, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs long").repartition(3)
    want = sorted(((i if i is not None else -1, brute(w := (x or "").replace(" ", "~").split()), left(w, brute(w)).replace("~", " ")) for i, x, _ in rows), key=str)
    for settings in ({}, {"long_bytes": 40, "share_cells": 200}):
        got = pr.periodic_runs(docs, **settings).collect()
        assert sorted(((r[0] if r[0] is not None else -1, [tuple(x) for x in r[1]], r[2]) for r in got), key=str) == want
    assert pr.periodic_runs(docs.limit(0)).count() == 0
