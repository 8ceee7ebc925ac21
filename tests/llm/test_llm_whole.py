"""Whole inputs are used: what lies beyond a sample, a prefix or a block counts too."""

import collections
import random
import zlib

from quarry.llm import line_dedup, lm_score


def test_lm_pairs_cover_all_of_every_text(spark, monkeypatch):
    from quarry.llm.attention_lm import AttentionLM
    from quarry.llm.encode import encoder

    long = "river stone " * 40_000 + "Winter, glass " * 3
    texts = {1: long, 2: "river glass unbelievably", 3: "", 4: None, 5: long, **{i: f"stone field {'light ' * (i % 4)}" for i in range(6, 40)}}
    seen, start = [], AttentionLM.start
    monkeypatch.setattr(AttentionLM, "start", lambda pairs, *a, **b: seen.append(pairs) or start(pairs, *a, **b))
    got = lm_score.lm_score(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(texts) and all(r["score"] < 0 for r in got)

    enc, want, ids = encoder(lm_score.VOCABULARY), collections.Counter(), {}
    for i, x in texts.items():
        if zlib.crc32(str(i).encode()) % 10 == 0:
            continue
        flat = [-1, *(k for w in (x or "").lower().split() for k in memoryview(enc.encode(w)).cast("I")), -1]
        ids.update(dict.fromkeys(flat))
        want.update(zip(flat[:-1], flat[1:], strict=True))
    assert len(ids) < 2000  # each subword has a slot of its own
    assert sorted(seen[0][seen[0] > 0].tolist()) == sorted(want.values())


def test_every_repeated_run_of_lines_goes(spark):
    rng = random.Random(7)
    pool = [" ".join(f"w{k}x{j}" for j in range(n)) for k, n in enumerate([1, 1, 3, 5, 8, 12, 12, 19, 20, 25, 60, 200])]
    texts = {i: [rng.choice(pool) if rng.random() < 0.7 else f"own {i} {j}" for j in range(rng.randrange(1, 12))] for i in range(60)}
    texts |= {100: [pool[10] + " a", "one"], 101: [pool[10] + " a", "tail"], 102: [pool[10] + " a", "tail", "t2", "t3", "t4"], 103: ["x", pool[10] + " a", "tail", "t2", "t3", "t4"], 104: [pool[11] + " b"], 105: ["before", pool[11] + " b", "after"]}

    def runs(lines):
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if sum(len(x.split()) for x in lines[a:b]) >= 20:
                    yield a, b, tuple(lines[a:b])

    first, want = {}, {}
    for i in sorted(texts):
        for a, _, run in runs(texts[i]):
            first.setdefault(run, (i, a))
    for i, lines in texts.items():
        gone = {k for a, b, run in runs(lines) if first[run] < (i, a) for k in range(a, b)}
        want[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    out = line_dedup.line_dedup(spark.createDataFrame([(i, "\n".join(x)) for i, x in texts.items()], "doc_id long, text string").repartition(3))
    assert {r["doc_id"]: r["text"] for r in out.collect()} == want


def test_lines_of_repeated_ids_stay_once(spark):
    """Rows of one id with other texts are documents of their own: no line may vanish from all of them."""
    line = lambda name: " ".join(f"{name}{j}" for j in range(25))
    a, b, c, p, q, z = map(line, "abcpqz")
    rows = [(1, a), (3, f"{b}\n{c}"), (3, f"{a}\n{z}"), (5, f"{p}\n{q}"), (5, f"{z} x\n{p}"), (7, b), (7, b), (None, p)]
    out = [(r["doc_id"], r["text"]) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert (1, a) in out and (3, f"{b}\n{c}") in out and (3, z) in out and (None, p) in out
    assert out.count((7, "")) == 2
    fives = sorted(x for i, x in out if i == 5)
    assert fives in (sorted([f"{p}\n{q}", f"{z} x"]), sorted([q, f"{z} x\n{p}"]))
