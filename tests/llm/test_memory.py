"""The language model's memory of repeated segments, against plain code, and what the model gains on held-out text."""

import collections
import math
import zlib

import numpy as np
import pytest

from quarry.llm import attention_lm, lm_score
from quarry.llm.attention_lm import SLOTS, AttentionLM


def test_segments_depend_on_their_text_alone():
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, SLOTS, n) for n in (1, 3, 8, 9, 500, 2000, 1, 700)]
    texts += [texts[4], np.concatenate([texts[7], texts[5]])]
    lengths = np.array([len(x) for x in texts])
    start, context, content, cuts = lm_score.segments(np.concatenate(texts), lengths)
    assert cuts.sum() == len(start) and (cuts >= 1).all() and cuts[5] > 5
    first, at = np.cumsum(lengths) - lengths, 0
    for i, x in enumerate(texts):
        own = [(int(s - first[i]), int(c), int(d)) for s, c, d in zip(start[at : at + cuts[i]], context[at : at + cuts[i]], content[at : at + cuts[i]], strict=True)]
        alone = list(zip(*(v.tolist() for v in lm_score.segments(x, np.array([len(x)]))[:3]), strict=True))
        assert own == [tuple(v) for v in alone] and own[0][:2] == (0, 0)
        at += cuts[i]
    # what stands before decides nothing beyond the first cut
    tail = [d for _, c, d in own if c][-3:]
    assert tail == [d for _, c, d in zip(*(v.tolist() for v in lm_score.segments(texts[5], np.array([2000]))[:3]), strict=True) if c][-3:]


def test_score_end_to_end_equals_plain_code(spark, monkeypatch):
    models, fit = [], AttentionLM.fit
    monkeypatch.setattr(AttentionLM, "fit", lambda self, slots: fit(self, slots, steps=3) and models.append(self))
    rng = np.random.default_rng(2)
    words = [f"{a}{b}" for a in ("stone", "river", "unbelievably", "glass") for b in ("", "x", "ing", "9")]
    texts = {i: " ".join(rng.choice(words, rng.integers(1, 300))) for i in range(30)}
    texts |= {100 + i: texts[i] for i in range(0, 20, 2)} | {200: None, 201: "", 202: " ".join(rng.choice(words, 9000)), 203: texts[4] + " tail"}
    kept = []
    code = lm_score.make_coder
    monkeypatch.setattr(lm_score, "make_coder", lambda *a: kept.append(code(*a)) or kept[-1])
    got = {r["doc_id"]: r for r in lm_score.lm_score(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)).collect()}
    coder, model = kept[0][0], models[0]
    enc = lm_score.encoder(lm_score.VOCABULARY)
    slots, within, cut = {}, {}, {}
    for i, x in texts.items():
        ids = np.frombuffer(enc.encode((x or "").lower()), "<u4")
        slots[i], within[i] = np.append(coder.slot_of[ids], coder.end), coder.within[ids].sum()
        s, c, d, _ = lm_score.segments(slots[i], np.array([len(slots[i])]))
        cut[i] = list(zip(s.tolist(), c.tolist(), d.tolist(), strict=True))
    memory = collections.defaultdict(collections.Counter)
    for i in texts:
        if zlib.crc32(str(i).encode()) % 10:
            for _, c, d in cut[i]:
                memory[c][d] += 1
    raised = 0
    for i in texts:
        each = model.score(slots[i], np.array([len(slots[i])]), coder.end)
        total = within[i]
        for k, (s, c, d) in enumerate(cut[i]):
            p = each[s : cut[i][k + 1][0] if k + 1 < len(cut[i]) else None].sum()
            if c in memory:
                raised += memory[c][d] > 1
                q = (max(memory[c][d] - 1, 0) + len(memory[c]) * 10**p) / sum(memory[c].values())
                p = math.log10(q) if q > 0 else p + math.log10(len(memory[c]) / sum(memory[c].values()))
            total += p
        assert abs(got[i]["score"] - total) < 1e-3 * max(1, abs(total)), i
    assert raised > 10


def test_gains_on_held_out_text_and_tells_copies_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    out = lm_score.lm_score(docs).toPandas()
    held = out[out["held_out"]]
    assert held["score"].sum() > 0.95 * held["base_score"].sum()
    # documents that occur twice in what the model learns from score far above those that occur once
    texts = docs.toPandas().merge(out, on="doc_id")
    learnt = texts[~texts["held_out"] & (texts["n_tokens"] > 30)]
    times = learnt.groupby("text")["doc_id"].transform("count")
    per_token = learnt["score"] / learnt["n_tokens"]
    assert (per_token[times == 2] > per_token[times == 1].quantile(0.9)).mean() > 0.9


def test_attention_gains_over_counts_of_adjacent_subwords(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    held = lambda: lm_score.lm_score(docs).where("held_out").agg({"score": "sum"}).first()[0]
    whole, start = held(), AttentionLM.start

    def without(pairs, *a, **b):
        model = start(pairs, *a, **b)
        model.out[:] = 0
        return model

    monkeypatch.setattr(AttentionLM, "start", without)
    monkeypatch.setattr(AttentionLM, "fit", lambda self, slots: [])
    assert whole > 0.97 * held()


@pytest.mark.parametrize("least", [attention_lm.TASK_SUBWORDS, 5000])
def test_gradient_steps_see_every_text(spark, monkeypatch, least):
    """What only one short text of thousands holds is learnt too, by one task and by several whose models are averaged."""
    monkeypatch.setattr(attention_lm, "TASK_SUBWORDS", least)
    model, rest, coders, start, fit, code = [], [], [], AttentionLM.start, AttentionLM.fit, lm_score.make_coder
    monkeypatch.setattr(AttentionLM, "start", lambda *a: model.append(start(*a)) or rest.append(model[0].rest.copy()) or model[0])
    losses = []
    monkeypatch.setattr(AttentionLM, "fit", lambda self, texts: losses.extend(fit(self, texts)))
    monkeypatch.setattr(lm_score, "make_coder", lambda *a: coders.append(code(*a)) or coders[0])
    enc = lm_score.encoder(lm_score.VOCABULARY)
    rare = [chr(a) + chr(b) for a in range(97, 123) for b in range(97, 123)]
    texts = {i: f"river glass {rare[i // 13]} stone" if i % 13 == 5 else "river stone glass" for i in range(13 * len(rare))}
    lm_score.lm_score(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(8)).count()
    learnt = [x for i, x in texts.items() if zlib.crc32(str(i).encode()) % 10]
    seen = {int(coders[0][0].slot_of[k]) for x in learnt for k in np.frombuffer(enc.encode(x), "<u4")}
    assert len(seen) > 300 and len(losses) == (1 if least > 5000 else len(attention_lm.ROUNDS))
    assert [s for s in seen if (model[0].rest[s] == rest[0][s]).all()] == []
