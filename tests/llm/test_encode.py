"""Words that are encoded together have the ids that the tokenizer gives them one by one."""

import random

import numpy as np

from quarry.llm import encode, lm_score
from quarry.llm.encode import encoder


def _each(enc, words):
    return [enc.cache.tokenizer.encode(w, add_special_tokens=False).ids for w in words]


def test_words_encoded_together_are_those_of_the_tokenizer(monkeypatch):
    """Latin words with every kind of piece; others, and control strings, beside them; a store of pieces that overflows."""
    monkeypatch.setattr(encode, "_MAX_PIECES", 50)
    enc, rng = encoder(lm_score.VOCABULARY), random.Random(3)
    latin = ["".join(rng.choice("ab'sdtrvelmANZ019,.<>_-!~\"`éßÀÖįıſŸÉ#$") for _ in range(rng.randrange(1, 10))) for _ in range(5000)] + ["it's", "'ll", "x" * 200, "don't!'re"]
    odd = ["日本,", "ж́", "ét", "×÷", "İx", "½", "²a", "a\x7f\x1fb", "<|endoftext|>", "<|x", "ǰẞ"]
    for words in (latin, latin[:50] + odd, odd, [], ["a"]):
        for part in (words, words[::-1]):
            ids, sizes = enc.cache.raw_all([w.encode() for w in part])
            stop = np.cumsum(sizes)
            assert [ids[b - a : b].tolist() for a, b in zip(sizes, stop, strict=True)] == _each(enc, part)


def test_known_words_are_not_encoded_again(spark, monkeypatch):
    """What is known of a frequent word comes with the coder; only the other words are encoded where they are met."""
    words = {"river": 9, "Stone,": 7, "unbelievably": 5, "glass9": 1, "été": 1}
    counts = spark.createDataFrame([(w.lower().encode(), n) for w, n in words.items()] + [(None, 4)], "word binary, n long")
    coder, total = lm_score.make_coder(counts, 5, 30.0)
    enc, met = encoder(lm_score.VOCABULARY), []
    whole = dict(zip(words, _each(enc, words), strict=True))
    assert len(coder.known) == 3 and total == sum(n * len(whole[w]) for w, n in words.items())
    encoded = type(enc.cache).raw_all
    monkeypatch.setattr(type(enc.cache), "raw_all", lambda self, x: met.extend(x) or encoded(self, x))
    asked = ["glass9", "river", "new", "stone,", "unbelievably", "river."]
    score, slots, first, size, within = coder.look_up([w.encode() for w in asked])
    assert met == [b"glass9", b"new", b"river."]
    for k, ids in enumerate(_each(enc, asked)):
        assert slots[first[k] : first[k] + size[k]].tolist() == coder.slot_of[ids].tolist()
        assert abs(within[k] - coder.within[ids].sum()) < 1e-9
    assert [bool(x) for x in np.isnan(score)] == [True, False, True, False, False, True] and abs(score[1] - np.log10(9.1 / 30)) < 1e-12
