"""Text operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest

from quarry.llm import exact_dedup, jaccard, langid, line_dedup, lm_score, mixing, packing, quality, suffix_dedup, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, comp long"
WORDS = "the of and river stone light carries under morning winter quiet letter road field glass".split()


def _prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] + str(rng.integers(60)) for i in rng.integers(len(WORDS), size=n))


def rows():
    base = _prose(1, 300)
    near = base.split()
    near[150] = "changed"
    passage = _prose(2, 60)
    lines = "\n".join(_prose(s, 12) for s in range(20, 26))
    texts = {
        1: base, 2: " ".join(near), 3: base, 4: _prose(3, 40) + " " + passage + " " + _prose(4, 30), 5: _prose(5, 20) + " " + passage, 6: None, 7: "", 8: " \n ", 9: "one two", 10: "one two", 11: lines, 12: "intro words\n" + lines + "\nend",
        13: "Ünïcode ÉTÉ straße " * 30, 14: _prose(6, 9000), 15: "a b c d e " * 100, 16: "123 456", 17: "#$% &|<> ### " * 30,
    }
    out = [(i, x, ["en", "de"][i % 2], f"s{i % 3}" if i % 7 else None, len(x or ""), "clash", 0) for i, x in texts.items()]
    return out + [out[0], (18, texts[9], None, "s0", 7, None, None), (None, "no id here at all", "en", "s1", 3, None, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _bag(df):
    return collections.Counter(tuple(r) for r in df.collect())


def test_exact_dedup(docs, none):
    by = collections.defaultdict(list)
    for r in rows():
        by[r[1] or ""].append(r[0])
    want = collections.Counter()
    for r in rows():
        ids = [i for i in by[r[1] or ""] if i is not None]
        keep = max(ids) if ids else None
        want[(r[0], keep, len(by[r[1] or ""]), r[0] == keep, hashlib.sha256((r[1] or "").encode()).hexdigest())] += 1
    assert _bag(exact_dedup.exact_dedup(docs)) == want
    assert exact_dedup.exact_dedup(none).count() == 0


def _sets(texts):
    out = []
    for x in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), x or ""))
        out.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


def test_jaccard(docs, none):
    all_rows = rows()
    sets = _sets([r[1] for r in all_rows])
    parent = list(range(len(sets)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in itertools.combinations(range(len(sets)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    least = collections.defaultdict(list)
    for k, r in enumerate(all_rows):
        if r[0] is not None:
            least[root(k)].append(r[0])
    want = collections.Counter((r[0], len(sets[k]), min(least[root(k)], default=None)) for k, r in enumerate(all_rows))
    assert _bag(jaccard.jaccard_components(docs)) == want
    assert jaccard.jaccard_components(none).count() == 0


def test_rtree_loses_nothing():
    rng = np.random.default_rng(0)
    points = rng.integers(0, 4, (300, jaccard.GROUPS)).astype(np.int8)
    points[100:150] = points[:50]
    points[7, 3] = points[14, 3] = jaccard.FULL
    sizes = points.sum(axis=1, dtype=np.int64)
    tree = jaccard.RTree(points, sizes)
    for i in range(0, 300, 7):
        want = {j for j in range(300) if 100 * min(sizes[i], sizes[j]) >= 80 * max(sizes[i], sizes[j]) and jaccard.most_overlap(points[i], points[j]) >= jaccard.least_overlap(sizes[i], sizes[j])}
        assert set(tree.near(points[i], sizes[i]).tolist()) == want


def test_suffix_dedup(docs, none):
    raws = [(r[0], (r[1] or "").encode()) for r in rows()]
    n = suffix_dedup.LENGTH
    count = collections.Counter(b[p : p + n] for _, b in raws for p in range(len(b) - n + 1))
    want = collections.Counter()
    for i, b in raws:
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - n + 1):
            if count[b[p : p + n]] > 1:
                gone[p : p + n] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        left = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        want[(i, len(b), int(gone.sum()), runs, hashlib.sha256(left).hexdigest())] += 1
    assert _bag(suffix_dedup.suffix_dedup(docs).drop("kept")) == want
    assert suffix_dedup.suffix_dedup(none).count() == 0


def test_suffix_split_anchor(docs, monkeypatch):
    """With tiny shards every anchor is split, and strings are found across shards."""
    whole = _bag(suffix_dedup.suffix_dedup(docs).drop("kept"))
    monkeypatch.setattr(suffix_dedup, "SHARD_REGIONS", 1)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 4096)
    assert _bag(suffix_dedup.suffix_dedup(docs).drop("kept")) == whole


def test_line_dedup(docs, none):
    out = {r["doc_id"]: r for r in line_dedup.line_dedup(docs).collect()}
    assert out[12]["text"] == "intro words\nend" and out[12]["__n_removed"] == 6
    assert out[11]["__n_removed"] == 0 and out[6]["text"] is None and out[1]["kept"] == "clash"
    assert out[3]["text"] == "" and out[1]["__n_removed"] == 0
    assert line_dedup.line_dedup(none).count() == 0


def test_packing(docs, none):
    from tokenizers import Tokenizer

    from quarry.llm.encode import public_path

    tokenizer = Tokenizer.from_file(public_path("word_bpe_49k.json"))
    want = collections.Counter()
    for r in rows():
        ids = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for k, s in enumerate(range(0, len(ids), 2048)):
            want[(r[0], k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes()))] += 1
    got = packing.best_fit_packing(docs).collect()
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == list(np.cumsum([0] + [n for _, n in b])[:-1]) and sum(n for _, n in b) <= 2048
    assert len(bins) == -(-sum(r["length"] for r in got) // 2048)
    assert packing.best_fit_packing(none).count() == 0


def test_genetic_steps_keep_items():
    import random

    rng = random.Random(1)
    sizes = [rng.randrange(1, 900) for _ in range(400)]
    one = packing.best_fit(range(400), sizes, 2048)
    two = packing.best_fit(sorted(range(400), key=lambda i: -sizes[i]), sizes, 2048)
    for child in (packing.crossover(one, two, sizes, 2048, rng), packing.mutate(one, sizes, 2048, rng), packing.evolve(sizes, [one, two], 3)):
        assert sorted(i for b in child for i in b) == list(range(400)) and max(sum(sizes[i] for i in b) for b in child) <= 2048
    assert len(packing.evolve(sizes, [one], 3)) <= len(one)


def test_mixing(spark, docs, none):
    got = mixing.mix(docs).collect()
    size = collections.Counter()
    for r in rows():
        size[r[3]] += len((r[1] or "").encode().split())
    total, names = sum(size.values()), sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), float(total)
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * size[s]}
        if not over:
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
        free -= over
    target |= {s: weight[s] * level for s in free}
    source = {r[0]: r[3] for r in rows()}
    taken = collections.Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert abs(r["target"] - target[s]) < 1e-6 and r["source_size"] == size[s] and r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert len(got) == len(rows())
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, mixing.mix(docs.repartition(5)).collect()))
    many = spark.range(2000).selectExpr("id as doc_id", "repeat('w ', 1 + cast(id % 40 as int)) as text", "concat('s', id % 4) as source")
    for s in mixing.mix(many).groupBy("source_size", "target").sum("taken").collect():
        assert abs(s[2] - s[1]) <= 0.01 * s[1]
    assert mixing.mix(none).count() == 0


def test_language(docs, none, spark):
    out = {r["doc_id"]: r for r in langid.language_id(docs).collect()}
    assert out[6]["lang_pred"] == out[7]["lang_pred"] == out[16]["lang_pred"] == "und" and out[6]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in out.values()) and out[4]["held_out"] == (zlib.crc32(b"4") % 3 == 1)
    assert langid.language_id(none).count() == 0
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pred = langid.language_id(real).join(real.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (pred["lang"] == pred["lang_pred"]).mean() > 0.95


def test_chunked_ngrams_count_once():
    text = _prose(9, 4000)
    whole = collections.Counter(itertools.chain(*(langid._hashed(h)[0].tolist() for h in langid._chunks([text]))))
    old, langid.CHUNK = langid.CHUNK, 1000
    try:
        assert collections.Counter(itertools.chain(*(langid._hashed(h)[0].tolist() for h in langid._chunks([text])))) == whole
    finally:
        langid.CHUNK = old


def _rules(text):
    words = [w.decode() for w in (text or "").encode().split()]
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if x.encode().split():
            dup += x in seen
            seen.add(x)
    count = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {j for i in range(len(words) - 2) if count[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


def test_quality(docs, none, spark):
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(1, 16)], "doc_id long, quality int, toxic int")
    got = collections.Counter(tuple(r)[:7] for r in quality.quality_rules(docs, labels).collect())
    want = collections.Counter()
    for r in rows():
        s = _rules(r[1])
        want[(r[0], *s, s[0] < 50 or 100 * s[4] > 50 * s[0])] += 1
    assert got == want
    assert quality.quality_rules(none, labels).count() == 0
    assert quality.quality_rules(docs, None).where("kept").count() > 0


def test_forest_finds_the_odd_one():
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(0, 1, (500, 3)), [[8, 8, 8]]])
    score = quality.Forest.fit(points).score(points)
    assert score.argmax() == 500 and (score > 0).all() and (score < 1).all()


def test_token_counts(docs, none):
    lengths = [r["n_tokens"] for r in token_counts.encoded_lengths(docs).collect()]
    out = token_counts.token_counts(docs)
    for r in out.collect():
        limit = r["context_limit"]
        assert r["n_docs"] == lengths.count(limit) and r["docs_longer"] == sum(x > limit for x in lengths) and r["tokens_kept"] == sum(min(x, limit) for x in lengths)
        assert r["tokens_within"] == sum(x for x in lengths if x <= limit) and r["tokens_kept"] + r["tokens_lost"] == sum(lengths)
    at = {r["context_limit"]: r["tokens_kept"] for r in token_counts.at_limits(out, [0, 10, 500, 10**6]).collect()}
    assert at == {x: sum(min(n, x) for n in lengths) for x in (0, 10, 500, 10**6)}
    assert token_counts.quantiles(out, [0.5]).first()["n_tokens"] == sorted(lengths)[(len(lengths) + 1) // 2 - 1]
    assert token_counts.token_counts(none).count() == 0


def test_lm_score(docs, none):
    import math

    got = {r["doc_id"]: r for r in lm_score.lm_score(docs).collect()}
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    counts, ends = collections.Counter(), 0
    for r in rows():
        if zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 10:
            counts.update((r[1] or "").encode().translate(low).split())
            ends += 1
    total = sum(counts.values()) + ends
    bottom = total + 0.1 * (len(counts) + 2)
    for i, x, *_ in rows():
        w = (x or "").encode().translate(low).split()
        base = sum(math.log10((counts.get(k, 0) + 0.1) / bottom) for k in w) + math.log10((ends + 0.1) / bottom)
        r = got[i]
        assert r["train_tokens"] == total and r["n_tokens"] == len(w) + 1 and r["n_known"] == 1 + sum(k in counts for k in w)
        assert abs(r["base_score"] - base) < 1e-6 * abs(base) and r["score"] < 0
    assert lm_score.lm_score(none).count() == 0


def test_attention_is_a_probability_and_matches_plain_code():
    from quarry.llm.attention_lm import CONTEXT, SLOTS, SPAN, STRIDE, WIDTH, AttentionLM

    rng = np.random.default_rng(1)
    m = AttentionLM.start(rng.random((SLOTS, SLOTS)) ** 8 * 5)
    m.lag[:] = rng.standard_normal(SPAN)
    end = 3

    def plain(seq):
        given, total = np.concatenate([[end], seq[:-1]]), 0.0
        for i, t in enumerate(seq):
            window = [given[j] if j >= 0 else end for j in range(i // STRIDE * STRIDE - CONTEXT, i + 1)]
            s = np.array([m.query[given[i]] @ m.key[c] * WIDTH**-0.5 + m.lag[len(window) - 1 - j] for j, c in enumerate(window)])
            a = np.exp(s) / np.exp(s).sum()
            h = sum(x * m.value[c] for x, c in zip(a, window, strict=True)) + m.rest[given[i]]
            z = m.base[given[i]] + (h / (1 + abs(h))) @ m.out + m.bias
            total += m.pair[given[i], t] + (z[m.classes[t]] - np.log(np.exp(z).sum()) - m.base[given[i]][m.classes[t]]) / np.log(10)
        return total

    seqs = [np.append(rng.integers(0, SLOTS, n), end) for n in (0, 1, 8, 15, 16, 17, 60)]
    lengths = np.array([len(x) for x in seqs])
    got = np.add.reduceat(m.score(np.concatenate(seqs), lengths, end), np.cumsum(lengths) - lengths)
    assert np.allclose(got, [plain(x) for x in seqs], atol=1e-4)
    assert abs(sum(10 ** m.score(np.array([t]), np.array([1]), end)[0] for t in range(SLOTS)) - 1) < 1e-3


def test_encoder_equals_tokenizer():
    from tokenizers import Tokenizer

    from quarry.llm.encode import encoder, public_path

    t, mine = Tokenizer.from_file(public_path("word_bpe_49k.json")), encoder("word_bpe_49k.json")
    for x in [r[1] for r in rows() if r[1]] + ["a\x0bb\x0cc \x1c d \x85 e f<|endoftext|>g İstanbul ΣΑΣ don't. x's, ...,, é ﬁ ß 日本 🙂 123.", "<|ENDOFTEXT|> <|endoftext|>.", "ǅ ŉ x.. y., z,."]:
        assert mine.encode(x) == np.array(t.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes()
