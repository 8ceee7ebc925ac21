"""Language-model scoring: a causal self-attention model over subwords with a memory of the corpus's repeated segments,
beside smoothed word counts."""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .attention_lm import ROUNDS, SLOTS, AttentionLM
from .common import crc_mod, discard, lookup, map_rows, materialize, split_words
from .encode import encoder, public_path

VOCABULARY = "word_bpe_49k.json"
#: Words of the highest counts that are broadcast, at most; all other words are looked up by a join.
HEAD = 300_000
#: Words, and segments, that a map task holds before it gives their counts away.
HELD_WORDS, HELD_SEGMENTS = 3_000_000, 200_000
#: A segment begins where the MEMORY subwords before it have a hash of which 2 ** -RATE have the like.
MEMORY, RATE = 8, 6


def word_counts(texts: DataFrame) -> DataFrame:
    """(word binary, n) over all texts of the one column; the end of a text is the null word."""

    def run(slices):
        held, size, ends = [], 0, 0

        def counted():
            found = pc.value_counts(pa.concat_arrays(held))
            return {"word": found.field("values"), "n": found.field("counts")}

        for b in slices:
            _, place, words = split_words(b.column(0), lower=True)
            held.append(words.take(pa.array(place)))
            size += len(place)
            ends += b.num_rows
            if size >= HELD_WORDS:
                yield counted()
                held, size = [], 0
        if size:
            yield counted()
        yield {"word": [None], "n": [ends]}

    return map_rows(texts, run, "word binary, n long", rows=4096).groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")


@dataclass
class Coder:
    slot_of: np.ndarray  # slot of each subword id
    within: np.ndarray  # log10 P(id | slot): 0 but for the ids of slot 0
    end: int  # slot of the end of a text
    known: dict  # place of each of the most frequent words, HEAD at most
    score: np.ndarray  # log10 P of each, as a word
    slots: np.ndarray  # slots of all of them in a row
    sizes: np.ndarray  # how many slots each has
    inside: np.ndarray  # the sum of within of each
    vocabulary: str

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, ...]:
        """(log10 P, nan if not known; slots of all words that may come; first, number and sum of within of each word's).
        Words that are not known are encoded when they come."""
        found = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.nonzero(found < 0)[0]
        ids, more = encoder(self.vocabulary).cache.raw_all([words[k] for k in new.tolist()])
        # what comes after the known words' own
        score, size, within = (np.append(x, y)[found] for x, y in ((self.score, np.nan), (self.sizes, 0), (self.inside, 0.0)))
        first = np.append(np.cumsum(self.sizes) - self.sizes, 0)[found]
        first[new], size[new] = len(self.slots) + np.cumsum(more) - more, more
        total = np.concatenate([[0.0], np.cumsum(self.within[ids])])
        stop = np.cumsum(more)
        within[new] = total[stop] - total[stop - more]
        return score, np.concatenate([self.slots, self.slot_of[ids].astype(np.uint16)]), first, size, within


def make_coder(counts: DataFrame, least: int, bottom: float, vocabulary: str = VOCABULARY) -> tuple[Coder, int]:
    """The slots by the counts of all words, and how many subwords there are in all. Words with ``least`` and more are
    known, HEAD of them at most; P of one is (n + 0.1) / bottom."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary if "/" in vocabulary else public_path(vocabulary))
    size = tokenizer.get_vocab_size()

    def subwords(slices):
        encode, single = encoder(vocabulary).cache.raw_all, np.zeros(size, np.int64)
        for b in slices:
            ids, sizes = encode(b.column(0).to_pylist())
            np.add.at(single, ids, np.repeat(b.column(1).to_numpy(zero_copy_only=False), sizes))
        s = np.nonzero(single)[0]
        yield {"id": s, "n": single[s]}

    def known_words(slices):
        encode = encoder(vocabulary).cache.raw_all
        for b in slices:
            yield {"word": b.column(0), "n": b.column(1), "ids": packed(*encode(b.column(0).to_pylist()), "<u4")}

    words = counts.where("word is not null")
    head = map_rows(words.where(F.col("n") >= least), known_words, "word binary, n long, ids binary", rows=4096).toArrow()  # HEAD rows at most
    often, parts = head.column("n").to_numpy(), head.column("ids").to_pylist()
    ids, sizes = np.frombuffer(b"".join(parts), "<u4"), np.array([len(p) // 4 for p in parts], np.int64)
    # the vocabulary's ids at most
    table = map_rows(words.where(F.col("n") < least), subwords, "id long, n long", rows=4096).groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    single = np.zeros(size, np.int64)
    single[table.column("id").to_numpy()] = table.column("n").to_numpy()
    np.add.at(single, ids, np.repeat(often, sizes))
    end = size - 1  # the vocabulary's own end mark
    frequency = single.copy()
    frequency[end] = frequency.sum() + 1  # always with a slot of its own
    top = np.argsort(-frequency, kind="stable")[: SLOTS - 1]
    slot_of = np.zeros(size, np.int64)
    slot_of[top] = np.arange(1, len(top) + 1)
    other = slot_of == 0
    within = np.zeros(size)
    if other.any():
        within[other] = np.log10((single[other] + 0.1) / (single[other].sum() + 0.1 * other.sum()))
    known = dict(zip(head.column("word").to_pylist(), range(head.num_rows), strict=True))
    inside = np.bincount(np.repeat(np.arange(len(sizes)), sizes), within[ids], minlength=len(sizes))
    return Coder(slot_of, within, int(slot_of[end]), known, np.log10((often + 0.1) / bottom), slot_of[ids].astype(np.uint16), sizes, inside, vocabulary), int(single.sum())


_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= _MIX[1]
    h ^= h >> np.uint64(29)
    return h


def segments(flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start in flat, context, content, segments per text): texts cut where their own subwords say so.

    A segment begins with a text, context 0, and wherever the hash of the MEMORY subwords before it in the text is one of
    the chosen, which is its context then; it ends where the next begins or the text ends. So where it ends depends on
    nothing but what it holds and its context. content is a hash of all of it. Hashes have 64 bits.
    """
    first, v = np.cumsum(lengths) - lengths, flat.astype(np.uint64) + np.uint64(1)
    h = np.zeros(max(0, len(flat) - MEMORY), np.uint64)
    for k in range(MEMORY):
        h *= _MIX[0]
        h += v[k : k + len(h)]
    h = _mixed(h)
    at = np.nonzero((h * _MIX[2]) >> np.uint64(64 - RATE) == 0)[0]
    place = at + MEMORY
    inside = place - first[np.searchsorted(first, place, side="right") - 1] >= MEMORY
    start = np.concatenate([first, place[inside]])
    context = np.concatenate([np.zeros(len(first), np.uint64), h[at[inside]]])
    order = np.argsort(start, kind="stable")
    start, context = start[order], context[order]
    size = np.diff(np.append(start, len(flat)))
    v *= _MIX[2]
    v += (np.arange(len(flat)) - np.repeat(start, size)).astype(np.uint64) * _MIX[3]
    content = _mixed(np.add.reduceat(_mixed(v), start))
    owner = np.searchsorted(first, start, side="right") - 1
    return start, context.view(np.int64), content.view(np.int64), np.bincount(owner, minlength=len(lengths))


def packed(values: np.ndarray, counts: np.ndarray, kind: str) -> pa.Array:
    """Binary array of the values of each text."""
    data = values.astype(kind)
    offsets = np.concatenate([[0], data.itemsize * np.cumsum(counts)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def remembered(coded: DataFrame) -> DataFrame:
    """(context, content, n): how often each segment occurs in the texts to learn from. Map tasks count first."""

    def run(slices):
        held, size = [], 0

        def counted():
            both = np.concatenate(held, axis=1)
            both = both[:, np.lexsort(both)]
            new = np.append(True, (both[:, 1:] != both[:, :-1]).any(axis=0))
            at = np.nonzero(new)[0]
            return {"context": both[0, at], "content": both[1, at], "n": np.diff(np.append(at, both.shape[1]))}

        for b in slices:
            held.append(np.stack([np.frombuffer(b"".join(b.column(k).to_pylist()), "<i8") for k in (0, 1)]))
            size += held[-1].shape[1]
            if size >= HELD_SEGMENTS:
                yield counted()
                held, size = [], 0
        if size:
            yield counted()

    rows = coded.where("slots is not null and not held_out").select("context", "content")
    return map_rows(rows, run, "context long, content long, n long").groupBy("context", "content").agg(F.sum("n").alias("n"))


def count_pairs(pairs: np.ndarray, flat: np.ndarray, lengths: np.ndarray, learn: np.ndarray, end: int) -> None:
    """Add the adjacent slots of the texts to learn from; before the first slot of a text stands the end of another."""
    before = np.empty(len(flat), np.int64)
    before[1:] = flat[:-1]
    before[np.cumsum(lengths) - lengths] = end
    at = before * SLOTS + flat
    np.add.at(pairs, at[np.repeat(learn, lengths)], 1)


def train(coded: DataFrame) -> AttentionLM:
    """coded: rows of texts (doc_id, held_out, th, slots), and rows (at, n) of packed counts of adjacent slots of all texts
    to learn from. The gradient steps take all of them as well."""

    def summed(slices):
        pairs = np.zeros(SLOTS * SLOTS, np.int64)
        for b in slices:
            for at, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                pairs[np.frombuffer(at, "<i4")] += np.frombuffer(n, "<i8")
        a = np.nonzero(pairs)[0]
        yield {"at": a, "n": pairs[a]}

    # SLOTS * SLOTS pairs at most
    table = map_rows(coded.where("at is not null").select("at", "n"), summed, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    pair = np.zeros(SLOTS * SLOTS)
    pair[table.column("at").to_numpy()] = table.column("n").to_numpy()
    model = AttentionLM.start(pair.reshape(SLOTS, SLOTS))
    share = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "th"), F.lit(sum(ROUNDS)))
    model.fit(coded.where("slots is not null and not held_out").select("slots", share.alias("share")))
    return model


def lm_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, held: int = 0, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from documents whose crc32(id as text) mod folds is not ``held``. Words and one end per text are counted over
    all of them; base_score sums log10((c + 0.1) / (N + 0.1 (V + 1))). The model reads subword ids: counts of
    adjacent subwords over all of every text to learn from, corrected by a causal self-attention layer over windows that
    overlap, each subword scored once. Texts are cut into segments, and the model remembers every segment that occurs more
    than once in the texts to learn from: after a context that was followed C times by N different segments, one of them
    c times, P(segment) = (max(c - 1, 0) + N P') / C, where P' is what the subwords give. As all P' of a context sum to
    one, so do these. score is the log10 of the model's probability of the whole text and the end.

    The gradient steps of the attention layer, all counts and the memory take all of every text to learn from: tasks learn
    from the texts they read, and their models are averaged after each round.

    The HEAD words of the highest counts are broadcast; every other word of a document is looked up by a join.
    Null and empty texts are an end alone. With nothing to learn from, counts are zero and the model is uniform over what
    it knows. Repeated rows are scored one by one. Other columns are not read. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("held_out", crc_mod("doc_id", folds) == held)
    learn = rows.where("not held_out")
    counts = materialize(word_counts(learn.select("text")), "counts")
    # words by count, in steps of an eighth of a power of two: a few hundred rows
    steps = counts.where("word is not null").groupBy(F.floor(F.log2("n") * 8).alias("step")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least"), F.sum("n").alias("n")).collect()
    ends = counts.where("word is null").agg(F.sum("n")).first()[0] or 0
    total, kinds = ends + sum(r["n"] for r in steps), sum(r["words"] for r in steps) + (ends > 0)
    least, words = 1 << 62, 0
    for r in sorted(steps, key=lambda r: -r["step"]):
        words += r["words"]
        if words > HEAD:
            break
        least = r["least"]
    bottom = total + 0.1 * (kinds + 1)
    end_score = math.log10((ends + 0.1) / bottom)
    coder, subwords = make_coder(counts, least, bottom, vocabulary)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(coder)  # HEAD words at most

    def code(slices):
        coder = shared.value
        pairs = np.zeros(SLOTS * SLOTS, np.int64)
        nothing = {"at": [None], "n": [None]}
        for b in slices:
            n = b.num_rows
            owner, place, distinct = split_words(b.column(1), lower=True)
            listed = distinct.to_numpy(zero_copy_only=False).tolist()
            score, pool, begin, sizes, inside = (x if k == 1 else x[place] for k, x in enumerate(coder.look_up(listed)))
            slots = pool[np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes - begin, sizes)]
            unknown = np.isnan(score)
            # of each text the words to be looked up, each once
            pair, often = np.unique(owner[unknown] * len(listed) + place[unknown], return_counts=True)
            at = pa.array(np.searchsorted(pair, np.arange(n + 1) * len(listed)), pa.int32())
            tails = pa.ListArray.from_arrays(at, pa.StructArray.from_arrays([distinct.take(pa.array(pair % max(1, len(listed)))), pa.array(often, pa.int64())], ["word", "k"]))
            base = np.bincount(owner, np.where(unknown, 0.0, score), minlength=n) + end_score
            missing = np.bincount(owner[unknown], minlength=n)
            lengths = np.bincount(owner, sizes, minlength=n).astype(np.int64) + 1
            # each text's slots, then the end
            flat = np.full(int(lengths.sum()), coder.end, np.int64)
            inner = np.ones(len(flat), bool)
            inner[np.cumsum(lengths) - 1] = False
            flat[inner] = slots
            count_pairs(pairs, flat, lengths, ~b.column(2).to_numpy(zero_copy_only=False).astype(bool), coder.end)
            counts_ = np.bincount(owner, minlength=n)
            start, context, content, cuts = segments(flat, lengths)
            start = start - np.repeat(np.cumsum(lengths) - lengths, cuts)
            yield {
                "doc_id": b.column(0), "held_out": b.column(2), "row": b.column(3), "th": b.column(4), "n_tokens": counts_ + 1, "n_known": counts_ - missing + int(ends > 0), "base_score": base,
                "tail": tails, "slots": packed(flat, lengths, "<u2"), "start": packed(start, cuts, "<i4"), "context": packed(context, cuts, "<i8"), "content": packed(content, cuts, "<i8"), "within": np.bincount(owner, inside, minlength=n),
                **{c: v * n for c, v in nothing.items()},
            }
        at = np.nonzero(pairs)[0]
        yield {**{c: [None] for c in names}, "at": [at.astype("<i4").tobytes()], "n": [pairs[at].astype("<i8").tobytes()]}

    id_type = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {id_type}, held_out boolean, row long, th long, n_tokens long, n_known long, base_score double, tail array<struct<word: binary, k: long>>, slots binary, start binary, context binary, content binary, within double, at binary, n binary"
    names = ("doc_id", "held_out", "row", "th", "n_tokens", "n_known", "base_score", "tail", "slots", "start", "context", "content", "within")
    numbered = rows.select("doc_id", "text", "held_out", F.monotonically_increasing_id().alias("row"), F.xxhash64("text").alias("th"))
    coded = materialize(map_rows(numbered, code, schema, rows=2048), "coded")
    model = spark.sparkContext.broadcast(train(coded))  # SLOTS * SLOTS floats at most
    end = coder.end

    def run(slices):
        for b in slices:
            texts = b.column(5).to_pylist()
            lengths = np.array([len(x) // 2 for x in texts], dtype=np.int64)
            flat = np.frombuffer(b"".join(texts), "<u2").astype(np.int64)
            each = model.value.score(flat, lengths, end)
            starts = b.column(7).to_pylist()
            cuts = np.array([len(x) // 4 for x in starts], dtype=np.int64)
            at = np.frombuffer(b"".join(starts), "<i4") + np.repeat(np.cumsum(lengths) - lengths, cuts)
            first = np.cumsum(cuts) - cuts
            pieces = np.add.reduceat(each, at)
            offsets = pa.array(np.append(first, len(at)), pa.int32())
            lists = {c: pa.ListArray.from_arrays(offsets, pa.array(x)) for c, x in (("context", np.frombuffer(b"".join(b.column(8).to_pylist()), "<i8")), ("content", np.frombuffer(b"".join(b.column(9).to_pylist()), "<i8")), ("log_p", pieces))}
            yield {"row": b.column(0), "doc_id": b.column(1), "held_out": b.column(2), "n_tokens": b.column(3), "n_known": b.column(4), "base_score": b.column(10), "score": np.add.reduceat(pieces, first) + b.column(6).to_numpy(zero_copy_only=False), **lists}

    memory = materialize(remembered(coded), "segments")
    # a context whose segments all occur once says nothing
    contexts = memory.groupBy("context").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds")).where(F.col("all") > F.col("kinds"))
    contexts = materialize(contexts.select("context", "all", F.struct("all", "kinds").alias("of")), "contexts")
    often = materialize(memory.where("n > 1").select(F.xxhash64("context", "content").alias("key"), "n"), "often")
    discard(memory)
    texts = coded.where("slots is not null")
    columns = texts.select("row", "doc_id", "held_out", "n_tokens", "n_known", "slots", "within", "start", "context", "content", "base_score")
    scored = map_rows(columns, run, f"row long, doc_id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double, context array<long>, content array<long>, log_p array<double>")
    scored = materialize(scored, "scored")
    pieces = scored.select("row", F.inline(F.arrays_zip("context", "content", "log_p")))
    share = scored.agg(F.sum(F.size("context"))).first()[0] or 1
    met = lookup(pieces, "context", contexts, "all", share, "of").where("of is not null").withColumn("key", F.xxhash64("context", "content"))
    met = lookup(met, "key", often, "n", share, "n")
    known_as = F.coalesce(F.col("n"), F.lit(1)) - 1 + F.col("of.kinds") * F.pow(F.lit(10.0), F.col("log_p"))
    gained = F.when(F.col("n").isNotNull(), F.log10(known_as / F.col("of.all")) - F.col("log_p")).otherwise(F.log10(F.col("of.kinds") / F.col("of.all")))
    rare = counts.where((F.col("word").isNotNull()) & (F.col("n") < least))
    tail = texts.select("row", F.inline("tail")).join(rare, "word", "left")
    n = F.coalesce(F.col("n"), F.lit(0))
    tail = tail.select("row", F.when(n > 0, F.col("k")).otherwise(0).alias("more_known"), (F.col("k") * F.log10((n + 0.1) / F.lit(bottom))).alias("more_base"), F.lit(0.0).alias("more_score"))
    both = tail.unionByName(met.select("row", F.lit(0).cast("long").alias("more_known"), F.lit(0.0).alias("more_base"), gained.alias("more_score")))
    more = both.groupBy("row").agg(*(F.sum(c).alias(c) for c in ("more_known", "more_base", "more_score")))
    out = scored.join(more, "row", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
