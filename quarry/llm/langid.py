"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, discard, free_names, map_rows, materialize

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Languages of one model; its matrix is broadcast.
LANGS = 512
UNKNOWN = "und"
#: Characters counted at a time, so a text of any length takes bounded memory.
CHUNK = 1 << 19
_WORD = re.compile(r"[^\W\d_]+")


def _chunks(texts: list[str]):
    """(code points, index of the text of each) in pieces of about CHUNK; pieces of one text overlap so that no n-gram is lost."""
    held, size = [], 0
    for i, text in enumerate(texts):
        for at in range(0, len(text), CHUNK):
            piece = text[max(0, at - max(ORDERS) + 1) : at + CHUNK]
            held.append((i, piece, at > 0))
            size += len(piece)
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def _hashed(held) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text index) of each n-gram of the pieces; n-grams never cross texts."""
    lengths = np.array([len(p) for _, p, _ in held])
    codes = np.frombuffer("".join(p for _, p, _ in held).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.array([i for i, _, _ in held], dtype=np.int32), lengths)
    first = np.repeat(np.cumsum(lengths) - lengths, lengths)
    place = np.arange(len(codes)) - first
    overlap = np.repeat(np.array([max(ORDERS) - 1 if more else 0 for _, _, more in held]), lengths)
    buckets, owners = [], []
    key = np.zeros(len(codes), dtype=np.uint32)
    for n in range(1, max(ORDERS) + 1):
        # key of the n characters that end here
        key = codes * np.uint32(2654435761) if n == 1 else (np.concatenate([np.zeros(1, np.uint32), key[:-1]]) * np.uint32(0x85EBCA6B)) ^ (codes * np.uint32(2654435761) + np.uint32(n))
        if n in ORDERS:
            ok = place >= np.maximum(n - 1, overlap)
            mixed = key[ok] ^ (key[ok] >> np.uint32(15))
            buckets.append(((mixed * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int32) & (BUCKETS - 1))
            owners.append(owner[ok])
    return np.concatenate(buckets), np.concatenate(owners)


def has_letter(text: str) -> bool:
    """Whether any character is a letter; numbers as \u00bd or \u2167, which count as word characters too, are none."""
    return any(any(map(str.isalpha, m.group())) for m in _WORD.finditer(text))


def _prepared(texts: list) -> list[str]:
    return ["" if t is None else t.lower() for t in texts]


@dataclass
class Model:
    """Some of the languages, in the order of their names."""

    langs: list[str]
    log_prob: np.ndarray  # (BUCKETS, langs) float32
    prior: np.ndarray

    def best(self, texts: list) -> tuple[list[str | None], np.ndarray, np.ndarray]:
        """The most likely language of each text, the log of its joint probability, and the log of the sum over all.
        None for null and for texts without a letter."""
        low = _prepared(texts)
        total = np.tile(self.prior.astype(np.float64), (len(texts), 1))
        for held in _chunks(low):
            buckets, owners = _hashed(held)
            order = np.argsort(owners, kind="stable")
            ids, starts = np.unique(owners[order], return_index=True)
            if len(ids):
                buckets = buckets[order]
                for k in range(len(self.langs)):
                    total[ids, k] += np.add.reduceat(self.log_prob[:, k][buckets].astype(np.float64), starts)
        k = total.argmax(axis=1)
        top = total[np.arange(len(texts)), k]
        return [self.langs[i] if has_letter(x) else None for i, x in zip(k.tolist(), low, strict=True)], top, top + np.log(np.exp(total - top[:, None]).sum(axis=1))


def train(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", alpha: float = 0.5) -> list[Model]:
    """Models of LANGS languages at most, from the n-grams of every row with a text and a language. Map tasks count by
    themselves, LANGS languages at a time; the driver gets at most BUCKETS rows per language, a model at a time."""
    chosen = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def run(slices):
        counts: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}

        def counted():
            for x, c in counts.items():
                at = np.nonzero(c)[0]
                yield {"lang": [x] * (len(at) + 1), "bucket": [-1, *at.tolist()], "n": [docs[x], *c[at].tolist()]}

        for b in slices:
            langs, texts = b.column(0).to_pylist(), _prepared(b.column(1).to_pylist())
            codes = {x: k for k, x in enumerate(sorted(set(langs)))}
            of = np.array([codes[x] for x in langs])
            for held in _chunks(texts):
                buckets, owners = _hashed(held)
                both = np.bincount(of[owners].astype(np.int64) * BUCKETS + buckets, minlength=len(codes) * BUCKETS).reshape(len(codes), BUCKETS)
                for x, k in codes.items():
                    counts[x] = counts[x] + both[k] if x in counts else both[k].astype(np.int64)
            for x in langs:
                docs[x] = docs.get(x, 0) + 1
                if x not in counts:  # texts without a character
                    counts[x] = np.zeros(BUCKETS, np.int64)
            if len(counts) >= LANGS:
                yield from counted()
                counts, docs = {}, {}
        yield from counted()

    sums = materialize(map_rows(chosen, run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "ngrams")
    found = sums.where("bucket = -1").select("lang", "n").orderBy("lang").collect()  # a row per language
    models, every = [], sum(r["n"] for r in found)
    for a in range(0, len(found), LANGS):
        some = found[a : a + LANGS]
        names = {r["lang"]: k for k, r in enumerate(some)}
        counts = np.zeros((BUCKETS, len(some)))
        table = sums.where((F.col("bucket") >= 0) & F.col("lang").between(some[0]["lang"], some[-1]["lang"])).toArrow()
        if len(table):
            codes = np.array([names[x] for x in table.column("lang").to_pylist()])
            counts[table.column("bucket").to_numpy(), codes] = table.column("n").to_numpy()
        log_prob = np.log((counts + alpha) / (counts.sum(axis=0) + alpha * BUCKETS))
        models.append(Model([r["lang"] for r in some], log_prob.astype(np.float32), np.log(np.array([float(r["n"]) for r in some]) / every)))
    discard(sums)
    return models


def predict(docs: DataFrame, models: list[Model], id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """(id, ..., lang_pred, score): keep names further columns to carry through. The two columns may be named otherwise
    where docs has their names. There is a pass for each model, over what the passes before have found."""
    spark = docs.sparkSession
    carried = [id_col, *(c for c in keep or [] if c != id_col)]
    text, name, top, whole = free_names(carried, "text", "name", "top", "whole")
    rows = docs.select(*carried, F.col(text_col).cast("string").alias(text), F.lit(None).cast("string").alias(name), F.lit(float("-inf")).alias(top), F.lit(float("-inf")).alias(whole))
    kinds, n = rows.dtypes, len(carried)
    for k, model in enumerate(models, 1):
        # after the last pass the text is no longer needed
        out = [x for x in kinds if k < len(models) or x[0] != text]
        shared = spark.sparkContext.broadcast(model)  # BUCKETS * LANGS floats at most
        rows = map_rows(rows, _pass(shared, [c for c, _ in kinds], n), ", ".join(f"`{c}` {t}" for c, t in out))
    known = F.col(name).isNotNull()
    return rows.select(*carried, F.coalesce(name, F.lit(UNKNOWN)).alias(lang_pred), F.when(known, F.exp(F.col(top) - F.col(whole))).otherwise(0.0).alias(score))


def _pass(shared, columns: list[str], n: int):
    text, name, top, whole = columns[n:]

    def run(slices):
        for b in slices:
            names, best, every = shared.value.best(b.column(n).to_pylist())
            held, summed = (b.column(n + k).to_numpy(zero_copy_only=False) for k in (2, 3))
            # of equal ones the first by name stays
            new = best > held
            told = [x if more or y is None else y for x, y, more in zip(names, b.column(n + 1).to_pylist(), new.tolist(), strict=True)]
            yield {**{c: b.column(k) for k, c in enumerate(columns[: n + 1])}, name: told, top: np.where(new, best, held), whole: np.logaddexp(summed, every)}

    return run


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held: int = 1) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Learns from the documents whose crc32(id as text) mod folds is not ``held`` and whose language is not null, over all
    of their text; predicts every whole text, from the text alone. Null text, and text without a letter, is `und` with
    score 0; so is everything if nothing can be learned. Ties go to the first language by name. Repeated rows each count.
    Other columns are not read. An empty table gives no rows.
    """
    fold = crc_mod(id_col, folds)
    models = train(docs.where(fold != held), text_col, lang_col)
    out = predict(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), models)
    return out.select("doc_id", (crc_mod("doc_id", folds) == held).alias("held_out"), "lang_pred", "score")
