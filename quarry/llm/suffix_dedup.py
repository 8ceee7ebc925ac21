"""Repeated byte strings across all documents, from per-shard suffix arrays."""

from __future__ import annotations

from hashlib import blake2b, sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lookup, map_rows, materialize

#: Bytes of a repeated string.
LENGTH = 200
#: Bytes of an anchor. Every string of LENGTH bytes owns the least-hashed anchor in it, and so do its repetitions.
GRAM = 48
#: Bytes of regions per shard, and regions of one anchor that a shard takes at most before the anchor is split.
SHARD_BYTES, SHARD_REGIONS = 1 << 20, 10_000
#: Starts handled at a time, so a text of any length takes bounded memory; below 2**20.
CHUNK = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        with np.errstate(over="ignore"):
            _powers["up"] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE)]))
            _powers["down"] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _INVERSE)]))
    return _powers["up"], _powers["down"]


def owned(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first start, last start) of the runs of starts that own the same anchor, over all of raw."""
    window = length - gram + 1
    b = np.frombuffer(raw, np.uint8).astype(np.uint64)
    up, down = _tables(len(b))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b + np.uint64(1)) * up[: len(b)])])
        h = (sums[gram:] - sums[:-gram]) * down[: len(b) - gram + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        # hash first, place last: the least is the leftmost of equals
        m = (h & ~np.uint64((1 << 20) - 1)) | np.arange(len(h), dtype=np.uint64)
    step = 1
    while 2 * step <= window:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    if step < window:
        m = np.minimum(m[: len(m) - (window - step)], m[window - step :])
    anchor = (m & np.uint64((1 << 20) - 1)).astype(np.int64)
    return h.view(np.int64), anchor, np.arange(len(anchor))


def owned_runs(texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """Yields (text index, anchor hash, first start, starts, anchor minus first start) as arrays."""
    buffers, held, size = [], [], 0
    for i, raw in enumerate(texts):
        for at in range(0, max(0, len(raw) - length + 1), CHUNK):
            piece = raw[at : at + CHUNK + length - 1]
            held.append((i, at, piece))
            size += len(piece)
            if size >= CHUNK:
                buffers.append(held)
                held, size = [], 0
        if len(buffers) > 0:
            yield from (_runs(x, length, gram) for x in buffers)
            buffers = []
    if held:
        yield _runs(held, length, gram)


def _runs(held, length: int, gram: int):
    sizes = np.array([len(p) for _, _, p in held])
    h, anchor, start = owned(b"".join(p for _, _, p in held), length, gram)
    piece = np.repeat(np.arange(len(held)), sizes)[: len(start)]
    first = np.cumsum(sizes) - sizes
    inside = start + length <= (first + sizes)[piece]
    start, piece, anchor = start[inside], piece[inside], anchor[inside]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])
    at = np.nonzero(new)[0]
    count = np.diff(np.append(at, len(start)))
    p = piece[at]
    owner, offset = np.array([i for i, _, _ in held])[p], np.array([o for _, o, _ in held], dtype=np.int64)[p]
    return owner, h[anchor[at]], start[at] - first[p] + offset, count, anchor[at] - start[at]


def refine(data: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Larsson-Sadakane refinement up to ``depth`` bytes (8, 16, 32, ...).

    data: bytes; ends: for each position the end of its string. Positions with fewer than ``depth`` bytes before that
    end drop out on the way. Returns the rank of each position by its first depth bytes, equal for equal bytes, -1 where
    there are too few.
    """
    n = len(data)
    room = ends - np.arange(n)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.zeros(n, np.uint64)
    for k in range(8):
        words = (words << np.uint64(8)) | padded[k : k + n]
    rank = np.full(n, -1, np.int64)
    idx = np.nonzero(room >= 8)[0]
    order = np.argsort(words[idx])
    idx = idx[order]
    rank[idx] = _starts(words[idx][1:] != words[idx][:-1], len(idx))
    h = 8
    while h < depth:
        nxt = np.where(room >= 2 * h, rank, -1)
        todo = np.nonzero(nxt >= 0)[0]
        # groups of one are in place; their rank stays
        size = np.bincount(nxt[todo], minlength=n)
        todo = todo[size[nxt[todo]] > 1]
        if len(todo):
            old, second = rank[todo], rank[todo + h]
            order = np.argsort(old * np.int64(n + 1) + second)
            todo, old, second = todo[order], old[order], second[order]
            change = (old[1:] != old[:-1]) | (second[1:] != second[:-1])
            group = _starts(old[1:] != old[:-1], len(todo))
            nxt[todo] = old + _starts(change, len(todo)) - group
        rank = nxt
        h *= 2
    return rank


def _starts(change: np.ndarray, n: int) -> np.ndarray:
    """For each place in sorted order the place where its group of equals begins."""
    first = np.zeros(n, np.int64)
    if n:
        first[1:] = np.where(change, np.arange(1, n), 0)
        np.maximum.accumulate(first, out=first)
    return first


def classes(regions: list[bytes], starts: list[int], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorts the owned starts of a shard. starts: per region, how many from its front are owned.

    Returns region and place of the starts in suffix order, and for each whether it has ``length`` bytes in common with
    the one before. Two strings have so many if the ranks of their first and of their last ``depth`` bytes agree; that
    answers for all neighbours at once what Kasai's scan, one byte after the other, would.
    """
    sizes = np.array([len(r) for r in regions], dtype=np.int64)
    data = np.frombuffer(b"".join(regions), np.uint8)
    first = np.cumsum(sizes) - sizes
    ends = np.repeat(first + sizes, sizes)
    depth = 8
    while 2 * depth <= length:
        depth *= 2
    rank = refine(data, ends, depth)
    region = np.repeat(np.arange(len(regions)), starts)
    place = np.arange(len(region)) - np.repeat(np.cumsum(starts) - starts, starts)
    at = first[region] + place
    order = np.argsort(rank[at] * np.int64(len(data) + 1) + rank[at + length - depth])
    at, region, place = at[order], region[order], place[order]
    common = np.zeros(len(at), np.int64)
    if len(at) > 1:
        a, b = at[1:], at[:-1]
        whole = (rank[a] == rank[b]) & (rank[a + length - depth] == rank[b + length - depth])
        common[1:] = np.where(whole, length, 0)
    return region, place, common


def _shard(length: int):
    columns = ["g", "doc_id", "th", "start", "stop", "digest"]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        regions, counts = frame["region"].tolist(), frame["count"].to_numpy(np.int64)
        region, place, common = classes(regions, counts, length)
        same = common >= length
        repeated = same.copy()
        repeated[:-1] |= same[1:]
        many = frame["m"].to_numpy() > 1
        hot = frame["parts"].to_numpy() > 1
        out = []
        ids, ths, p0, gs = frame["doc_id"].tolist(), frame["th"].tolist(), frame["p0"].tolist(), frame["g"].tolist()
        # members of a region that occurs several times are known already; here it only bears witness
        chosen = np.nonzero(repeated & ~many[region])[0]
        chosen = chosen[np.lexsort((place[chosen], region[chosen]))]
        if len(chosen):
            r, p = region[chosen], place[chosen]
            cut = np.nonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (p[1:] != p[:-1] + 1)]))[0]
            last = np.append(cut[1:], len(chosen)) - 1
            for a, z in zip(cut, last, strict=True):
                k = int(r[a])
                out.append((None, ids[k], ths[k], p0[k] + int(p[a]), p0[k] + int(p[z]) + length, None))
        # an anchor split over shards: strings that are alone here, and one witness of each that is not
        heads = np.nonzero(hot[region] & ~same)[0]
        for x in heads:
            k, p = int(region[x]), int(place[x])
            alone = not repeated[x] and not many[k]
            digest = blake2b(regions[k][p : p + length], digest_size=16).digest()
            out.append((gs[k], ids[k], ths[k], p0[k] + p if alone else None, p0[k] + p + length if alone else None, digest))
        return pd.DataFrame(out, columns=columns)

    return run


def repeated_spans(docs: DataFrame, id_col: str, text_col: str, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, th, spans): byte spans of every document that strings of ``length`` bytes cover which start elsewhere too.

    th is a hash of the text, so that rows that share an id keep apart.
    """
    rows = _rows(docs, id_col, text_col)
    id_type = dict(rows.dtypes)["doc_id"]

    def anchors(slices):
        for b in slices:
            raw = [x.encode("utf-8", "surrogatepass") for x in b.column(2).to_pylist()]
            for owner, h, first, count, delta in owned_runs(raw, length, gram):
                yield {"doc_id": b.column(0).take(owner), "th": b.column(1).take(owner), "h": h, "run": (first << 16) | (delta << 8) | (count - 1)}

    if length - gram + 1 > 256:
        raise ValueError("length may exceed gram by 255 at most")
    found = materialize(map_rows(rows, anchors, f"doc_id {id_type}, th long, h long, run long"), "anchors")
    shared = materialize(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    met = lookup(found, "h", shared, "n", max(1, found.count()), "n").where("n is not null")
    # a document has one row per anchor in it at most
    wanted = met.groupBy("doc_id", "th").agg(F.collect_list(F.struct("h", "n", "run")).alias("runs"))
    wanted = materialize(wanted, "wanted")
    discard(found, shared)
    same = rows["doc_id"].eqNullSafe(F.col("w.doc_id")) & (rows["th"] == F.col("w.th"))
    picked = rows.join(wanted.alias("w"), same).select(rows["doc_id"], rows["th"], rows["text"], F.col("w.runs").alias("runs"))

    def cut(slices):
        for b in slices:
            at, out = [], {"h": [], "n": [], "p0": [], "count": [], "region": [], "g": []}
            for r, (text, runs) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                raw = text.encode("utf-8", "surrogatepass")
                # rows that repeat an id and a text bring their runs each
                for h, n, run in {(x["h"], x["n"], x["run"]) for x in runs}:
                    p, count = run >> 16, (run & 255) + 1
                    region = raw[p : p + count - 1 + length]
                    at.append(r)
                    g = blake2b(region + bytes([(run >> 8) & 255]), digest_size=16).digest()
                    for name, value in zip(out, (h, n, p, count, region, g), strict=True):
                        out[name].append(value)
            yield {"doc_id": b.column(0).take(np.array(at, np.int64)), "th": b.column(1).take(np.array(at, np.int64)), **out}

    regions = materialize(map_rows(picked, cut, f"doc_id {id_type}, th long, h long, n long, p0 long, count int, region binary, g binary"), "regions")
    discard(wanted)
    # equal regions of equal anchors become one
    kinds = regions.groupBy("g").agg(F.count(F.lit(1)).alias("m"), *(F.first(c).alias(c) for c in ("doc_id", "th", "h", "n", "p0", "count", "region")))
    kinds = materialize(kinds, "kinds")
    several = kinds.where("m > 1").select("g")
    whole = regions.join(several, "g", "left_semi").select("doc_id", "th", F.col("p0").alias("start"), (F.col("p0") + F.col("count") - 1 + length).alias("stop"))
    whole = materialize(whole, "whole")
    discard(regions)

    total = kinds.agg(F.sum(F.length("region"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    parts = F.ceil(F.col("n") / SHARD_REGIONS)
    dealt = kinds.withColumn("parts", parts).withColumn("shard", F.pmod(F.xxhash64("h", F.when(parts > 1, F.pmod(F.xxhash64("g"), parts)).otherwise(0)), F.lit(shards)))
    sorted_ = dealt.repartition(max(1, min(shards, max(4000, shards // 64))), "shard").groupBy("shard").applyInPandas(_shard(length), f"g binary, doc_id {id_type}, th long, start long, stop long, digest binary")
    sorted_ = materialize(sorted_, "sorted")
    discard(kinds)
    near = sorted_.where("digest is null").select("doc_id", "th", "start", "stop")
    far = sorted_.where("digest is not null")
    twice = far.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
    across = far.where("start is not null").join(twice, "digest", "left_semi").select("doc_id", "th", "start", "stop")
    return whole.unionByName(near).unionByName(across).groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def without_spans(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """(bytes left, maximal removed runs)."""
    kept, at, runs = [], 0, 0
    reach = -1
    for s, e in sorted(spans):
        if s > reach:
            runs += 1
            kept.append(raw[at:s])
        at = reach = max(reach, e)
    kept.append(raw[at:])
    return b"".join(kept), runs


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left).

    Every byte is removed that a string of ``length`` bytes covers which starts anywhere else too, in the same document
    or another. The starts of such strings own the anchor (``gram`` bytes) of least hash inside them, so a string and its
    repetitions meet at the same anchor; anchors that occur once are done with. The regions around the rest are dealt to
    shards by anchor, each shard sorts its starts by Larsson-Sadakane refinement, and neighbours with a common prefix of
    ``length`` are repeated. Equal regions count once. An anchor with more than SHARD_REGIONS regions is split over
    shards, whose strings that are alone in their shard are then sought in the sorted strings of the others.

    Null text is empty. Rows that repeat an id and a text are documents of their own, so all they hold is removed if
    long enough. Other columns are not read. An empty table gives no rows.
    """
    rows = _rows(docs, id_col, text_col)
    id_type = dict(rows.dtypes)["doc_id"]
    spans = repeated_spans(docs, id_col, text_col, length, gram)
    same = rows["doc_id"].eqNullSafe(F.col("s.doc_id")) & (rows["th"] == F.col("s.th"))
    joined = rows.join(spans.alias("s"), same, "left").select(rows["doc_id"], rows["text"], F.col("s.spans").alias("spans"))

    def clean(slices):
        for b in slices:
            out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                left, runs = without_spans(raw, [(x["start"], x["stop"]) for x in spans or []])
                for name, value in zip(out, (len(raw), len(raw) - len(left), runs, sha256(left).hexdigest(), left), strict=True):
                    out[name].append(value)
            yield {"doc_id": b.column(0), **out}

    return map_rows(joined, clean, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


#: The rows of op5_suffix_dedup: every string of 200 bytes, in hexadecimal, and the runs that those cover which occur twice.
ORACLE_SQL = r"""
WITH h AS MATERIALIZED (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), b AS MATERIALIZED (
  SELECT doc_id, h, length(h) // 2 AS n FROM h
), c AS (
  SELECT doc_id, n, c, substr(h, 2 * c + 1, 2398) AS piece FROM (SELECT *, unnest(range(0, n, 1000)) AS c FROM b)
), p AS MATERIALIZED (
  SELECT doc_id, c + i AS pos, md5(substr(piece, 2 * i + 1, 400)) AS bytes FROM (SELECT *, unnest(range(0, least(1000, n - c - 199))) AS i FROM c WHERE n - c >= 200)
), d AS MATERIALIZED (
  SELECT doc_id, pos FROM p WHERE bytes IN (SELECT bytes FROM p GROUP BY bytes HAVING count(*) > 1)
), s AS (
  SELECT doc_id, pos, coalesce(pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) > 200, true) AS fresh FROM d
), g AS (
  SELECT doc_id, pos, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM s
), r AS MATERIALIZED (
  SELECT doc_id, run, min(pos) AS a, max(pos) + 200 AS z FROM g GROUP BY ALL
), k AS (
  SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, max(z) AS last FROM r GROUP BY doc_id
), f AS (
  SELECT r.doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM (SELECT *, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM r) r JOIN b USING (doc_id) GROUP BY r.doc_id
)
SELECT b.doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM b LEFT JOIN k USING (doc_id) LEFT JOIN f USING (doc_id)
"""
