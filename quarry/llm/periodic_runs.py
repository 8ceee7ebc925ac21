"""Periodic runs of words by an all-lag scan."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, materialize, split_words

#: A run has so many words at least, and so many periods.
MIN_LENGTH, MIN_EXP = 12, 2
#: Comparisons that are made at a time; they and what follows from them stay in a core's cache.
CELLS = 1 << 20
#: A text of more bytes is compared by several tasks, each with its share of the lags.
LONG_BYTES = 1 << 17
#: Comparisons of a share, and shares of a text at most, as each gets the whole text.
SHARE_CELLS, SHARES = 1 << 29, 256


def lag_cuts(n: int, shares: int, min_exp: int = MIN_EXP) -> list[int]:
    """shares + 1 lags, from 1 to one past the last, between which there are equal numbers of comparisons."""
    lags = n // min_exp
    upto = np.cumsum(n - np.arange(1, lags + 1, dtype=np.int64)) if lags else np.zeros(0, np.int64)
    wanted = [int(upto[-1]) * k // shares if lags else 0 for k in range(1, shares)]
    return [1, *(np.searchsorted(upto, wanted, side="left") + 1).tolist(), lags + 1]


@lru_cache(maxsize=1)
def _cells(n: int) -> np.ndarray:
    """Room for so many results, used again and again."""
    return np.empty(n, np.bool_)


def scan(ids: np.ndarray, lo: int, hi: int, min_length: int = MIN_LENGTH, min_exp: int = MIN_EXP) -> list[tuple[int, int, int]]:
    """[(start, length, period)] of the maximal stretches that keep a period from lo to hi - 1 for long enough.

    The words are compared with themselves shifted by each lag, many lags at a time; true stretches of a lag, with the
    lag's own words, are the stretches that keep it as a period.
    """
    n, out = len(ids), []
    if n < min_length or lo >= hi:
        return out
    # what stands beyond the end is equal to nothing, and a lag's comparisons fill whole 8-byte words
    width = -(-n // 8) * 8
    wide = np.uint16 if int(ids.max()) < 0xFFFE else np.uint32
    here = np.full(width, np.iinfo(wide).max, wide)
    there = np.full(width + hi, np.iinfo(wide).max - 1, wide)
    here[:n] = there[:n] = ids
    rows, first = max(1, CELLS // width), lo
    all_true, cells = np.uint64(0x0101010101010101), _cells(max(CELLS, width))
    while first < hi:
        last = min(first + rows, hi)
        # a lag needs a true stretch of so many; one of 15 holds a whole 8-byte word
        if first * (min_exp - 1) < 15:
            last = min(last, -(-15 // (min_exp - 1)))
        shifted = np.ndarray((last - first, width), wide, there, first * there.itemsize, (there.itemsize, there.itemsize))
        same = np.equal(shifted, here, out=cells[: (last - first) * width].reshape(last - first, width))
        if first * (min_exp - 1) < 15:
            held, most = same, min(max(q * (min_exp - 1), min_length - q) for q in range(first, last))
            while most > 1:
                step = most // 2
                held, most = held[:, :-step] & held[:, step:], most - step
        else:
            held = same.view(np.uint64) == all_true
        for k in np.flatnonzero(held.any(axis=1)).tolist():
            lag = first + k
            # the last comparison of a lag is with what stands beyond the end, so every stretch ends before it
            edges = np.flatnonzero(same[k, 1:] != same[k, :-1]) + 1
            if same[k, 0]:
                edges = np.concatenate(([0], edges))
            start, stop = edges[::2], edges[1::2]
            length = stop - start + lag
            keep = (length >= min_length) & (length >= min_exp * lag)
            out += zip(start[keep].tolist(), length[keep].tolist(), [lag] * int(keep.sum()), strict=True)
        first = last
    return out


def least_periods(stretches: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs, by start and period: of stretches over the same words the one with the smallest period.

    A stretch of two periods or more that also has a smaller period is a stretch of that one too, over the same words:
    the smaller divides the larger, so whatever extends one extends the other.
    """
    least: dict[tuple[int, int], int] = {}
    for start, length, period in stretches:
        least[start, length] = min(period, least.get((start, length), period))
    return sorted(((s, n, q) for (s, n), q in least.items()), key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period, joined by one space."""
    if runs:
        depth = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            depth[start + period] += 1
            depth[start + length] -= 1
        words = [words[k] for k in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]
    return b" ".join(words)


_RUNS = "array<struct<start: long, length: long, period: long>>"


def _structs(runs: list[tuple[int, int, int]]) -> list[dict]:
    return [{"start": s, "length": n, "period": q} for s, n, q in runs]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_exp: int = MIN_EXP, long_bytes: int = LONG_BYTES, share_cells: int = SHARE_CELLS) -> DataFrame:
    """One row per document: (doc_id, runs array<struct<start, length, period>> by start and period, collapsed).

    A run is a stretch of words that keeps a smallest period, is ``min_length`` words and ``min_exp`` periods long at
    least, and that no neighbouring word extends keeping it; words are numbered from 0. ``collapsed`` joins the words
    that stay when each run keeps its first period only.

    Comparisons grow with the square of a text's words. Texts up to ``long_bytes`` are scanned where they are read, with
    no shuffle; longer ones are written once, and tasks on all machines take equal shares of their lags. What they find
    grows with the words only, and meets again by the text's row.

    Null and wordless texts have no run and collapse to an empty text. Repeated rows and rows with equal or null ids are
    documents of their own. Other columns, whatever their names, are not read. An empty table gives no rows.
    """
    if min_exp < 2:
        raise ValueError("runs have two periods at least")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type, schema = dict(rows.dtypes)["doc_id"], f"runs {_RUNS}, collapsed string"
    size = F.coalesce(F.octet_length("text"), F.lit(0))

    def found(b: pa.RecordBatch, column: int):
        """(row, its word ids, the distinct words as bytes) of each text."""
        owner, place, words = split_words(b.column(column))
        ends = np.searchsorted(owner, np.arange(b.num_rows + 1))
        words = words.to_pylist()
        for r in range(b.num_rows):
            yield r, place[ends[r] : ends[r + 1]], words

    def whole(slices):
        for b in slices:
            runs, texts = [], []
            for _, ids, words in found(b, 1):
                own = least_periods(scan(ids, 1, len(ids) // min_exp + 1, min_length, min_exp))
                runs.append(_structs(own))
                texts.append(collapsed([words[k] for k in ids.tolist()], own).decode("utf-8", "replace"))
            yield {"doc_id": b.column(0), "runs": runs, "collapsed": texts}

    def share(slices):
        for b in slices:
            which, of = b.column(1).to_pylist(), b.column(2).to_pylist()
            out = []
            for r, ids, _ in found(b, 3):
                cuts = lag_cuts(len(ids), of[r], min_exp)
                out.append(_structs(least_periods(scan(ids, cuts[which[r]], cuts[which[r] + 1], min_length, min_exp))))
            yield {"row": b.column(0), "runs": out}

    def merge(slices):
        for b in slices:
            runs, texts, parts = [], [], b.column(2).to_pylist()
            for r, ids, words in found(b, 1):
                own = least_periods([(x["start"], x["length"], x["period"]) for part in parts[r] for x in part])
                runs.append(_structs(own))
                texts.append(collapsed([words[k] for k in ids.tolist()], own).decode("utf-8", "replace"))
            yield {"doc_id": b.column(0), "runs": runs, "collapsed": texts}

    short = map_rows(rows.where(size <= long_bytes), whole, f"doc_id {id_type}, {schema}")

    long = materialize(rows.where(size > long_bytes).withColumn("row", F.monotonically_increasing_id()), "long")
    # a text of b bytes has (b + 1) / 2 words at most
    cells = F.pow((F.octet_length("text") + 1) / 2, F.lit(2)) * 3 / 8
    shares = F.least(F.lit(SHARES), F.ceil(cells / share_cells)).cast("int")
    dealt = long.withColumn("of", shares).withColumn("which", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.select("row", "which", "of", "text").repartition(tasks, "row", "which")
    parts = map_rows(dealt, share, f"row long, runs {_RUNS}", rows=1).groupBy("row").agg(F.collect_list("runs").alias("parts"))
    joined = long.join(parts, "row").select("doc_id", "text", "parts")
    return short.unionByName(map_rows(joined, merge, f"doc_id {id_type}, {schema}", rows=1))


#: The rows of op12_periodic_runs: equal stretches of six words meet, and neighbouring meetings at one distance are a run.
ORACLE_SQL = r"""
WITH poly AS (
  SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) r(i)
), d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) AS h
  FROM documents, poly
), g AS (
  SELECT doc_id, words, len(words) AS n, h % 10 = 0 AND len(words) > 0 AS made, (h // 10) % greatest(len(words), 1) AS a, h // 10 AS g FROM d
), w AS MATERIALIZED (
  SELECT doc_id, n, CASE WHEN made THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN words[i + 1] ELSE words[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) ELSE words END AS words FROM g
), u AS MATERIALIZED (
  SELECT doc_id, i, words[i + 1] AS word, array_to_string(words[i + 1 : i + 6], ' ') AS six, n FROM w, unnest(range(n)) r(i)
), m AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM u x JOIN u y ON x.doc_id = y.doc_id AND x.six = y.six AND x.i < y.i WHERE y.i + 6 <= y.n AND 2 * (y.i - x.i) <= x.n
), s AS (
  SELECT doc_id, q, min(i) AS start, count(*) + 5 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m) GROUP BY doc_id, q, island
), r AS MATERIALIZED (
  SELECT doc_id, start, length, min(q) AS period FROM s WHERE length >= greatest(12, 2 * q) GROUP BY doc_id, start, length
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM u ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
), best AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed, arg_max(struct_pack(start := start, length := length, period := period), (length, -start, -period)) AS b FROM r GROUP BY doc_id
)
SELECT documents.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(b.start AS BIGINT) AS start, CAST(b.length AS BIGINT) AS length, CAST(b.period AS BIGINT) AS period, CAST(1000 * b.length // b.period AS BIGINT) AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM documents LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
