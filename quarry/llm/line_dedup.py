"""Line dedup by winnowing over line hashes."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, lookup, map_rows, materialize

#: A window is the fewest lines from a line on, or up to a line, that hold so many words.
MIN_WORDS = 20
#: Windows that a map task holds before it gives them away.
HELD = 20_000


def split_lines(text: str) -> tuple[list[str], list[int]]:
    """All \\n-split lines, and the numbers of those that hold more than white space."""
    lines = text.split("\n")
    return lines, [i for i, x in enumerate(lines) if x and not x.isspace()]


def _line_hash(line: str) -> int:
    return int.from_bytes(blake2b(line.strip().encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def fingerprints(text: str, min_words: int = MIN_WORDS) -> list[tuple[int, int, int, int, int, int]]:
    """[(mark, at, place, length, h1, h2)] of every window over the lines that are not blank.

    mark is the least line hash of the window and ``at`` the last line of the window that has it: what winnowing selects.
    A window depends on nothing but its own lines, so both occurrences of a repeated run select the same lines, and every
    run of ``min_words`` words holds the window that begins with it: a shared fingerprint is guaranteed. place, length
    and the 128-bit hash h1, h2 are the window's own. Each line of a run with so many words is in a window within the
    run: in the one that begins with it, the one that ends with it or, if neither fits, in the one that begins the run.
    """
    lines, at = split_lines(text)
    if not at:
        return []
    hashes = np.array([_line_hash(lines[i]) for i in at], dtype=np.int64)
    words = np.concatenate([[0], np.cumsum([len(lines[i].encode("utf-8", "surrogatepass").split()) for i in at], dtype=np.int64)])
    ends = np.searchsorted(words, words[:-1] + min_words)  # lines before this one hold enough words
    starts = np.searchsorted(words, words[1:] - min_words, side="right") - 1  # lines from this one on do
    spans = {(i, e) for i, e in enumerate(ends.tolist()) if e <= len(at)} | {(s, e) for e, s in enumerate(starts.tolist(), 1) if s >= 0}
    body, out = hashes.tobytes(), []
    for i, e in sorted(spans):
        digest = blake2b(body[8 * i : 8 * e], digest_size=16).digest()
        k = e - 1 - int(np.argmin(hashes[i:e][::-1]))
        out.append((int(hashes[k]), k, i, e - i, int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)))
    return out


def repeated_runs(docs: DataFrame, id_col: str | Column = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_key, runs array<struct<start, stop>>): lines of a document, counted without blank ones, that occur earlier.

    A document is an id with a text, as ids may repeat; text_key is the text's 64-bit hash. Earlier is by id, then by
    text_key, then by place. The lines that windows select are joined by their hash; what stands at one position
    only goes no further. Then a match extends both ways, window by window, as long as the windows around the shared
    lines are equal: each is compared with its first occurrence, and windows that overlap make up the run. A run that is
    equal to several earlier ones, here longer on one side and there on the other, is therefore covered by all of them.
    """
    text = F.col(text_col).cast("string")
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    id_type = dict(rows.dtypes)["doc_id"]
    names = ("mark", "at", "place", "length", "h1", "h2")

    def occurrences(slices):
        for b in slices:
            rows_, found = [], []
            for r, text in enumerate(b.column(2).to_pylist()):
                own = fingerprints(text, min_words)
                rows_ += [r] * len(own)
                found += own
                if len(found) >= HELD or (found and r == b.num_rows - 1):
                    at = np.array(rows_)
                    yield {"doc_id": b.column(0).take(at), "text_key": b.column(1).take(at), **dict(zip(names, zip(*found, strict=True), strict=True))}
                    rows_, found = [], []

    found = materialize(map_rows(rows, occurrences, f"doc_id {id_type}, text_key long, mark long, at int, place int, length int, h1 long, h2 long"), "lines")
    total = found.count()
    where = F.struct("doc_id", "text_key", "at")
    marks = found.groupBy("mark").agg(F.min(where).alias("lo"), F.max(where).alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi").select("mark", "n", F.lit(True).alias("shared"))
    met = lookup(found, "mark", materialize(marks, "marks"), "n", total, "shared").where("shared").drop("shared", "mark", "at")
    met = materialize(met.withColumn("fp", F.xxhash64("h1", "h2")), "met")
    firsts = met.groupBy("fp").agg(F.min(F.struct("doc_id", "text_key", "place", "h1", "h2")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = lookup(met, "fp", materialize(firsts, "firsts"), "n", max(1, met.count()), "first").where("first is not null")
    later = later.where((F.col("h1") == F.col("first.h1")) & (F.col("h2") == F.col("first.h2")) & ~((F.col("doc_id") == F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key")) & (F.col("place") == F.col("first.place"))))
    # at most two rows per line of a document
    return later.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct(F.col("place").alias("start"), (F.col("place") + F.col("length")).alias("stop"))).alias("runs"))


def without_runs(text: str, runs: list[tuple[int, int]]) -> tuple[str, int, int]:
    """(text left, lines that are not blank, how many of them went)."""
    lines, at = split_lines(text)
    gone = {at[k] for s, e in runs for k in range(max(0, s), min(e, len(at)))}
    return "\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text, len(at), len(gone)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, n_lines: str = "__n_lines", n_removed: str = "__n_removed") -> DataFrame:
    """All columns of docs with the text cleaned, and two more named by ``n_lines`` and ``n_removed``: how many lines
    were not blank, and how many of them went.

    A line goes if it lies in a run of lines that holds ``min_words`` words and occurs earlier, by id, then by place; the
    first occurrence stays. Lines are compared without the white space at their ends; blank lines stay. A document with
    fewer words than that is left alone.

    Null text stays null. Null ids take no part. Rows that repeat an id and its text count as one document and never
    delete each other; rows that repeat an id with other texts are documents of their own, in the order of their texts'
    hashes, and a line that goes from one of them stays in an earlier one. Further columns pass through, whatever their
    names; the two names given must be free. An empty table gives no rows.
    """
    if {n_lines, n_removed} & set(docs.columns):
        raise ValueError(f"columns {n_lines} and {n_removed} must be free")
    key, text_key, spans = free_names(docs.columns, "id", "key", "runs")
    runs = repeated_runs(docs, id_col, text_col, min_words).select(F.col("doc_id").alias(key), F.col("text_key").alias(text_key), F.col("runs").alias(spans))
    # null ids are spread by the hash of their text
    joined = docs.join(runs, (F.col(id_col) == F.col(key)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(text_key)), "left").drop(key, text_key)
    names = joined.columns
    at, last = names.index(text_col), len(names) - 1

    def clean(slices):
        for b in slices:
            texts, found = b.column(at).to_pylist(), b.column(last).to_pylist()
            out = [(None, 0, 0) if x is None else without_runs(x, [(r["start"], r["stop"]) for r in s or []]) for x, s in zip(texts, found, strict=True)]
            yield {**{n: b.column(k) for k, n in enumerate(names[:-1])}, text_col: [o[0] for o in out], n_lines: [o[1] for o in out], n_removed: [o[2] for o in out]}

    schema = ", ".join(f"`{n}` {t}" for n, t in [*joined.dtypes[:-1], (n_lines, "long"), (n_removed, "long")])
    return map_rows(joined, clean, schema)


#: White space of all scripts, as lines are stripped of.
_SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

#: The rows of op1_line_dedup: windows of 20 words from each line on and up to each line, and the first place of each.
ORACLE_SQL = rf"""
WITH a AS MATERIALIZED (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents WHERE text IS NOT NULL
), t AS MATERIALIZED (
  SELECT doc_id, k, raw, regexp_replace(raw, '^{_SPACE}+|{_SPACE}+$', '', 'g') AS line, len(regexp_extract_all(raw, '[^\x20\x09-\x0D]+')) AS n FROM a
), l AS MATERIALIZED (
  SELECT doc_id, k, line, n, row_number() OVER o AS i, sum(n) OVER o AS upto FROM t WHERE line <> '' WINDOW o AS (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING)
), w AS MATERIALIZED (
  SELECT x.doc_id, x.i AS s, y.i AS e FROM (SELECT *, upto - n + 20 AS need FROM l) x ASOF JOIN l y ON x.doc_id = y.doc_id AND x.need <= y.upto
  UNION SELECT y.doc_id, x.i, y.i FROM (SELECT *, upto - 20 AS most FROM l) y ASOF JOIN (SELECT *, upto - n AS before FROM l) x ON x.doc_id = y.doc_id AND y.most >= x.before
), c AS MATERIALIZED (
  SELECT w.*, array_to_string(list_slice(d.lines, s, e), chr(10)) AS content FROM w JOIN (SELECT doc_id, list(line ORDER BY i) AS lines FROM l GROUP BY doc_id) d USING (doc_id)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, s) AS place FROM c
), g AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS i FROM r WHERE place > 1
), q AS (
  SELECT t.doc_id, t.k, t.raw, l.i IS NOT NULL AS filled, g.i IS NOT NULL AS gone FROM t LEFT JOIN l USING (doc_id, k) LEFT JOIN g ON g.doc_id = l.doc_id AND g.i = l.i
)
SELECT documents.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN text IS NOT NULL THEN sha256(coalesce(kept, '')) END AS kept_sha256
FROM documents LEFT JOIN (SELECT doc_id, count_if(filled) AS n_lines, count_if(gone) AS n_removed, string_agg(raw, chr(10) ORDER BY k) FILTER (NOT gone) AS kept FROM q GROUP BY doc_id) USING (doc_id)
"""
