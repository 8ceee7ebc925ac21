"""Source divergence audit: how the words of each source differ from those of other sources of its language."""

from __future__ import annotations

import operator
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, materialize, text_or_empty

#: What each byte becomes: 0 ends a term, A-Z are lowered, other letters and all bytes of wider characters stay.
_BYTES = np.zeros(256, np.uint8)
_BYTES[0x80:] = np.arange(0x80, 0x100)
_BYTES[0x61:0x7B] = _BYTES[0x41:0x5B] = np.arange(0x61, 0x7B)

#: A kept term is in so many documents of its language at least.
MIN_DOCS = 10
#: Shares are whole numbers of this part.
UNIT = 1_000_000_000
#: The terms that are listed per source.
TOP = 10
#: A map task gives its counts away once it holds so many of a source and term.
HELD = 1 << 20
#: Terms and sources of a tile; tiles bound what a task of the pairs holds.
TILE_TERMS, TILE_SOURCES = 16_384, 64
#: Tasks that the terms of one language or source are dealt out to.
SALTS = 32


def boundaries(texts: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """(text number of each term, the terms) of the texts' UTF-8 bytes, joined by a byte that ends terms. A table says what
    each byte becomes; a term begins where the byte before is none, and ends where the next is none."""
    texts = pc.fill_null(texts, "").cast(pa.string())
    joined = pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts)
    low = _BYTES[np.frombuffer(pc.binary_join(joined, "\n")[0].as_buffer(), np.uint8)]
    inside = low != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False) + 1)
    return np.searchsorted(ends, np.flatnonzero(begins), side="right"), list(filter(None, low.tobytes().split(b"\0")))


def grouped(terms: list[bytes], hashed: Callable[[bytes], int] = xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, list[bytes]]:
    """(number of each slice's term, the distinct terms): equal hashes make a group, whose slices are compared with its
    first byte by byte; those that differ make groups of their own."""
    codes = np.fromiter(map(hashed, terms), np.uint64, len(terms))
    _, first, group = np.unique(codes, return_index=True, return_inverse=True)
    names = [terms[k] for k in first.tolist()]
    differs = np.fromiter(map(operator.ne, terms, map(names.__getitem__, group.tolist())), np.bool_, len(terms))
    more: dict[bytes, int] = {}
    for k in np.flatnonzero(differs).tolist():
        group[k] = more.setdefault(terms[k], len(names) + len(more))
    return group, names + list(more)


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys and the sums of the values of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], *(np.add.reduceat(v[order], first) if len(keys) else v for v in values)


class _Counts:
    """Occurrences and documents per source and term, combined within a task."""

    def __init__(self) -> None:
        self.sources: dict[tuple[str, str], int] = {}
        self.terms: dict[bytes, int] = {}
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, langs: list[str], sources: list[str], texts: pa.Array) -> None:
        of = np.array([self.sources.setdefault(x, len(self.sources)) for x in zip(langs, sources, strict=True)], np.int64)
        owner, terms = boundaries(texts)
        group, names = grouped(terms)
        # documents x terms in rows: each document's distinct terms and how often it has them
        cells, n = np.unique(owner * len(names) + group, return_counts=True) if len(terms) else (np.zeros(0, np.int64),) * 2
        doc, term = np.divmod(cells, max(1, len(names)))
        number = np.array([self.terms.setdefault(x, len(self.terms)) for x in names], np.int64)
        part = _sums((of[doc] << 32) + number[term], n, np.ones(len(n), np.int64))
        self.parts.append(part)
        self.held += len(part[0])
        if self.held >= 2 * HELD:
            self.parts = [_sums(*map(np.concatenate, zip(*self.parts, strict=True)))]
            self.held = len(self.parts[0][0])

    def rows(self):
        """All counts in pieces, and a row without a term per source that occurs; then none are held."""
        keys, n, docs = _sums(*map(np.concatenate, zip(*self.parts, strict=True)))
        pairs, terms = list(self.sources), pa.array(list(self.terms), pa.binary()).cast(pa.string())
        langs, names = (pa.array([x[k] for x in pairs], pa.string()) for k in (0, 1))
        yield {"lang": langs, "source": names, "term": [""] * len(pairs), "n": [0] * len(pairs), "docs": [0] * len(pairs)}
        for at in range(0, len(keys), 1 << 16):
            k = keys[at : at + (1 << 16)]
            source = pa.array(k >> 32)
            yield {"lang": langs.take(source), "source": names.take(source), "term": terms.take(pa.array(k & 0xFFFFFFFF)), "n": n[at : at + len(k)], "docs": docs[at : at + len(k)]}
        self.__init__()


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in a source and the documents there that have it.

    A source without any term has one row with an empty term. Map tasks combine first, so a source or a term that a
    third of all rows has comes from a task once.
    """
    rows = docs.select(text_or_empty(lang_col).alias("lang"), text_or_empty(source_col).alias("source"), F.col(text_col).cast("string").alias("text"))

    def run(slices):
        counts = _Counts()
        for b in slices:
            counts.add(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2))
            if counts.held >= HELD:
                yield from counts.rows()
        if counts.parts:
            yield from counts.rows()

    parts = map_rows(rows, run, "lang string, source string, term string, n long, docs long", rows=4096)
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(count: np.ndarray, n: np.ndarray | int, v: np.ndarray | int) -> np.ndarray:
    """1 + floor(UNIT * (count + 2) / (n + 2 * v)), exact while n + 2 * v is below 9 * 10^15: three digits at a time."""
    of = n + 2 * v
    whole, rest = np.divmod(count + 2, of)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, of)
        whole = whole * 1000 + digits
    return whole + 1


def _gap(p, q):
    """floor((p - q)^2 / (p + q)); shares are at most UNIT + 1, so this fits 64 bits."""
    return (p - q) ** 2 // (p + q)


def tile_gaps(terms: int, left: tuple, right: tuple, n_left: np.ndarray, n_right: np.ndarray, v: int) -> np.ndarray:
    """gaps[s, t]: the sum of _gap over all terms of a tile, of sources s by sources t.

    left and right are CSR matrices (indptr, indices, counts) of sources by the tile's terms; n are the sources' totals.
    Only cells with a count are visited: where t has none its share is one and the same number for all of them.
    """
    (lp, li, lc), (rp, ri, rc) = left, right
    none_left, none_right = shares(np.zeros_like(n_left), n_left, v), shares(np.zeros_like(n_right), n_right, v)
    of = np.repeat(np.arange(len(n_right)), np.diff(rp))
    p_right, q_none = shares(rc, n_right[of], v), none_right[of]
    filled = np.flatnonzero(np.diff(rp))
    out = np.zeros((len(n_left), len(n_right)), np.int64)
    for s in range(len(n_left)):
        at, counts = li[lp[s] : lp[s + 1]], lc[lp[s] : lp[s + 1]]
        p = np.full(terms, none_left[s], np.int64)
        p[at] = shares(counts, n_left[s], v)
        # t as if it had no term, by the distinct shares of s, then what t's own terms change
        distinct, times = np.unique(p[at], return_counts=True)
        out[s] = (_gap(distinct[:, None], none_right) * times[:, None]).sum(axis=0) + (terms - len(at)) * _gap(none_left[s], none_right)
        if len(ri):
            out[s, filled] += np.add.reduceat(_gap(p[ri], p_right) - _gap(p[ri], q_none), rp[filled])
    return out


def _matrix(counts: pa.Table, numbers: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The counts of the sources of these numbers as a CSR matrix."""
    no = counts.column("no").to_numpy()
    mine = np.flatnonzero(np.isin(no, numbers))
    mine = mine[np.argsort(no[mine], kind="stable")]
    return np.searchsorted(no[mine], np.append(numbers, numbers[-1:] + 1)), columns[mine], counts.column("n").to_numpy()[mine]


def _tile(counts: pa.Table, sources: pa.Table) -> pa.Table:
    """Gaps of the pairs of two blocks of sources over one tile's terms; sources has all sources of both blocks."""
    lang, a, b, v, terms = (sources.column(c)[0].as_py() for c in ("lang", "a", "b", "v", "terms"))
    sources = sources.sort_by("no")
    numbers, totals = sources.column("no").to_numpy(), sources.column("total").to_numpy()
    columns = counts.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
    left, right = (np.flatnonzero(numbers // TILE_SOURCES == k) for k in (a, b))
    gaps = tile_gaps(terms, _matrix(counts, numbers[left], columns), _matrix(counts, numbers[right], columns), totals[left], totals[right], v)
    s, t = np.divmod(np.arange(gaps.size), max(1, len(right)))
    keep = numbers[left][s] < numbers[right][t]
    names = sources.column("source")
    return pa.table({"lang": pa.array([lang] * int(keep.sum()), pa.string()), "source": names.take(pa.array(left[s][keep])), "item": names.take(pa.array(right[t][keep])), "value": gaps.ravel()[keep]})


def _share_column(count: Column, n: Column, v: Column) -> Column:
    wide = "decimal(19,0)"
    return F.lit(1) + F.call_function("div", (count + 2).cast(wide) * F.lit(UNIT).cast("decimal(10,0)"), (n + 2 * v).cast(wide))


def _looked_up(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of the one row of table that has their keys. Rows of a key are dealt out by their term."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int"))
    copies = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*keys, "salt"]).drop("salt")


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source's words differ from those of others of its language.

    Terms are runs of ASCII letters and wider characters, A-Z lowered; each language keeps those in ``min_docs`` of its
    documents. A source's share of a kept term is 1 + floor(10^9 * (count + 2) / (N + 2 * V)), of N occurrences of V
    terms; two shares p and q are floor((p - q)^2 / (p + q)) apart. Part ``pair`` sums that over all kept terms for each
    other source of the language; part ``term`` has the ``top`` terms with a larger share than in the language. Rank is
    by value, then item. All is whole numbers, so reruns agree.

    Pairs of sources are summed in tiles of terms and sources, so that no task holds a language: the cells that have a
    count go once per block of sources, and the result has a row per pair anyway.

    Null languages, sources and texts count as empty; an empty language or source is one like others. Repeated rows count
    each. Ids are not read, nor other columns, whatever their names. A language that keeps no term gives pairs of value 0
    and no terms. An empty table gives no rows.
    """
    counts = term_counts(docs, text_col, lang_col, source_col)
    # a term has one row per source here
    by_term = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.collect_list(F.struct("source", "n")).alias("cells"))
    kept = materialize(by_term.where((F.col("docs") >= min_docs) | (F.col("term") == "")).drop("docs"), "kept")
    cells = kept.select("lang", "term", "lang_n", F.inline("cells"))
    # the empty terms are the sources' rows: they count for no term
    langs = kept.groupBy("lang").agg(F.sum(F.when(F.col("term") == "", 0).otherwise(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    numbered = totals.withColumn("no", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).withColumn("of", F.count(F.lit(1)).over(Window.partitionBy("lang")))
    sources = materialize(numbered.join(langs, "lang"), "sources")

    named = _looked_up(cells.where("term <> '' and n > 0"), sources, ["lang", "source"])
    p, q = _share_column(F.col("n"), F.col("total"), F.col("v")), _share_column(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    terms = named.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    terms = terms.select("lang", "source", "item", F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    blocks = F.ceil(F.col("of") / TILE_SOURCES).cast("int")
    tiles = F.ceil(F.col("v") / TILE_TERMS).cast("int")
    block = (F.col("no") / TILE_SOURCES).cast("int")

    def both(df: DataFrame) -> DataFrame:
        """A source's rows once per block that it is compared with."""
        other = df.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        return other.withColumn("a", F.least(block, "other")).withColumn("b", F.greatest(block, "other"))

    tile = F.pmod(F.xxhash64("term"), tiles)
    sizes = _looked_up(kept.where("term <> ''").select("lang", "term"), langs, ["lang"]).groupBy("lang", tile.alias("tile")).agg(F.count(F.lit(1)).alias("terms"))
    in_tiles = both(named.withColumn("tile", tile)).select("lang", "a", "b", "tile", "no", "term", "n")
    # columns of their own, as both sides of the pairing come from the same table
    fresh = [F.col(c).alias(c) for c in ("lang", "a", "b", "tile", "no", "source", "total", "v", "terms")]
    at_tiles = both(sources.join(sizes, "lang")).select(*fresh)
    keys = ("lang", "a", "b", "tile")
    gaps = in_tiles.groupBy(*keys).cogroup(at_tiles.groupBy(*keys)).applyInArrow(_tile, "lang string, source string, item string, value long")
    gaps = gaps.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    # a language without kept terms has no tile, but pairs nevertheless
    bare = both(sources.where("v = 0")).select("lang", "a", "b", "no", "source", block.alias("block"))
    left = bare.where("block = a").select("lang", "a", "b", "no", "source")
    right = bare.where("block = b").select(F.col("lang").alias("lang"), F.col("a").alias("a"), F.col("b").alias("b"), F.col("no").alias("other_no"), F.col("source").alias("item"))
    none = left.join(right, ["lang", "a", "b"]).where("no < other_no").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    pairs = gaps.unionByName(none).select("lang", F.inline(F.array(F.struct("source", "item", "value"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), "value"))))
    parts = pairs.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
    return parts.select("lang", "source", "part", "item", "value", "rank")


#: The rows of op13_source_divergence.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), w AS MATERIALIZED (
  SELECT doc_id, lang, source, unnest(list_transform(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS term FROM d
), k AS MATERIALIZED (
  SELECT lang, term, count(*) AS lang_n FROM w GROUP BY lang, term HAVING count(DISTINCT doc_id) >= 10
), l AS (
  SELECT lang, count(*) AS v, sum(lang_n)::HUGEINT AS lang_total FROM k GROUP BY lang
), s AS (
  SELECT DISTINCT lang, source FROM d
), c AS MATERIALIZED (
  SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL
), t AS (
  SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY ALL
), p AS MATERIALIZED (
  SELECT s.lang, s.source, k.term, coalesce(n, 0) AS n,
    1 + 1000000000::HUGEINT * (coalesce(n, 0) + 2) // (coalesce(total, 0) + 2 * v) AS p, 1 + 1000000000::HUGEINT * (lang_n + 2) // (lang_total + 2 * v) AS q
  FROM s JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN t USING (lang, source)
), g AS (
  SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM p x JOIN p y USING (lang, term) WHERE x.source <> y.source GROUP BY ALL
), r AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value FROM s x JOIN s y USING (lang) LEFT JOIN g ON g.lang = x.lang AND g.source = x.source AND g.item = y.source WHERE x.source <> y.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM r QUALIFY part = 'pair' OR rank <= 10
"""
