"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

#: Weights that sources take in turn, in code-point order.
WEIGHTS = (1, 2, 3)
#: Inclusion odds follow a document's size against the mean of its source, up to so many times more or less.
TILT = 8
#: Slices of the ranking variable per source at least, and rows of the largest slice about. A slice of n holds at most
#: TILT / n of a source's rows, as the ranking variable is a uniform one whose odds are at most TILT times other ones.
SLICES, SLICE_ROWS = 4096, 1_000_000
#: Up to so many sources their plan is broadcast; beyond, no source can be large and both sides are shuffled.
BROADCAST_SOURCES = 50_000


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = 3.0) -> DataFrame:
    """(source, source_size, ...) -> with target: all words shared by weight, none above cap times its own size.

    The excess of capped sources is shared by weight until none is above. With sources ordered by cap size per weight,
    those up to some place are capped and the others share what is left; the level is the largest that any place gives.
    The table has one row per source, so one task orders it.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sources.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double")).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    filled = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - (F.sum("most").over(filled) - F.col("most"))) / (F.sum("w").over(whole) - (F.sum("w").over(filled) - F.col("w")))
    return weighed.withColumn("level", level).withColumn("level", F.max("level").over(whole)).select(*sources.columns, F.least(F.col("most"), F.col("w") * F.col("level")).cast("double").alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: float = 3.0, seed: str = "") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies.

    A source whose target is r times its size takes every document floor(r) times for certain. The rest, r - floor(r) of
    its words, is a sample with unequal probabilities: documents are ranked by random odds u / (1 - u) over inclusion
    odds, and the source takes from the front as many as come nearest to the words still wanted. Inclusion odds are in
    proportion to a document's size over the mean of its source, within TILT times either way, so that words rather than
    documents have like chances; their common factor, which the share of the source sets, has no bearing on the order.
    u is a hash of the id (and seed), so reruns agree. Whole documents only; at the end one document per source, that
    whose size is nearest to what is missing or too much, is added or left out if that brings the source nearer to its
    target.

    The running sum over a source is made in two levels, so that a source of any share of the rows is never in one task:
    sums of slices of the ranking variable, then rows within a slice.

    Null text has size 0; documents of size 0 take 0. Null source is a source, ordered last. Rows that repeat an id rank
    alike and are counted one by one. An empty table gives no rows. Other columns are not read.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size"))
    sized = materialize(sized, "sizes")
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("n")), weights, cap)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = targets.withColumn("copies", F.floor(ratio)).withColumn("p", ratio - F.col("copies")).withColumn("wanted", F.col("target") - F.col("copies") * F.col("source_size"))

    plan = materialize(plan, "targets")
    side = F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan
    same_source = F.col("a.source").eqNullSafe(F.col("b.source"))
    ranked = sized.alias("a").join(side.alias("b"), same_source).select("a.doc_id", "a.source", "a.size", "b.source_size", "b.n", "b.target", "b.copies", "b.p", "b.wanted")
    u = _uniform(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    mean = F.col("source_size") / F.col("n")
    tilt = F.when(F.col("size") > 0, F.greatest(F.lit(1.0 / TILT), F.least(F.lit(float(TILT)), F.col("size") / mean))).otherwise(F.lit(1.0))
    odds = (F.col("u") / (1 - F.col("u"))) / tilt
    slices_ = max(SLICES, -(-sized.count() * TILT // SLICE_ROWS))
    ranked = ranked.withColumn("u", u).withColumn("v", odds / (1 + odds)).withColumn("slice", F.floor(F.col("v") * slices_)).drop("u", "n")

    running = Window.partitionBy("source").orderBy("slice")
    slices = ranked.groupBy("source", "slice").agg(F.sum("size").alias("words")).withColumn("before", F.sum("words").over(running) - F.col("words")).drop("words")
    joined = ranked.alias("a").join(slices.alias("b"), same_source & (F.col("a.slice") == F.col("b.slice"))).select("a.*", "b.before")
    within = Window.partitionBy("source", "slice").orderBy("v", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.col("before") + F.sum("size").over(within) - F.col("size") / 2
    first = joined.withColumn("extra", ((F.col("size") > 0) & (middle <= F.col("wanted"))).cast("long")).withColumn("rank", F.row_number().over(within))
    first = materialize(first, "first")
    # a large document where the source stops can leave a gap; the one document that closes it best is added or left out
    gaps = first.groupBy("source").agg(F.sum(F.col("size") * F.col("extra")).alias("extra_words"), F.first("wanted").alias("goal")).select("source", (F.col("goal") - F.col("extra_words")).alias("gap"))
    left = F.abs(F.abs("b.gap") - F.col("a.size"))
    open_ = (F.col("a.size") > 0) & (F.col("a.p") > 0) & (left < F.abs("b.gap")) & (F.col("a.extra") == F.when(F.col("b.gap") > 0, 0).otherwise(1))
    small = lambda x: F.broadcast(x) if side is not plan else x  # noqa: E731  one row per source
    best = first.alias("a").join(small(gaps).alias("b"), same_source).where(open_).groupBy("a.source").agg(F.min(F.struct(left.alias("left"), "a.v", "a.doc_id", "a.slice", "a.rank")).alias("best"))
    closed = first.alias("a").join(small(best).alias("b"), same_source & (F.col("a.slice") == F.col("b.best.slice")) & (F.col("a.rank") == F.col("b.best.rank")), "left")
    extra = F.when(F.col("b.best").isNotNull(), 1 - F.col("a.extra")).otherwise(F.col("a.extra"))
    copies = F.when(F.col("a.size") > 0, F.col("a.copies") + extra).otherwise(F.lit(0)).cast("long")
    return closed.select("a.doc_id", "a.size", "a.source_size", "a.target", (F.col("a.size") * copies).alias("taken"), copies.alias("copies"))


def _uniform(text: Column) -> Column:
    """In (0, 1), from the first 52 bits of md5."""
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count_if(size > 0) AS n FROM d GROUP BY source
), w AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w, source_size * CAST(3 AS DOUBLE) AS most FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () - (sum(most) OVER (ORDER BY most / w, source NULLS LAST) - most))
          / (sum(w) OVER () - (sum(w) OVER (ORDER BY most / w, source NULLS LAST) - w)) AS lev FROM w
), t AS (
  SELECT source, source_size, n, least(most, w * (max(lev) OVER ())) AS target FROM l
), p AS (
  SELECT *, CAST(floor(r) AS BIGINT) AS whole, r - floor(r) AS p, target - floor(r) * source_size AS wanted
  FROM (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS r FROM t)
), q AS (
  SELECT d.doc_id, d.source, d.size, p.source_size, p.target, p.whole, p.p, p.wanted,
         o / (1 + o) AS v
  FROM (SELECT *, (CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM d) d
  JOIN p ON d.source IS NOT DISTINCT FROM p.source,
  LATERAL (SELECT (d.u / (1 - d.u)) / CASE WHEN d.size > 0 THEN greatest(0.125::DOUBLE, least(8::DOUBLE, d.size::DOUBLE / (p.source_size::DOUBLE / p.n::DOUBLE))) ELSE 1::DOUBLE END AS o)
)
, e AS (
  SELECT *, CASE WHEN size > 0 AND sum(size) OVER o - size / 2.0 <= wanted THEN 1 ELSE 0 END AS extra, row_number() OVER o AS rank
  FROM q WINDOW o AS (PARTITION BY source ORDER BY v, doc_id ROWS UNBOUNDED PRECEDING)
), g AS (
  SELECT *, wanted - sum(size * extra) OVER (PARTITION BY source) AS gap FROM e
), c AS (
  SELECT *, size > 0 AND p > 0 AND abs(abs(gap) - size) < abs(gap) AND extra = CASE WHEN gap > 0 THEN 0 ELSE 1 END AS open FROM g
), n AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY open DESC, abs(abs(gap) - size), v, doc_id) AS place FROM c
)
SELECT doc_id, size, source_size, target,
       size * (whole + CASE WHEN open AND place = 1 THEN 1 - extra ELSE extra END) AS taken
FROM n
"""
