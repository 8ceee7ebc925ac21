"""Exact length histogram of encoded documents, and what suffix sums over it answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, materialize
from .encode import encoder

VOCABULARY = "word_bpe_49k.json"
#: Lengths per block: running sums are made over blocks, then within each.
BLOCK = 128


def encoded_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of every whole text; null text has 0 tokens."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(slices):
        encode_all = encoder(vocabulary).encode_all
        for b in slices:
            yield {"doc_id": b.column(0), "n_tokens": encode_all(b.column(1).to_pylist())[1]}

    return map_rows(rows, run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens long", rows=2048)


def length_histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, n_docs): map tasks combine first, so a length that most documents have is no hot key."""
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per encoded length L that occurs, taken as a context limit.

    n_docs: documents of that length; docs_within, tokens_within: those of L or less; docs_longer: those above;
    tokens_kept: sum of min(length, L), what truncation at L leaves; tokens_lost: what it cuts; quantile: the share of
    documents within L. Between two lengths, and beyond, every answer follows from these rows: see at_limits().
    Null and empty texts have length 0. Whole texts are encoded, however long. Repeated rows, and rows with equal or null
    ids, each count. Other columns, whatever their names, are not read. An empty table gives no rows.
    """
    hist = materialize(length_histogram(encoded_lengths(docs, id_col, text_col, vocabulary)), "histogram").withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_docs") * F.col("n_tokens"))
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # one row per BLOCK lengths: few, whatever the number of documents
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    blocks = blocks.select("block", (F.sum("d").over(later) - F.col("d")).alias("docs_after"), (F.sum("t").over(later) - F.col("t")).alias("tokens_after"), F.sum("d").over(Window.partitionBy()).alias("all_docs"), F.sum("t").over(Window.partitionBy()).alias("all_tokens"))
    inner = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    longer = F.col("docs_after") + F.sum("n_docs").over(inner) - F.col("n_docs")
    beyond = F.col("tokens_after") + F.sum("tokens").over(inner) - F.col("tokens")
    rows = hist.join(blocks, "block").withColumn("docs_longer", longer).withColumn("beyond", beyond)
    within = F.col("all_tokens") - F.col("beyond")
    kept = within + F.col("docs_longer") * F.col("n_tokens")
    docs_within = F.col("all_docs") - F.col("docs_longer")
    return rows.select(
        F.col("n_tokens").alias("context_limit"), "n_docs", docs_within.alias("docs_within"), "docs_longer", within.alias("tokens_within"),
        kept.alias("tokens_kept"), (F.col("all_tokens") - kept).alias("tokens_lost"), (docs_within / F.col("all_docs")).alias("quantile"),
    )


def at_limits(counts: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, docs_within, docs_longer, tokens_kept) for any limits, from token_counts()'s rows."""
    wanted = counts.sparkSession.createDataFrame([(int(x),) for x in limits], "context_limit long")
    c = counts.select(F.col("context_limit").alias("at"), "n_docs")
    pairs = c.crossJoin(F.broadcast(wanted))  # a histogram against a stated list of limits
    return pairs.groupBy("context_limit").agg(
        F.sum(F.when(F.col("at") <= F.col("context_limit"), F.col("n_docs")).otherwise(0)).alias("docs_within"),
        F.sum(F.when(F.col("at") > F.col("context_limit"), F.col("n_docs")).otherwise(0)).alias("docs_longer"),
        F.sum(F.least("at", "context_limit") * F.col("n_docs")).alias("tokens_kept"),
    )


def quantiles(counts: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the smallest length within which that share of documents lies."""
    wanted = counts.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    return counts.crossJoin(F.broadcast(wanted)).where("quantile >= share").groupBy("share").agg(F.min("context_limit").alias("n_tokens"))
