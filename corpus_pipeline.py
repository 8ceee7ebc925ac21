"""A cleaning pipeline over documents: language, repeated lines, near duplicates, mix, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import jaccard, langid, line_dedup, mixing, packing
from quarry.llm.common import discard, free_names, materialize
from quarry.llm.queries import reach

#: A document whose language is less certain than this, or that has no letter, goes.
MIN_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified, all columns and values as they are.

    Learns from all rows with a text and a ``lang``; the text alone is judged. Null and empty texts, texts without a
    letter and those of no certain language go, and so does everything if no row has a language. Repeated rows are judged
    alike and each stays or goes; of languages equally likely the first by name counts. Any further column passes through,
    whatever its name. An empty table gives no rows.
    """
    reach(spark)
    names = docs.columns
    models = langid.train(docs, "text", "lang")
    lang, score = free_names(names, "lang_pred", "score")
    found = langid.predict(docs, models, "doc_id", "text", keep=names, lang_pred=lang, score=score)
    return found.where((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= MIN_SCORE)).select(*names)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later runs of repeated lines go; a document of which no line is left goes too.

    Null, empty and blank texts have no line that could go and stay as they are, as do rows without an id. ``n_chars``
    is set anew where lines went. Rows that repeat an id and its text count as one document; of equal runs that of the
    least id, then of the least text hash, then of the least place stays. Any further column passes through, whatever its name. An empty table gives no rows.
    """
    reach(spark)
    names = docs.columns
    n_lines, n_removed = free_names(names, "n_lines", "n_removed")
    out = line_dedup.line_dedup(docs, n_lines=n_lines, n_removed=n_removed)
    cut, lines = F.col(n_removed), F.col(n_lines)
    left = out.where(~((cut > 0) & (cut == lines)))
    return left.select(*(F.when(cut > 0, F.length("text").cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in names))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the least id, a null id counting as least.

    Null, empty and wordless texts are in no group and stay. Of rows that repeat an id and text any one stays. All
    columns pass through, whatever their names. An empty table gives no rows.
    """
    reach(spark)
    # rows are told apart by a number, as ids may repeat
    row, id_ = free_names(docs.columns, "row", "id")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    groups = jaccard.jaccard_components(numbered, row).select(F.col("doc_id").alias(row), "component_id")
    ids = numbered.select(row, F.col("doc_id").alias(id_))
    stay = groups.join(ids, row).groupBy("component_id").agg(F.min(F.struct(id_, row)).alias("least")).select(F.col(f"least.{row}").alias(row))
    return numbered.join(stay, row, "left_semi").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes; those it does not take go.

    Null, empty and wordless texts have no words to take and go. A null ``source`` is a source. Rows that repeat an id
    are documents of their own; ties in the random ranking go by the row's number. All columns pass through, whatever
    their names. An empty table gives no rows.
    """
    reach(spark)
    row, copies, copy = free_names(docs.columns, "row", "copies", "copy")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    mixed = mixing.mix(numbered, row).where("copies > 0").select(F.col("doc_id").alias(row), F.col("copies").alias(copies))
    taken = numbered.join(mixed, row).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))))
    return taken.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences.

    Null and empty texts are the end id alone; longer ones than a sequence are cut. Repeated rows are packed once each.
    Only ``doc_id`` and ``text`` are read, so further columns of any name do no harm. An empty table gives no rows.
    """
    reach(spark)
    return packing.best_fit_packing(docs)


STAGES = [
    ("language", language_stage),
    ("lines", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        if k:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Predictions and packing are no SQL; tests hold every stage against a plain version.
ORACLE_SQL = None
