"""One query per operator over whole tables, with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, divergence, exact_dedup, jaccard, langid, line_dedup, lm_score, mixing, packing, periodic_runs, quality, suffix_dedup, token_counts
from .common import WORD


def reach(spark: SparkSession) -> None:
    """Let workers on this machine import the package from where the driver has it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{paths}" if paths else root


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reach(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (null for null text) per document."""
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents")).drop("kept")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_score(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the formatted text of each conversation says when it is read back, of an imitation of the template too."""
    imitation = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(chat_format.IMITATION).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(imitation)
    return chat_format.read_back(chat_format.chat_format(turns))


def _with_period(doc_id: Column, text: Column) -> Column:
    """The text, which in one document of ten goes on periodically from some word on, as the id's hash says."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    words, g = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), F.floor(h / 10)

    def made(ws: Column) -> Column:
        n = F.size(ws).cast("long")
        a = F.pmod(g, n)
        p = F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))) + 1
        period = F.slice(ws, (a + 1).cast("int"), p.cast("int"))
        tail = F.flatten(F.array_repeat(period, F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.concat(F.slice(ws, F.lit(1), a.cast("int")), F.slice(tail, F.lit(1), (n - a).cast("int"))), " ")

    # an array of one, so that the words are split once and not once per word
    return F.when((h % 10 == 0) & text.rlike(WORD), F.transform(F.array(words), made)[0]).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of each document, some of which are made periodic first: how many, the greatest, digests of all and of the rest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", _with_period(F.col("doc_id"), F.col("text")).alias("text"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    out = periodic_runs.periodic_runs(docs).withColumn("b", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("b.start")).alias("start"), F.col("b.length").alias("length"), (-F.col("b.period")).alias("period"),
        F.expr("1000 * b.length div -b.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_line_dedup, op2_language_id, op3_exact_dedup, op4_ngram_jaccard, op5_suffix_dedup, op6_best_fit_packing, op7_source_mixing, op8_lm_score, op9_quality_rules, op10_token_counts, op11_chat_formatting, op12_periodic_runs, op13_source_divergence)
}
ORACLES: dict[str, str] = {
    "op1_line_dedup": line_dedup.ORACLE_SQL, "op3_exact_dedup": exact_dedup.ORACLE_SQL, "op4_ngram_jaccard": jaccard.ORACLE_SQL, "op5_suffix_dedup": suffix_dedup.ORACLE_SQL, "op7_source_mixing": mixing.ORACLE_SQL,
    "op11_chat_formatting": chat_format.ORACLE_SQL, "op12_periodic_runs": periodic_runs.ORACLE_SQL, "op13_source_divergence": divergence.ORACLE_SQL,
}
