"""Files: CSV with provenance, ranked CSV, JSON, and bounded logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Columns that lead an export, in this order; the rest follows by name.
STANDARD_ORDER = (
    "id", "name", "first_name", "last_name", "full_name", "company_name", "company", "designation", "phone", "mobile", "mobile1", "mobile2", "email", "email1", "email2",
    "address", "add1", "add2", "city", "district", "state", "country", "pincode", "zip", "website", "pan_number", "account_number", "ifsc_code", "amount", "date",
)
PROVENANCE = ("_matched_criteria", "_passed_filters", "_relevance_score", "_table")


def export_columns(columns: list[str]) -> list[str]:
    """Record columns in standard order, then by name."""
    low = {c.lower(): c for c in columns}
    first = [low[c] for c in STANDARD_ORDER if c in low]
    return first + sorted(c for c in columns if c not in first)


def ranked(results: DataFrame, record_columns: list[str], score: str = "score") -> DataFrame:
    """Rank, Table, Match Score, Match Count, Is Exact Match, Matched Criteria, then the record's columns."""
    order = Window.orderBy(F.col("is_exact").desc(), F.col(score).desc(), "table_name", "record_id")
    # the export is one ranked list, so its rows are few; a bounded top is to be taken before
    return results.select(
        F.row_number().over(order).alias("Rank"), F.col("table_name").alias("Table"), F.round(score).cast("long").alias("Match Score"), F.col("match_count").alias("Match Count"),
        F.when(F.col("is_exact"), "Yes").otherwise("No").alias("Is Exact Match"), F.array_join("matched_criteria", "; ").alias("Matched Criteria"), *export_columns(record_columns),
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def with_provenance(results: DataFrame, record_columns: list[str]) -> DataFrame:
    """All record columns and where they come from, for write_csv()."""
    return results.select(*record_columns, F.array_join("matched_criteria", "; ").alias("_matched_criteria"), F.array_join("passed_filters", "; ").alias("_passed_filters"), F.col("score").alias("_relevance_score"), F.col("table_name").alias("_table"))


def latest(df: DataFrame, ts: str, tie: str, most: int = 50) -> DataFrame:
    """The newest rows of a log."""
    return df.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(most)


def latest_per(df: DataFrame, key: Column | str, ts: str, tie: str, most: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.col(ts).desc(), F.col(tie).desc())
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most).drop("__r")
