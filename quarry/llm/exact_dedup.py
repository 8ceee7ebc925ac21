"""Exact dedup by skew-safe combining, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_from, materialize, text_or_empty


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32, normalise=None) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Equal texts form a group and the row with the largest id stays. Three stages, each comparing the whole text and not
    its digest alone: (1) map tasks combine their own equal texts; (2) what is left meets by digest, salt and text, so
    that a group of any size is spread over ``salts`` tasks; (3) the salts' winners meet by digest and text. Members then
    look their group up: by digest if it has one text, by text too where two texts share a digest.

    normalise: Column -> Column, applied to the text first; by default texts are equal when identical.
    Null text counts as empty. A null id is never larger than another; a group of null ids keeps null. Rows that repeat
    an id and text all count, and all those with the kept id are kept. An empty table gives no rows. Other columns are
    not read.
    """
    text: Column = text_or_empty(text_col)
    if normalise is not None:
        text = F.coalesce(normalise(text), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))

    salted = rows.groupBy("digest", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt"), "text").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    classes = salted.groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    # no text here: one row per digest that several rows share
    groups = classes.groupBy("digest").agg(F.count(F.lit(1)).alias("n_texts"), F.max("keep_id").alias("keep_id"), F.sum("n").alias("n")).where("n > 1")
    groups = materialize(groups, "groups")
    sums = groups.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n_texts"), F.lit(1))).first()
    total, clash = int(sums[0]), int(sums[1]) > 1

    group = F.struct("keep_id", F.col("n").alias("group_size")).alias("g")
    single = groups.where("n_texts = 1")
    hot = single.where(F.col("n") >= hot_from(total)).select("digest", group.alias("hot"))
    rest = single.where(F.col("n") < hot_from(total)).select("digest", group.alias("cold"))

    found = rows.join(F.broadcast(hot), "digest", "left")
    # rows that have found their hot group look for nothing more; a key of their own deals them out evenly
    key = F.when(F.col("hot").isNull(), F.col("digest")).otherwise(F.concat(F.col("digest"), F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")))
    found = found.withColumn("key", key)
    if clash:
        several = groups.where("n_texts > 1").select("digest").join(classes, "digest").select(F.col("digest").alias("key"), "text", F.struct("keep_id", F.col("n").alias("group_size")).alias("own"))
        found = found.join(several, ["key", "text"], "left")
    else:
        found = found.withColumn("own", F.lit(None).cast(found.schema["hot"].dataType))
    found = found.select("id", "digest", "key", "hot", "own").join(rest.withColumnRenamed("digest", "key"), "key", "left")
    g = F.coalesce("own", "hot", "cold")
    keep = F.when(g.isNull(), F.col("id")).otherwise(g["keep_id"])
    return found.select(
        F.col("id").alias("doc_id"),
        keep.alias("keep_id"),
        F.coalesce(g["group_size"], F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


ORACLE_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
