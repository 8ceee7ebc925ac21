"""Datasets that reports show, and the insights that go with a search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def search_insights(results: DataFrame, nodes: DataFrame, connections: int = 5, sources: int = 2) -> DataFrame:
    """(kind, subject, value): records per table, ten most frequent entities, and red flags: entities with more than so
    many connections, or in more than so many sources. nodes (id, occurrences, degree, sources)."""
    tables = results.groupBy("table_name").agg(F.count(F.lit(1)).alias("value")).select(F.lit("table").alias("kind"), F.col("table_name").alias("subject"), "value")
    top = nodes.orderBy(F.col("occurrences").desc(), "id").limit(10).select(F.lit("entity").alias("kind"), F.col("id").alias("subject"), F.col("occurrences").alias("value"))
    linked = nodes.where(F.col("degree") > connections).select(F.lit("many_connections").alias("kind"), F.col("id").alias("subject"), F.col("degree").alias("value"))
    spread = nodes.where(F.col("sources") > sources).select(F.lit("many_sources").alias("kind"), F.col("id").alias("subject"), F.col("sources").alias("value"))
    return reduce(DataFrame.unionByName, [tables, top, linked, spread])


def agent_insights(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, subject, value): five best nodes with a count of 2 or more and five best edges with a weight of 2 or more."""
    n = nodes.where("count >= 2").orderBy(F.col("count").desc(), "id").limit(5).select(F.lit("node").alias("kind"), F.col("id").alias("subject"), F.col("count").alias("value"))
    return n.unionByName(edges.where("weight >= 2").orderBy(F.col("weight").desc(), "a", "b").limit(5).select(F.lit("edge").alias("kind"), F.concat_ws("-", "a", "b").alias("subject"), F.col("weight").alias("value")))


def agent_counts(records: DataFrame, entities: DataFrame, shared: DataFrame) -> DataFrame:
    """(kind, n, detail): records and the tables they are from; phones and e-mails if there are several, places if any,
    and how often a phone or an e-mail is shared. records (table_name), entities (type, value), shared (type)."""
    r = records.agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_set("table_name")), ", ").alias("detail")).select(F.lit("records").alias("kind"), "n", "detail")
    e = entities.select(F.when(F.col("type") == "phone", "phones").when(F.col("type") == "email", "emails").when(F.col("type").isin("address", "city"), "places").alias("kind"), "value").where("kind is not null").distinct().groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    e = e.where("n > 1 or kind = 'places'").select("kind", "n", F.lit(None).cast("string").alias("detail"))
    s = shared.where(F.col("type").isin("shared_phone", "shared_email")).groupBy(F.col("type").alias("kind")).agg(F.count(F.lit(1)).alias("n")).select("kind", "n", F.lit(None).cast("string").alias("detail"))
    return r.unionByName(e).unionByName(s)


def findings(patterns: DataFrame, anomalies: DataFrame, threshold: float) -> DataFrame:
    """(kind, id, score, severity): five patterns above .7 and three anomalies above the threshold."""
    s = F.col("significance")
    p = patterns.where(s > 0.7).orderBy(s.desc(), "id").limit(5).select(F.lit("pattern").alias("kind"), "id", s.alias("score"), F.when(s > 0.9, "critical").when(s > 0.8, "high").otherwise("medium").alias("severity"))
    return p.unionByName(anomalies.where(F.col("score") > threshold).orderBy(F.col("score").desc(), "id").limit(3).select(F.lit("anomaly").alias("kind"), "id", "score", F.when(F.col("score") > 1.5 * threshold, "critical").otherwise("high").alias("severity")))


def entity_breakdown(nodes: DataFrame, degree: DataFrame) -> DataFrame:
    """(kind, subject, n): ten most frequent types, ten nodes of the highest degree above five."""
    types = nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "type").limit(10).select(F.lit("type").alias("kind"), F.col("type").alias("subject"), "n")
    return types.unionByName(degree.where("degree > 5").orderBy(F.col("degree").desc(), "id").limit(10).select(F.lit("node").alias("kind"), F.col("id").alias("subject"), F.col("degree").alias("n")))


def strong_relations(edges: DataFrame, most: int = 15) -> DataFrame:
    return edges.where("strength = 'strong' or confidence > 0.8").orderBy(F.col("confidence").desc(), "a", "b").limit(most)


def relation_timeline(entities: DataFrame, rels: DataFrame, ts: str) -> DataFrame:
    """(ts, kind, id, importance): registrations, and relations that are high from a strength of .8."""
    made = entities.select(F.col(ts).alias("ts"), F.lit("registration").alias("kind"), F.col("id"), F.lit("medium").alias("importance"))
    return made.unionByName(rels.select(F.col(ts).alias("ts"), F.lit("relation").alias("kind"), F.concat_ws("-", "a", "b").alias("id"), F.when(F.col("strength") >= 0.8, "high").otherwise("medium").alias("importance")))


def executive_summary(entities: Column, relations: Column, patterns: Column, quality: Column) -> Column:
    return F.format_string("%d entities, %d relations, %d patterns; data quality %.0f %%", entities, relations, patterns, 100 * quality)
