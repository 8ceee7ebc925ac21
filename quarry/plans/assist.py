"""Texts that a language model may write: every function takes a model or none, and has a rule for when it fails.

A model is any callable from a prompt to a JSON text; nothing here needs one. What is sent is bounded: summaries that
Spark has aggregated, and a few rows per table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_string
from ..operators import extract as X
from ..operators.patterns import report_risk

Model = Callable[[str], str]
#: Rows of each table that a question is answered from.
ROWS_ASKED = 50
# What is said where no model answers.
NO_NARRATIVE = {"summary": "Unable to generate narrative. Please check data.", "timeline": [], "keyEntities": [], "potentialLeads": [], "riskAssessment": "Unknown"}
NO_CROSS_CASE = {"similarCases": [], "commonSuspects": [], "commonLocations": [], "modusOperandi": [], "recommendedActions": []}
NO_ANSWER = {"answer": "Unable to process query. Please try again.", "relevantRecords": [], "suggestedQueries": []}
SUGGESTED = ["Show all records with missing contact information", "Find duplicate names across tables", "List records by date range", "Show high-value transactions"]


def asked(model: Model | None, prompt: str, otherwise):
    """The first JSON value of the model's answer if it is of the same kind as ``otherwise``, else that."""
    if model is None:
        return otherwise
    try:
        found = re.search(r"\{.*\}|\[.*\]", model(prompt), re.DOTALL)
        value = json.loads(found.group()) if found else otherwise
    except Exception:  # a model is foreign code; its failure is a stated result
        return otherwise
    return value if isinstance(value, type(otherwise)) else otherwise


def sample_rows(tables: dict[str, DataFrame], most: int = ROWS_ASKED) -> dict[str, list[dict]]:
    """The first rows of each table by its own columns' order, for a prompt."""
    return {n: [json.loads(x) for x in df.orderBy(*[c for c, t in df.dtypes if not t.startswith("map")]).limit(most).toJSON().collect()] for n, df in tables.items()}


def _prompt(task: str, data) -> str:
    return f"{task}\n{json.dumps(data, ensure_ascii=False, default=str)}"


def narrative(facts: dict, model: Model | None = None) -> dict:
    return asked(model, _prompt("Tell what these findings show.", facts), NO_NARRATIVE)


def cross_case(cases: dict, model: Model | None = None) -> dict:
    return asked(model, _prompt("Compare these cases.", cases), NO_CROSS_CASE)


def red_flags(facts: dict, model: Model | None = None) -> list[dict]:
    return list(asked(model, _prompt("List red flags.", facts), {"insights": []}).get("insights") or [])


def answer(question: str, tables: dict[str, DataFrame], model: Model | None = None) -> dict:
    return asked(model, _prompt(question, sample_rows(tables) if model else {}), NO_ANSWER)


def suggested_queries(facts: dict, model: Model | None = None) -> list[str]:
    return asked(model, _prompt("Suggest ten questions.", facts), SUGGESTED)


def extracted(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", kinds: list[str] | None = None) -> DataFrame:
    """(doc, type, value, confidence) of each text: a model's entities, called per text on the executors, or the patterns'.
    kinds: the types wanted, all if none; no pattern of another type is tried."""
    # spellings of one value are one
    rules = F.array_distinct(F.transform(X.found(F.col(text_col), kinds=kinds), lambda e: F.struct(e["type"].alias("type"), e["normalized"].alias("value"), e["confidence"].alias("confidence"))))
    if model is None:
        return docs.select(F.col(id_col).alias("doc"), F.inline(rules))

    @F.udf("array<struct<type: string, value: string, confidence: double>>")
    def ask(text):
        got = asked(model, _prompt("List the entities as type, value and confidence.", text or ""), {"entities": None}).get("entities")
        return None if got is None else [(str(e.get("type")), str(e.get("value")), float(e.get("confidence") or 0)) for e in got if isinstance(e, dict)]

    # the rule where the model gives nothing
    out = docs.select(F.col(id_col).alias("doc"), ask(text_col).alias("said"), rules.alias("rules")).select("doc", F.inline(F.coalesce("said", "rules")))
    return out.where(F.col("type").isin(kinds)) if kinds else out


def disambiguated(entities: DataFrame, model: Model | None = None) -> DataFrame:
    """(type, value, meant): spellings of one entity under one name: a model's choice among those that are equal when
    normalised, or the most frequent, then first by the alphabet."""
    counts = entities.groupBy("type", "value").agg(F.count(F.lit(1)).alias("n")).withColumn("k", normalize_string(F.col("value")))
    best = counts.groupBy("type", "k").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("meant"), F.count(F.lit(1)).alias("spellings"), F.slice(F.sort_array(F.collect_set("value")), 1, 20).alias("some"))
    if model is not None:

        @F.udf("string")
        def ask(some, meant):
            return asked(model, _prompt("Which of these names is meant?", some), {"value": meant}).get("value") or meant

        best = best.withColumn("meant", F.when(F.col("spellings") > 1, ask("some", "meant")).otherwise(F.col("meant")))
    return counts.join(best, ["type", "k"]).select("type", "value", "meant")


def ranked_terms(terms: list[str], model: Model | None = None) -> list[tuple[str, int]]:
    """(term, priority), most important first; 5 for what no model ranks."""
    got = asked(model, _prompt("Rank these search terms from 1 to 10.", terms), {})
    known = {str(k): int(v) for k, v in got.items() if isinstance(v, (int, float))}
    return sorted(((t, known.get(t, 5)) for t in terms), key=lambda x: (-x[1], terms.index(x[0])))


def report(query: str, results: DataFrame, entities: DataFrame, flags: list[str], model: Model | None = None) -> DataFrame:
    """(section, position, text) of a report. entities (value, type, occurrences). Counts are aggregated, and of entities
    the five most frequent are named; a model may replace the text of any section by a JSON object of section -> text."""
    spark = results.sparkSession
    risk = report_risk(F.col("n"), F.lit(len(flags)))
    total = results.agg(F.count(F.lit(1)).alias("n")).select("n", risk.alias("risk")).first()
    kinds = entities.groupBy("type").agg(F.sum("occurrences").alias("n")).orderBy("type").collect()
    top = entities.orderBy(F.col("occurrences").desc(), "value").limit(5).collect()
    rows = [
        ("title", f"Report: {query}"), ("summary", f"The search {query} returned {total['n']} results."), ("method", "Pattern extraction, iterative search and correlation; no model was asked."),
        *(("finding", f) for f in flags), *(("entities", f"{r['type']}: {r['n']}") for r in kinds), *(("key_entity", f"{r['type']} {r['value']}: {r['occurrences']} occurrences") for r in top),
        *(("recommendation", r) for r in ("Review search results manually", "Expand search criteria if needed")), ("risk", total["risk"]),
    ]
    told = asked(model, _prompt("Write these sections of a report.", rows), {})
    rows = [(s, str(told[s]) if s in told and [x for x, _ in rows].count(s) == 1 else x) for s, x in rows]
    return spark.createDataFrame([(s, i, x) for i, (s, x) in enumerate(rows)], "section string, position int, text string")
