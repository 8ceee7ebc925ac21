"""Very many terms in texts: one automaton, one pass over each text, whatever the number of terms."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Terms of one automaton, which is what is broadcast at a time; longer lists take a pass over the texts per so many.
MOST_TERMS = 100_000
_built: dict[str, object] = {}


def _automaton(key: str, terms: list[str]):
    """The automaton of these terms; a worker builds it once and keeps the last."""
    if key not in _built:
        import ahocorasick

        out = ahocorasick.Automaton()
        for k, term in enumerate(terms):
            out.add_word(term, k)
        out.make_automaton()
        _built.clear()
        _built[key] = out
    return _built[key]


def held_terms(spark: SparkSession, text: Column, terms: list[str]) -> Column:
    """array<string>: the terms that the text holds anywhere, as contains() would say of each, in the order of the list;
    null for null. Terms overlap freely. Time grows with the text and with what is found, not with the list."""
    if any(not x for x in terms) or len(set(terms)) < len(terms) or not terms:
        raise ValueError("terms must be different and not empty")
    shared, key = spark.sparkContext.broadcast(list(terms)), uuid.uuid4().hex

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        names = shared.value
        find = _automaton(key, names).iter
        return texts.map(lambda x: None if x is None else [names[k] for k in sorted({k for _, k in find(x)})])

    return run(text)


def watch(recs: DataFrame, terms: DataFrame) -> DataFrame:
    """recs (table_name, record_id, cells) with ``terms`` that a cell holds, whatever the case: (table_name, record_id, id)
    of a table of terms (id, term) of any length, each record and id once. Terms come to the driver in lots of MOST_TERMS."""
    low = terms.select("id", F.lower("term").alias("term")).where("term <> ''")
    distinct = low.select("term").distinct()
    lots = max(1, -(-distinct.count() // MOST_TERMS))
    # cells are kept apart by a character that no term has
    text = F.array_join(F.transform("cells", lambda c: F.replace(F.lower(c["value"]), F.lit("\0"), F.lit(" "))), "\0")
    out = None
    for lot in range(lots):
        mine = [r["term"] for r in distinct.where(F.pmod(F.xxhash64("term"), F.lit(lots)) == lot).collect()]
        if mine:
            part = recs.select("table_name", "record_id", F.explode(held_terms(recs.sparkSession, text, mine)).alias("term"))
            out = part if out is None else out.unionByName(part)
    if out is None:
        out = recs.select("table_name", "record_id", F.lit(None).cast("string").alias("term")).limit(0)
    return out.join(low, "term").select("table_name", "record_id", "id").distinct()
