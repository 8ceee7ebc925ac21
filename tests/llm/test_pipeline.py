"""Stages of the pipeline, one after the other, on real and on awkward documents."""

import collections

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").cache()
    names, counts = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA).cache()
        assert out.columns == names, name
        counts.append((docs.count(), out.count()))
        if name == "language":
            assert out.exceptAll(docs).count() == 0 and counts[-1][1] >= 0.95 * counts[-1][0]
        if name == "near_duplicates":
            from quarry.llm.jaccard import jaccard_components

            assert jaccard_components(out).where("n_shingles > 0 and doc_id <> component_id").count() == 0
            assert {r[0] for r in out.select("doc_id").collect()} == {r[0] for r in jaccard_components(docs).where("doc_id = component_id").select("doc_id").collect()}
        if name == "mixing":
            assert max(collections.Counter(r[0] for r in out.select("doc_id").collect()).values()) <= 3
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
    assert packed.where("start = 0").count() == docs.count()


def test_clashing_names(spark):
    """Columns named like any helper column pass through every stage, and change nothing."""
    extra = ["lang_pred", "score", "__lang_pred", "__score", "__text", "__n_lines", "__n_removed", "n_lines", "__id", "__runs", "__row", "__copies", "__copy", "row", "copies", "piece", "component_id", "size", "runs", "text_", "key", "__key", "__k"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60).cache()
    wide = docs.select("*", *(F.concat(F.lit(f"{c} of "), F.col("doc_id")).alias(c) for c in extra)).cache()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, DATA)
        assert out.columns == wide.columns, name
        assert out.where(F.col("__row") != F.concat(F.lit("__row of "), F.col("doc_id"))).count() == 0
        want = collections.Counter(map(tuple, stage(spark, docs, DATA).collect()))
        assert collections.Counter(map(tuple, out.select(*docs.columns).collect())) == want, name
    assert corpus_pipeline.STAGES[-1][1](spark, wide, DATA).count() == corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count()


def test_awkward(spark):
    rows = [(1, None, "en", "a", 0), (2, "", None, None, 0), (None, "some words are here", "en", "a", 4), (3, "some words are here", "en", "b", 4), (3, "some words are here", "en", "b", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns
        assert stage(spark, docs.limit(0), DATA).count() == 0
