"""The pipeline's language_id stage: nothing learned, and texts in no learned language."""

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string"


def test_nothing_learned_drops_only_letterless_texts(spark):
    rows = [(1, "some words", None), (2, None, None), (3, "12 !", None), (4, "andere Wörter", None)]
    found = corpus_pipeline.language_id(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(r.doc_id for r in found.collect()) == [1, 4]


def test_other_languages_are_rejected(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    greek = "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα " * 20
    noise = "qxzj vkqw zzxq jqkx wvvq xkjz qqzw " * 60
    more = spark.createDataFrame([(-1, greek, None), (-2, noise, None)], SCHEMA)
    found = {r.doc_id for r in corpus_pipeline.language_id(spark, docs.unionByName(more), "").collect()}
    assert found == {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
