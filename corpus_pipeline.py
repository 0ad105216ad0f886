"""From raw documents to a training mix, in five stages; each works on all that the one before has kept.

language_id    drops documents without a letter, and those too far from all learned languages (if any was learned)
near_dedup     keeps the document of the smallest doc_id of each group of near copies (Jaccard similarity of 5-word shingles >= 0.8)
substrings     removes passages that an earlier document has
decontaminate  drops documents that hold benchmark passages
mix            decides how often each document is taken to meet the sources' target weights, and returns the documents with that

Nulls: a null text has no letter and goes in the first stage; a null doc_id counts as later than
all others where one of a group is kept. Repeated rows are copies; ties of doc_id fall to a hash of the row. Columns that
documents has beyond its own are kept, whatever their names; those of the mix get underlines ahead where a name is taken.
An empty table gives an empty result. A text of any length is one row of one task: the stages take some 150 bytes of
its memory for each of its words; a stage sets the session to batches of few rows for Python, and run sets it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textquarry.llm import alike, decontaminate, langid, mixing, repeats
from textquarry.llm.tables import drop, few_rows_a_batch, own_batches, settle_at, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    few_rows_a_batch(spark)
    return langid.with_language(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    few_rows_a_batch(spark)
    return alike.one_of_each(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    few_rows_a_batch(spark)
    return repeats.without_repeats(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    few_rows_a_batch(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    few_rows_a_batch(spark)
    return mixing.with_copies(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("substrings", substrings), ("decontaminate", clean), ("mix", mix)]

#: SQL can express neither the profiles nor the similarity search; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    with own_batches(spark):  # what mix returns takes no Python
        for _, stage in STAGES[:-1]:
            docs, path = settle_at(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
            drop(spark, before)
            before = [path]
        return STAGES[-1][1](spark, docs, sf_dir)
