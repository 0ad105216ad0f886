"""Hybrid retrieval for a batch of questions: vector and keyword lists, fused, boosted, deduplicated and cut."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fulltext, fusion, rerank, scoring, understand
from ..operators.search import Lists, beside
from ..operators.vector import top, vector_topk
from ..sources.kept import kept

META = ("citation", "topic", "subtopic", "official_url")


def retrieve(chunks: DataFrame, posted: DataFrame | Lists, queries: DataFrame, top_k: int = 5, candidates: int = 15, understand_queries: bool = False) -> DataFrame:
    """The best chunks of each query, ranked.

    chunks(chunk_id, chunk_text, citation, topic, subtopic, official_url, version_name, embedding), those visible;
    posted: their stored lists, or postings; queries(qid, query, vector), vector null where only words count.

    Keyword candidates are cut before case law is left out of them, ranks follow the merge with the lists of supplemental phrases,
    the boost comes before deduplication. With understand_queries, the question is replaced by its route's, and
    results are filtered by topic and moved up by source family.
    """
    asked = queries.select("qid", F.col("query").alias("said"), "vector", understand.route("query").alias("r")).select("qid", "said", "vector", "r.*") if understand_queries else queries.select("qid", F.col("query").alias("said"), "vector")
    asked = asked.withColumn("query", F.col("retrieval_query") if understand_queries else F.col("said"))
    meta = chunks.select("chunk_id", *META, "version_name", F.left("chunk_text", F.lit(500)).alias("snippet"))
    words = beside(asked.select("qid", "query"))

    near = vector_topk(chunks, asked.where("vector is not null").select("qid", "vector"), candidates)
    said = fulltext.keyword_topk(posted, asked.select("qid", "query"), candidates)
    law = meta.select("chunk_id", "citation", "topic")
    said = fulltext.without_case_law(law.join(beside(said), "chunk_id").join(words, "qid")).select("qid", "chunk_id", "kw_score")
    phrases = asked.select("qid", F.explode(fulltext.supplemental_phrases("query")).alias("query"))
    extra = fulltext.phrase_topk(posted, phrases.select(F.concat_ws("\x01", F.col("qid").cast("string"), "query").alias("qid"), "query"))
    extra = extra.select(F.split_part("qid", F.lit("\x01"), F.lit(1)).cast(queries.schema["qid"].dataType).alias("qid"), "chunk_id", "kw_score").groupBy("qid", "chunk_id").agg(F.max("kw_score").alias("kw_score"))
    extra = law.join(beside(extra), "chunk_id").where(~fulltext.is_case_law("citation", "topic")).select("qid", "chunk_id", "kw_score")
    keywords = fulltext.merged(said, extra, candidates)

    fused = fusion.rrf_fuse(near, keywords)  # at most 2 * candidates rows a query: small from here on
    rows = meta.join(beside(fused), "chunk_id").join(words, "qid")
    # the boost is one large expression: written out, as the optimizer would carry it through every filter above
    rows = kept(scoring.with_boost(rows).withColumn("hybrid_score", F.round(F.col("hybrid_score") + F.col("boost"), 6)))
    best = top(fusion.dedupe_best(rows), [F.desc("hybrid_score"), F.col("chunk_id")], top_k)
    best = best.withColumn("source_family", rerank.source_family("version_name"))
    if understand_queries:
        routed = beside(asked.select("qid", F.col("topic").alias("query_topic"), "families"))
        best = rerank.family_boost(rerank.topic_filter(best.join(routed, "qid")))
    return best


def retrieve_many(chunks: DataFrame, posted: DataFrame | Lists, questions: DataFrame, top_k: int = 5, each: int = 3) -> DataFrame:
    """Questions that mention several topics asked as several queries, their results merged and reranked by metadata (H5, H6)."""
    asked = understand.rewritten(questions)
    subs = asked.select(F.col("qid").alias("q"), F.posexplode("sub_queries").alias("sub_no", "query"), "vector")
    subs = subs.withColumn("qid", F.concat_ws("\x01", F.col("q").cast("string"), F.col("sub_no").cast("string")))
    found = retrieve(chunks, posted, subs.select("qid", "query", "vector"), each)
    found = found.withColumn("sub_no", F.split_part("qid", F.lit("\x01"), F.lit(2)).cast("int")).withColumn("qid", F.split_part("qid", F.lit("\x01"), F.lit(1)).cast(questions.schema["qid"].dataType)).drop("query")
    merged = fusion.multi_query(found, each, top_k)
    return rerank.metadata_rerank(merged.join(beside(asked.select("qid", "query", "visas", "topics")), "qid"))
