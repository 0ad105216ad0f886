"""Merging ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .vector import top

#: K, weight of the vector list, weight of the keyword list.
PRESETS = {"service": (60, 1.0, 0.72), "classic": (60, 1.0, 1.0)}


def rrf_fuse(vectors: DataFrame, keywords: DataFrame, preset: str = "service") -> DataFrame:
    """(qid, chunk_id, vector_rank, keyword_rank, hybrid_score) of both lists (qid, chunk_id, rank); a missing side adds nothing (H1, H2)."""
    k, wv, wk = PRESETS[preset]
    none = F.lit(None).cast("int")
    lists = vectors.select("qid", "chunk_id", F.col("rank").alias("v"), none.alias("k")).unionByName(keywords.select("qid", "chunk_id", none.alias("v"), F.col("rank").alias("k")))
    both = lists.groupBy("qid", "chunk_id").agg(F.max("v").alias("vector_rank"), F.max("k").alias("keyword_rank"))
    part = lambda w, r: F.coalesce(F.lit(w) / (F.lit(float(k)) + F.col(r)), F.lit(0.0))
    return both.withColumn("hybrid_score", F.round(part(wv, "vector_rank") + part(wk, "keyword_rank"), 6))


def weighted(vectors: DataFrame, keywords: DataFrame, limit: int = 10, weights: tuple[float, float] = (0.6, 0.4)) -> DataFrame:
    """(qid, chunk_id, score, rank): weighted sum of similarity (1 - distance) and kw_score over the union of both lists, each limit * 2 long (V4)."""
    lists = vectors.where(F.col("rank") <= 2 * limit).select("qid", "chunk_id").union(keywords.where(F.col("rank") <= 2 * limit).select("qid", "chunk_id")).distinct()
    rows = lists.join(vectors.select("qid", "chunk_id", "distance"), ["qid", "chunk_id"], "left").join(keywords.select("qid", "chunk_id", "kw_score"), ["qid", "chunk_id"], "left")
    score = F.coalesce(1 - F.col("distance"), F.lit(0.0)) * weights[0] + F.coalesce("kw_score", F.lit(0.0)) * weights[1]
    return top(rows.select("qid", "chunk_id", F.round(score, 6).alias("score")), [F.desc("score"), F.col("chunk_id")], limit)


def dedupe_best(rows: DataFrame, key: str = "citation", score: str = "hybrid_score", group: str = "qid") -> DataFrame:
    """The best row of each key in a group; null keys are one key, ties fall to the smaller chunk_id (H4)."""
    w = Window.partitionBy(group, F.coalesce(key, F.lit(""))).orderBy(F.desc(score), "chunk_id")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def multi_query(rows: DataFrame, each: int = 3, k: int = 5) -> DataFrame:
    """Of rows(qid, sub_no, chunk_id, rank, hybrid_score), the first `each` of every sub-query; a chunk's first occurrence stands; the best k (H5)."""
    w = Window.partitionBy("qid", "chunk_id").orderBy("sub_no", "rank")
    first = rows.where(F.col("rank") <= each).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "rank")
    return top(first, [F.desc("hybrid_score"), F.col("sub_no"), F.col("chunk_id")], k)


def context_lines(rows: DataFrame) -> DataFrame:
    """(qid, context): the ranked chunks of a query as numbered lines."""
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("citation", F.lit("")), F.lit(" ("), F.format_string("%.6f", "hybrid_score"), F.lit(") "), F.coalesce("snippet", F.lit("")))
    return rows.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("context"))
