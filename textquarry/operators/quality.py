"""Checks of a corpus and of retrieval: tables of (check_id, ok, observed, expected)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules


def checked(rows: DataFrame, checks: list[tuple[str, Column, str, float]]) -> DataFrame:
    """One pass over rows: each check is (id, aggregate, comparison, expected)."""
    sums = rows.agg(*(c.cast("double").alias(name) for name, c, _, _ in checks))
    compare = {"=": lambda a, b: a == b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b}
    lines = F.array(*(F.struct(F.lit(n).alias("check_id"), F.coalesce(compare[how](F.col(n), F.lit(float(x))), F.lit(False)).alias("ok"), F.col(n).alias("observed"), F.concat(F.lit(f"{how} "), F.lit(f"{x:g}")).alias("expected")) for n, _, how, x in checks))
    return sums.select(F.explode(lines).alias("c")).select("c.*")


def corpus_checks(chunks: DataFrame, width: int, least: int) -> DataFrame:
    """Checks of chunks(chunk_id, chunk_text, citation, embedding, version_name, is_active, status)."""
    seen = F.col("is_active") & (F.col("status") == "active")
    sure = lambda c: F.coalesce(c, F.lit(False))
    return checked(chunks, [
        ("visible_chunks", F.count_if(sure(seen)), ">=", least),
        ("visible_without_vector", F.count_if(sure(seen & F.col("embedding").isNull())), "=", 0),
        ("visible_other_width", F.count_if(sure(seen & (F.size("embedding") != width))), "=", 0),
        ("visible_without_citation", F.count_if(sure(seen & (F.coalesce(F.trim("citation"), F.lit("")) == ""))), "=", 0),
        ("visible_without_text", F.count_if(sure(seen & (F.coalesce(F.trim("chunk_text"), F.lit("")) == ""))), "=", 0),
        ("active_in_other_version", F.count_if(sure(F.col("is_active") & (F.coalesce("status", F.lit("")) != "active"))), "=", 0),
        ("sample_visible", F.count_if(sure(seen & F.col("version_name").contains("sample"))), "=", 0),
        ("active_versions", F.count_distinct(F.when(seen, F.col("version_name"))), ">=", 1),
    ])


def dataset_checks(chunks: DataFrame, expected: DataFrame, logs: DataFrame, width: int, least: int) -> DataFrame:
    """corpus_checks, then those of expected(citation) in the active versions, and that no answer was logged.

    An expected citation fails a check if any of its chunks does. Observed is the number of citations that fail. Expected citations
    are met by a shuffle join on the citation; repeated and null ones count once and not at all.
    """
    there = chunks.where("status = 'active'").groupBy("citation").agg(
        F.min("is_active").alias("active"), F.min(F.col("embedding").isNotNull()).alias("embedded"), F.max(F.col("embedding").isNotNull() & (F.size("embedding") != width)).alias("other_width"), F.lit(True).alias("there")
    )
    found = expected.select("citation").where("citation is not null").distinct().join(there, "citation", "left")
    sure = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    of_citations = checked(found, [
        ("expected_missing", sure(F.col("there").isNull()), "=", 0),
        ("expected_inactive", sure(~F.col("active")), "=", 0),
        ("expected_without_vector", sure(~F.col("embedded")), "=", 0),
        ("expected_other_width", sure("other_width"), "=", 0),
    ])
    return corpus_checks(chunks, width, least).unionByName(of_citations).unionByName(checked(logs, [("answers_logged", F.count("*"), "=", 0)]))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """(key, n) of keys that stand more than once."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def absent(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, side): what is expected and missing, and what is found and wasn't expected."""
    a, b = expected.select(key).distinct(), found.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("unexpected")))


def record_problems(rows: DataFrame, required: list[str], text: str = "text", least: int = 100) -> DataFrame:
    """rows with `problems`: required fields that are empty, a text that is short, a hash that doesn't match."""
    empty = [F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", F.lit(f"no {c}")) for c in required]
    short = F.when(F.length(F.coalesce(text, F.lit(""))) < least, F.lit("short text"))
    wrong = [F.when(F.col("content_hash") != F.sha2(F.coalesce(text, F.lit("")), 256), F.lit("wrong hash"))] if "content_hash" in rows.columns else []
    return rows.withColumn("problems", F.filter(F.array(*empty, short, *wrong), lambda x: x.isNotNull()))


def golden(results: DataFrame, expected: DataFrame, accept: float = 0.85) -> DataFrame:
    """One row of hit rates (E8). results(qid, rank, found_in), expected(qid, match_any array): a result is a hit if a needle is in it."""
    hit = F.exists("match_any", lambda n: F.contains(F.lower("found_in"), F.lower(n)))
    first = expected.select("qid", "match_any").join(results, "qid", "left").groupBy("qid").agg(F.min(F.when(hit, F.col("rank"))).alias("first"))
    rate = lambda k: F.round(F.avg(F.coalesce((F.col("first") <= k).cast("int"), F.lit(0))), 4)
    out = first.agg(F.count("*").alias("n_queries"), rate(1).alias("top1_rate"), rate(3).alias("top3_rate"), rate(5).alias("top5_rate"))
    return out.withColumn("accepted", F.col("top3_rate") >= accept)


def asylum_only(results: DataFrame, first: int = 3) -> DataFrame:
    """(qid): queries whose first three results all cite asylum rules and nothing that clears them."""
    citation = F.coalesce("citation", F.lit(""))
    bare = citation.rlike(f"(?i){rules.ASYLUM_CITATION}") & ~reduce(lambda a, b: a | b, [F.lower(citation).contains(x) for x in rules.NOT_ASYLUM])
    return results.where(F.col("rank") <= first).groupBy("qid").agg(F.count_if(bare).alias("n")).where(F.col("n") == first).select("qid")


def coverage(results: DataFrame, questions: DataFrame, needles: DataFrame, k: int = 5) -> DataFrame:
    """(category, n_queries, n_passing, covered): a query passes if one of its category's needles is in its first k results.

    Where questions have a column `guarded`, a guarded one fails if its first three results (with their citation) are of asylum only.
    """
    rows = questions.select("qid", "category").join(needles.select("category", "needles"), "category", "left").join(results.where(F.col("rank") <= k).select("qid", "rank", "found_in"), "qid", "left")
    ok = F.coalesce(F.exists("needles", lambda n: F.contains(F.lower("found_in"), F.lower(n))), F.lit(False))
    each = rows.groupBy("category", "qid").agg(F.max(ok).alias("ok"))
    if "guarded" in questions.columns:
        failed = questions.where("guarded").select("qid", "category").distinct().join(asylum_only(results), "qid", "left_semi").withColumn("failed", F.lit(True))
        each = each.join(failed, ["qid", "category"], "left").select("category", "qid", (F.col("ok") & F.col("failed").isNull()).alias("ok"))
    return each.groupBy("category").agg(F.count("*").alias("n_queries"), F.count_if("ok").alias("n_passing"), F.max("ok").alias("covered"))


def expected_rank(results: DataFrame, expected: DataFrame) -> DataFrame:
    """(qid, expected_citation, found_rank, rank_1)."""
    rows = expected.join(results.select("qid", "rank", "citation"), "qid", "left")
    place = F.min(F.when(F.startswith("citation", F.col("expected_citation")), F.col("rank")))
    return rows.groupBy("qid", "expected_citation").agg(place.alias("found_rank")).withColumn("rank_1", F.coalesce(F.col("found_rank") == 1, F.lit(False)))


FORBIDDEN = ("question", "answer", "query", "message", "raw_question", "raw_answer", "prompt")


def log_check(log: DataFrame) -> DataFrame:
    """Checks that an audit log holds no text, and hashes of one length."""
    held = [c for c in log.columns if c.lower() in FORBIDDEN]
    sums = checked(log, [("hash_least", F.coalesce(F.min(F.length("question_hash")), F.lit(64)), "=", 64), ("hash_most", F.coalesce(F.max(F.length("question_hash")), F.lit(64)), "=", 64)])
    line = log.sparkSession.range(1).select(F.lit("text_columns").alias("check_id"), F.lit(not held).alias("ok"), F.lit(float(len(held))).alias("observed"), F.lit("= 0").alias("expected"))
    return sums.unionByName(line)


def completeness(manifest: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """One row: how many of the manifest's items there are, and the percentage."""
    rows = manifest.select(key).distinct().join(files.select(key, F.lit(1).alias("there")).distinct(), key, "left")
    return rows.agg(F.count("*").alias("n_expected"), F.count("there").alias("n_found")).withColumn("percent", F.round(100 * F.col("n_found") / F.col("n_expected"), 2))


def missing_sample(manifest: DataFrame, files: DataFrame, key: str, most: int = 10) -> DataFrame:
    """The first few of the manifest's items that aren't there, in order (E12): a report of at most `most` rows."""
    return manifest.select(key).distinct().join(files.select(key).distinct(), key, "left_anti").orderBy(key).limit(most)


def insert_checks(sections: DataFrame, chunks: DataFrame, expected: DataFrame) -> DataFrame:
    """Checks after an insert of sections(section) and chunks(section, is_active, embedding) against expected(section)."""
    want, there = expected.select("section").distinct(), sections.select("section").distinct()
    first = chunks.groupBy("section").agg(F.count_if("is_active").alias("n_active"), F.count("embedding").alias("n_embedded"))
    rows = want.withColumn("wanted", F.lit(1)).join(there.withColumn("there", F.lit(1)), "section", "full").join(first.withColumn("chunked", F.lit(1)), "section", "left")
    return checked(rows, [
        ("missing_sections", F.count_if(F.col("there").isNull()), "=", 0),
        ("unexpected_sections", F.count_if(F.col("wanted").isNull()), "=", 0),
        ("sections_without_chunks", F.count_if(F.col("wanted").isNotNull() & F.col("chunked").isNull()), "=", 0),
        ("active_too_early", F.coalesce(F.sum("n_active"), F.lit(0)), "=", 0),
        ("embedded_too_early", F.coalesce(F.sum("n_embedded"), F.lit(0)), "=", 0),
    ])


def readiness(chunks: DataFrame, width: int, visible: int, citations: list[str], n_logged: int = 0) -> DataFrame:
    """Gates before retrieval is opened (E13), over chunks(citation, embedding, is_active, version_name, status)."""
    seen = F.coalesce(F.col("is_active") & (F.col("status") == "active"), F.lit(False))
    held = [F.max(F.when(seen & (F.col("citation") == c), 1).otherwise(0)) for c in citations]
    return checked(chunks, [
        ("active_versions", F.count_distinct(F.when(F.col("status") == "active", F.col("version_name"))), "=", 1),
        ("visible_chunks", F.count_if(seen), "=", visible),
        ("visible_other_width", F.count_if(F.coalesce(seen & (F.coalesce(F.size("embedding"), F.lit(-1)) != width), F.lit(False))), "=", 0),
        ("missing_citations", F.lit(len(citations)) - sum(held, F.lit(0)), "=", 0),
        ("logged_answers", F.max(F.lit(n_logged)), "=", 0),
    ])


def handoff(chunks: DataFrame, least: int) -> DataFrame:
    """Checks before a corpus is handed over (E5): enough chunks active and embedded, none of a sample, none of case law."""
    ready = F.coalesce(F.col("is_active") & F.col("embedding").isNotNull() & (F.col("status") == "active"), F.lit(False))
    low = F.lower(F.coalesce("version_name", F.lit("")))
    return checked(chunks, [("active_embedded", F.count_if(ready), ">=", least), ("sample_active", F.count_if(ready & low.contains("sample")), "=", 0), ("case_law_active", F.count_if(ready & low.startswith("bia")), "=", 0)])


def summary(rows: DataFrame, group: str, text: str) -> DataFrame:
    """(group, n, n_chars, mean_chars, longest)."""
    size = F.length(text)
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("n_chars"), F.round(F.avg(size), 4).alias("mean_chars"), F.max(size).alias("longest"))


def counts_by_parent(parents: DataFrame, children: DataFrame, key: str, conditions: dict[str, Column]) -> DataFrame:
    """Every parent with its number of children and of those that meet each condition; 0 for none."""
    sums = children.groupBy(key).agg(F.count("*").alias("n"), *(F.count_if(c).alias(name) for name, c in conditions.items()))
    return parents.join(sums, key, "left").na.fill(0, ["n", *conditions])


def latest(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """The first row of each group in an order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where("_n = 1").drop("_n")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
