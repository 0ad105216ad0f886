"""Reordering and filtering the ranked rows of each query."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import has_any, matches
from .scoring import any_pattern


def _count(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(c, 1).otherwise(0) for c in conditions], F.lit(0))


def _asked(names: str, name: str) -> Column:
    return F.array_contains(names, name)


def metadata_rerank(rows: DataFrame) -> DataFrame:
    """rows(qid, query, visas, topics, chunk_id, citation, topic, snippet, hybrid_score) with scores by matching metadata, ranked anew (H6).

    Each matching visa, topic and form adds its weight, a section of an asked visa in the citation
    adds once; a row that matches none of visas, topics and forms has its score cut, whatever its section.
    """
    text = lambda *cols: F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in cols)))
    low, topical, formal = text("citation", "topic", "snippet"), text("topic", "snippet"), text("citation", "snippet")
    tight = F.translate(low, "- ", "")
    has_topic = F.coalesce("topic", F.lit("")) != ""
    visa = _count([_asked("visas", v) & has_topic & (tight.contains(v.lower().replace("-", "").replace(" ", "")) | has_any(low, [s.lower() for s in rules.VISA_SECTIONS.get(v, [])])) for v in rules.VISA_PATTERNS])
    topic = _count([_asked("topics", t) & has_any(topical, ws) for t, ws in rules.TOPIC_KEYWORDS.items()])
    asked = F.lower("query")
    form = _count([matches(asked, rf"\b{f.lower()}\b") & formal.contains(f.lower()) for f in rules.FORMS])
    cite = F.lower(F.coalesce("citation", F.lit("")))
    section = reduce(lambda a, b: a | b, [_asked("visas", v) & has_any(cite, [s.lower() for s in ss]) for v, ss in rules.VISA_SECTIONS.items()])
    n = visa + topic + form
    better = F.col("hybrid_score") + visa * rules.VISA_WEIGHT + topic * rules.TOPIC_WEIGHT + form * rules.FORM_WEIGHT + F.when(section, rules.SECTION_WEIGHT).otherwise(0.0)
    scored = rows.withColumn("hybrid_score", F.round(F.when(n == 0, F.col("hybrid_score") * rules.NO_MATCH).otherwise(better), 6))
    return ranked(scored)


def ranked(rows: DataFrame, score: str = "hybrid_score") -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(score), "chunk_id")))


def classified(rows: DataFrame) -> DataFrame:
    """rows(query_topic, citation, topic, subtopic, snippet, source_family) with cls: keep, hard_reject, soft_reject or neutral (H7)."""
    text = F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("citation", "topic", "subtopic", "snippet")))
    cls = F.lit("neutral")
    for topic, patterns in rules.TOPIC_CLASSES.items():
        own = F.lit("neutral")
        for name, pattern in reversed(patterns):
            seen = F.concat_ws(" ", text, F.coalesce("source_family", F.lit(""))) if topic == "f1_cpt" and name == "hard_reject" else text
            own = F.when(matches(seen, pattern), name).otherwise(own)
        if topic == "stem_opt":  # a section that only counts with words of its own
            own = F.when(~matches(text, patterns[0][1]) & matches(text, rules.STEM_SECTION) & ~matches(text, rules.STEM_TERMS), "hard_reject").otherwise(own)
        if topic == "i485_advance_parole":
            own = F.when((own == "neutral") & matches(text, rules.PAROLE_SECTION) & matches(text, rules.PAROLE_TERMS), "keep").otherwise(own)
        cls = F.when(F.col("query_topic") == topic, own).otherwise(cls)
    return rows.withColumn("cls", cls)


def three_tier_filter(rows: DataFrame, by: str = "qid") -> DataFrame:
    """Of each group the rows to keep, or else those not rejected, or else all (H8)."""
    w = Window.partitionBy(by)
    tier = F.when(F.col("cls") == "keep", 2).when(~F.col("cls").isin("hard_reject", "soft_reject"), 1).otherwise(0)
    return rows.withColumn("_tier", tier).withColumn("_best", F.max("_tier").over(w)).where("_tier = _best").drop("_tier", "_best")


def topic_filter(rows: DataFrame) -> DataFrame:
    """classified and three_tier_filter; rows of queries without a topic of TOPIC_CLASSES all stay. Ranks aren't renumbered."""
    return three_tier_filter(classified(rows))


def family_boost(rows: DataFrame, weight: float = rules.FAMILY_BOOST) -> DataFrame:
    """Adds weight to rows whose source_family is in `families`, and ranks anew; queries without such a row stay as they are."""
    own = F.coalesce(F.array_contains("families", F.col("source_family")), F.lit(False))
    some = F.max(own).over(Window.partitionBy("qid"))
    scored = rows.withColumn("_some", some).withColumn("hybrid_score", F.when(own, F.round(F.col("hybrid_score") + weight, 6)).otherwise(F.col("hybrid_score")))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("hybrid_score"), "rank", "chunk_id"))
    return scored.withColumn("rank", F.when(F.col("_some"), place).otherwise(F.col("rank"))).drop("_some")


def source_family(version: Column | str) -> Column:
    version = F.col(version) if isinstance(version, str) else version
    low, out = F.lower(version), F.lit("other")
    for prefixes, family in reversed(rules.FAMILIES):
        out = F.when(reduce(lambda a, b: a | b, [low.startswith(p) for p in prefixes]), family).otherwise(out)
    return F.when((version.isNull()) | (version == ""), F.lit(None).cast("string")).otherwise(out)


def active_families(versions: DataFrame) -> DataFrame:
    """One row: names of the active versions and their distinct families, both in order of id."""
    rows = versions.where("status = 'active'").select("id", "version_name", source_family("version_name").alias("family"))
    names = F.transform(F.array_sort(F.collect_list(F.struct("id", "version_name", "family"))), lambda x: x)
    return rows.agg(names.alias("rows")).select(F.array_join(F.transform("rows", lambda x: x["version_name"]), ", ").alias("summary"), F.array_join(F.array_distinct(F.transform("rows", lambda x: x["family"])), ", ").alias("families"))


def weak(rows: DataFrame, least: float = 0.017, short: int = 80) -> DataFrame:
    """(qid, weak): a low best score, or three of the first five snippets short (H13). Queries without rows don't appear."""
    few = F.count_if((F.col("rank") <= 5) & (F.length(F.coalesce("snippet", F.lit(""))) < short)) >= 3
    return rows.groupBy("qid").agg((F.coalesce(F.max("hybrid_score"), F.lit(0.0)) < least).alias("low"), few.alias("few")).select("qid", (F.col("low") | F.col("few")).alias("weak"))


def high_risk(rows: DataFrame) -> DataFrame:
    """(qid, high_risk): the query matches a pattern, or what is told of its first three rows does, in order of rank.

    Of rows(qid, query, rank, citation, topic, subtopic, snippet), 200 characters of a snippet count. The query is one for each qid.
    """
    told = F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("citation", "topic", "subtopic")), F.left(F.coalesce("snippet", F.lit("")), F.lit(200)))
    first = F.array_sort(F.collect_list(F.when(F.col("rank") <= 3, F.struct("rank", told.alias("told")))))
    each = rows.groupBy("qid").agg(F.min("query").alias("query"), F.array_join(F.transform(first, lambda x: x["told"]), " ").alias("text"))
    return each.select("qid", F.coalesce(any_pattern(F.col("query"), rules.HIGH_RISK) | any_pattern(F.col("text"), rules.HIGH_RISK), any_pattern(F.col("text"), rules.HIGH_RISK)).alias("high_risk"))
