"""Rule-driven relevance boosts: the tables in rules become one expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import either, has_any, matches
from .fulltext import is_case_law, mentions_case_law


def _if(condition: Column, weight: float) -> Column:
    return F.when(condition, F.lit(weight)).otherwise(F.lit(0.0))


def chunk_text() -> Column:
    """What the rules look at: citation, topic, subtopic, 400 characters of snippet and url in lower case."""
    part = lambda c: F.nullif(F.lower(c), F.lit(""))
    return F.concat_ws(" ", part(F.col("citation")), part(F.col("topic")), part(F.col("subtopic")), part(F.left("snippet", F.lit(400))), part(F.col("official_url")))


def boost() -> Column:
    """Boost of a row (query, citation, topic, subtopic, snippet, official_url), within the limits (H3)."""
    query, cite = F.coalesce("query", F.lit("")), F.coalesce("citation", F.lit(""))
    q, blob = F.lower(query), chunk_text()
    parts = [_if(is_case_law("citation", "topic") & ~mentions_case_law(query), rules.CASE_LAW_PENALTY)]
    tier = F.lit(0.0)
    for prefix, weight in reversed(rules.AUTHORITY):
        tier = F.when(cite.startswith(prefix), weight).otherwise(tier)
    parts.append(tier)
    number = F.regexp_extract(q, rules.FORM_NUMBER, 1)
    parts.append(_if((number != "") & (F.contains(blob, F.concat(F.lit("i-"), number)) | F.contains(F.replace(blob, F.lit("-"), F.lit("")), F.concat(F.lit("i"), number))), rules.FORM_BOOST))
    phrase = F.lit(0.0)
    more = {p: (needles, w) for p, needles, w in rules.PHRASE_MORE}
    for p, needles in reversed(rules.PHRASES):
        weight = F.lit(rules.PHRASE_BOOST) + (_if(has_any(blob, more[p][0]), more[p][1]) if p in more else F.lit(0.0))
        phrase = F.when(q.contains(p) & has_any(blob, needles), weight).otherwise(phrase)
    parts.append(phrase)
    parts += [_if(matches(query, p) & has_any(blob, needles), rules.TOPIC_BOOST) for p, needles in rules.TOPICS]
    for context, entries in rules.CONTEXTS:
        total = F.lit(0.0)
        for weight, signals, unless_asked, unless_there in entries:
            total = total + _if(has_any(blob, signals) & ~has_any(q, unless_asked) & ~has_any(blob, unless_there), weight)
        parts.append(F.when(matches(query, context), total).otherwise(0.0))
    # fixed values: rules that look at the citation alone
    parts.append(_if(q.contains("adjustment of status") & q.contains("eligible") & cite.contains("§ 245.1"), 0.014))
    defining = q.startswith("what is") | q.startswith("what's")
    parts.append(_if(defining & has_any(cite, ["§ 324.", "§ 287.", "§ 292."]) & ~has_any(q, ["324", "287", "292", "enforcement", "bond", "representative"]), -0.010))
    parts.append(_if(defining & q.contains("good moral character") & cite.contains("§ 245.") & ~cite.contains("316."), -0.008))
    total = F.aggregate(F.array(*parts), F.lit(0.0), lambda a, x: a + x)
    return F.round(F.greatest(F.lit(rules.LEAST_BOOST), F.least(F.lit(rules.MOST_BOOST), total)), 6)


def with_boost(rows: DataFrame) -> DataFrame:
    return rows.withColumn("boost", boost())


def any_pattern(text: Column, patterns: list[str]) -> Column:
    return either([matches(text, p) for p in patterns])
