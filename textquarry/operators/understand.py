"""Understanding questions by ordered rules: each is an expression on a column of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import col, either, matches, query_hash, stripped
from .scoring import any_pattern


def message_class(message: Column | str) -> Column:
    """greeting, criminal_warning, refusal or pass (Q1)."""
    x = stripped(message)
    return (
        F.when(x.isNull() | (x == ""), "pass")
        .when((F.length(x) <= rules.GREETING_CHARS) & any_pattern(x, rules.GREETINGS), "greeting")
        .when(matches(x, rules.CONSEQUENCE), "pass")
        .when(matches(x, rules.CRIMINAL_MATTER) & matches(x, rules.CRIMINAL_ACTION), "criminal_warning")
        .when(any_pattern(x, rules.REFUSALS), "refusal")
        .otherwise("pass")
    )


def route(message: Column | str) -> Column:
    """topic, intent, retrieval_query and families of the first route that fits; else general and the message itself (Q2)."""
    x = stripped(message)
    out = F.struct(F.lit("general").alias("topic"), F.lit("general_info").alias("intent"), x.alias("retrieval_query"), F.array().cast("array<string>").alias("families"))
    for topic, intent, patterns, query, families in reversed(rules.ROUTES):
        fits = matches(x, patterns[0])
        for p in patterns[1:]:
            fits = fits & matches(x, p)
        own = F.struct(F.lit(topic).alias("topic"), F.lit(intent).alias("intent"), F.lit(query).alias("retrieval_query"), F.array(*map(F.lit, families)).alias("families"))
        out = F.when(fits, own).otherwise(out)
    return out


def guidance(topic: Column | str) -> Column:
    """What an answer on a route's topic is told to say and to leave out; null for general (Q2). No route asks for missing facts."""
    out = F.lit(None).cast("string")
    for name, said in rules.GUIDANCE.items():
        out = F.when(col(topic) == name, said).otherwise(out)
    return out


def mentioned(question: Column | str, patterns: dict[str, list[str]]) -> Column:
    low = F.lower(col(question))
    return F.filter(F.array(*(F.when(either([low.rlike(p) for p in ps]), F.lit(k)) for k, ps in patterns.items())), lambda x: x.isNotNull())


def rewritten(questions: DataFrame, column: str = "query", most: int = 4) -> DataFrame:
    """questions with visas, topics, multi_topic and sub_queries (Q3)."""
    found = mentioned(column, rules.VISA_PATTERNS)
    visas = F.when(F.array_contains(found, "H-4 EAD"), F.filter(found, lambda v: ~v.isin("H-4", "EAD"))).otherwise(found)
    rows = questions.withColumn("visas", visas).withColumn("topics", mentioned(column, rules.TOPIC_PATTERNS))
    rows = rows.withColumn("multi_topic", (F.size(F.filter("visas", lambda v: ~v.isin("EAD", "pending"))) >= 2) | (F.size("topics") >= 2))
    query_of = lambda table: F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    asked = F.concat("visas", "topics")
    pairs = []
    for names, word, query in rules.PAIR_QUERIES:
        fits = F.lit(True)
        for name in names:
            fits = fits & F.arrays_overlap(asked, F.array(*map(F.lit, name.split("|"))))
        pairs.append(F.when(fits & (F.lower(column).contains(word) if word else F.lit(True)), F.lit(query)))
    all_ = F.concat(F.array(column), F.transform("visas", lambda v: query_of(rules.VISA_QUERIES)[v]), F.transform("topics", lambda t: query_of(rules.TOPIC_QUERIES)[t]), F.array(*pairs))
    subs = F.slice(F.array_distinct(F.filter(all_, lambda x: x.isNotNull())), 1, most)
    return rows.withColumn("sub_queries", F.when(F.col("multi_topic"), subs).otherwise(F.array(column)))


def filter_tags(visas: Column | str) -> Column:
    """Tags that chunks carry for the visas, each once, sorted (Q4)."""
    table = F.create_map(*(F.lit(x) for pair in rules.FILTER_TAGS.items() for x in pair))
    return F.array_sort(F.array_distinct(F.filter(F.transform(visas, lambda v: table[v]), lambda t: t.isNotNull())))


def validated(requests: DataFrame, most_chars: int = 1000, most_k: int = 10) -> DataFrame:
    """requests(query, top_k) with the stripped query, its hash, and what is wrong with it, else null (Q12)."""
    x = stripped("query")
    wrong = F.when(F.coalesce(x, F.lit("")) == "", "empty query").when(F.length(x) > most_chars, "query too long").when(F.coalesce("top_k", F.lit(5)).between(1, most_k), None).otherwise("top_k out of range")
    return requests.withColumn("query", x).withColumn("query_hash", query_hash(x)).withColumn("wrong", wrong)
