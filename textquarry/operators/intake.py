"""Taking questions in: which query is searched for one, whether it must be clarified first, what kind of answer it asks for, and the prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import intake
from ..functions.text import col, matches, stripped
from .scoring import any_pattern
from .understand import route


def _table(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def resolved_query(message: Column | str, category: Column | str) -> Column:
    """The chosen category's query, else that of the question's route, else of the first pattern that fits, else the question (Q5)."""
    x, queries = stripped(message), _table(intake.CATEGORY_QUERIES)
    said = x
    for name, pattern in reversed(intake.RESOLVED):
        said = F.when(matches(x, pattern), intake.CATEGORY_QUERIES[name]).otherwise(said)
    routed = route(message)
    return F.coalesce(F.try_element_at(queries, F.nullif(col(category), F.lit(""))), F.when(routed["topic"] != "general", routed["retrieval_query"]), said)


def is_specific(message: Column | str) -> Column:
    """Whether a question is narrow enough to be answered at once (Q6)."""
    x = F.lower(stripped(message))
    return F.coalesce((x != "") & any_pattern(x, intake.SPECIFIC), F.lit(False))


def broad_topic(message: Column | str) -> Column:
    """The topic to be clarified, null for a narrow question or one of no such topic (Q6)."""
    x, topic = F.lower(stripped(message)), F.lit(None).cast("string")
    for name, pattern in reversed(intake.BROAD):
        topic = F.when(matches(x, pattern), name).otherwise(topic)
    return F.when(~is_specific(message), topic)


def clarifications(questions: DataFrame, topic: str = "broad_topic") -> DataFrame:
    """questions with `clarification` of their topic: what is said and asked, and the answers offered; null without a topic (Q7)."""
    option = "array<struct<label: string, category: string>>"
    table = questions.sparkSession.createDataFrame(intake.CLARIFICATIONS, f"_topic string, answer string, question string, options {option}")
    rows = table.select("_topic", F.struct("answer", "question", "options").alias("clarification"))
    return questions.join(F.broadcast(rows), F.col(topic) == F.col("_topic"), "left").drop("_topic")


def answer_intent(message: Column | str) -> Column:
    """case_specific_or_risk, process_info or general_info (Q8)."""
    x = stripped(message)
    return F.when(matches(x, intake.OWN_RISK), "case_specific_or_risk").when(matches(x, intake.DEFINING), "general_info").when(matches(x, intake.PROCESS), "process_info").otherwise("general_info")


def prepared_answers(message: Column | str) -> Column:
    """Which prepared answers a question may get (Q8)."""
    x = stripped(message)
    own = matches(x, intake.H4_OWN_CASE)
    return F.struct(
        matches(x, intake.CRIMINAL_INFO).alias("criminal_info"), matches(x, intake.DUI_INFO).alias("dui_info"),
        (~own & matches(x, intake.H4_EAD_FAQ)).alias("h4_ead"), (~own & matches(x, intake.H4_PROCESS_FAQ)).alias("h4_process"),
    )


def source_context(results: DataFrame) -> DataFrame:
    """(qid, context): the ranked chunks of a question as blocks of lines."""
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    topic = F.nullif(F.concat_ws(" — ", some("topic"), some("subtopic")), F.lit(""))
    lines = F.array(
        F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("citation", F.lit(""))),
        F.concat(F.lit("Chunk ID: "), F.col("chunk_id").cast("string"), F.lit(" | Hybrid Score: "), F.format_string("%.6f", "hybrid_score")),
        F.concat(F.lit("Topic: "), topic, F.coalesce(F.concat(F.lit(" | Risk: "), some("risk_level")), F.lit(""))),
        some("official_url"),
        F.concat(F.lit("\n"), some("snippet")),
    )
    block = F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n")
    ordered = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))
    return results.groupBy("qid").agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n\n---\n\n").alias("context"))


def citations(results: DataFrame) -> DataFrame:
    """(qid, place, citation, ...): each citation of a question once, from its first result, in order."""
    columns = ["citation", "official_url", "topic", "subtopic", "risk_level"]
    first = results.groupBy("qid", F.col("citation").alias("_c")).agg(F.min_by(F.struct("rank", *columns), "rank").alias("r"))
    ordered = first.groupBy("qid").agg(F.array_sort(F.collect_list("r")).alias("all"))
    return ordered.select("qid", F.posexplode("all").alias("place", "r")).select("qid", (F.col("place") + 1).alias("place"), *(f"r.{c}" for c in columns))


def prompts(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """(qid, prompt) of questions(qid, message, category, conversation) and contexts(qid, context): the text a model would get.

    conversation is an array of (role, content), the oldest first; what a question lacks is left out.
    """
    turns = F.array_join(F.transform("conversation", lambda t: F.concat(F.initcap(t["role"]), F.lit(": "), t["content"])), "\n")
    before = F.when(F.size("conversation") > 0, F.concat(F.lit("Earlier turns, for reference only:\n"), turns, F.lit("\n\n"))).otherwise("")
    chosen = F.when(F.coalesce("category", F.lit("")) != "", F.concat(F.lit("\nCategory chosen: "), F.col("category"), F.lit("\n"))).otherwise("")
    text = F.concat(before, F.lit("Question: "), F.coalesce("message", F.lit("")), chosen, F.lit("\nSources:\n"), F.coalesce("context", F.lit("")), F.lit("\n\nAnswer from these sources alone, and cite them."))
    return questions.join(contexts, "qid", "left").select("qid", text.alias("prompt"))
