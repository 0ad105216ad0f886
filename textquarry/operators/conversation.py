"""Conversation windows and follow-up questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import col, has_any, matches, stripped


def last_turns(turns: DataFrame, n: int = rules.TURNS, each: int = rules.TURN_CHARS, total: int = rules.ALL_CHARS) -> DataFrame:
    """Of each conversation's last n turns, those of user or assistant that aren't blank, cut to each and, together, to total characters.

    Turns are counted before blank ones and other roles are left out. Repeated turn numbers fall to role, then text.
    """
    order = [F.desc("turn"), F.desc("role"), F.desc("text")]
    last = turns.withColumn("_n", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order))).where(F.col("_n") <= n)
    rows = last.select("conv_id", "turn", "_n", F.lower(stripped("role")).alias("role"), F.left(stripped("text"), F.lit(each)).alias("content")).where("role in ('user', 'assistant') and content <> ''")
    before = F.coalesce(F.sum(F.length("content")).over(Window.partitionBy("conv_id").orderBy(F.desc("_n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_before", before).where(F.col("_before") < total).select("conv_id", "turn", "role", F.left("content", (total - F.col("_before")).cast("int")).alias("content"))


def last_user(turns: DataFrame) -> DataFrame:
    """(conv_id, content): the last of the user's turns that last_turns keeps."""
    return last_turns(turns).where("role = 'user'").groupBy("conv_id").agg(F.max_by("content", F.struct("turn", "content")).alias("content"))


def client_turns(turns: DataFrame, n: int = 4, user: int = 400, assistant: int = 300) -> DataFrame:
    """As clients send them: blank turns and other roles go first, then the last n stand, cut by role (T5)."""
    rows = turns.select("conv_id", "turn", F.lower(stripped("role")).alias("role"), stripped("text").alias("content")).where("role in ('user', 'assistant') and content <> ''")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role"), F.desc("content")))
    cut = F.when(F.col("role") == "user", F.left("content", F.lit(user))).otherwise(F.left("content", F.lit(assistant)))
    return rows.withColumn("_n", place).where(F.col("_n") <= n).select("conv_id", "turn", "role", cut.alias("content"))


def sessions(turns: DataFrame) -> DataFrame:
    """(conv_id, title, updated, n_turns, place): each conversation once, the last touched first (W6). The title is its first question's start."""
    asked = F.min_by(F.when(F.lower(stripped("role")) == "user", F.left(stripped("text"), F.lit(60))), F.when(F.lower(stripped("role")) == "user", F.struct("turn", "text")))
    rows = turns.groupBy("conv_id").agg(asked.alias("title"), F.max("turn").alias("updated"), F.count("*").alias("n_turns"))
    return rows


def follow_up(message: Column | str) -> Column:
    """Whether a message seems to need what was said before (Q9)."""
    x = stripped(message)
    words = F.size(F.filter(F.split(x, r"(?U)\s+"), lambda w: w != ""))
    return F.when((x == "") | (F.length(x) > 120), False).when(matches(x, rules.FOLLOW_UP), True).when(matches(x, rules.STANDALONE), False).otherwise((words <= 5) & (F.length(x) < 40))


def topics(message: Column | str) -> Column:
    low = F.lower(col(message))
    return F.filter(F.array(*(F.when(has_any(low, ws), F.lit(k)) for k, ws in rules.TOPIC_HINTS.items())), lambda t: t.isNotNull())


def topic_shift(message: Column | str, prior: Column | str) -> Column:
    prior, now = col(prior), topics(message)
    before = topics(prior)
    apart = (F.size(now) > 0) & (F.size(before) > 0) & ~F.arrays_overlap(now, before)
    return F.coalesce(prior.isNull() | (prior == "") | (F.length(stripped(message)) > 100) | apart, F.lit(True))


def retrieval_query(message: Column | str, prior: Column | str) -> Column:
    """The message, with the start of the prior question where it is a follow-up on the same topic (Q10)."""
    x = stripped(message)
    context = F.left(F.concat(x, F.lit(" (brief context from prior question: "), F.left(col(prior), F.lit(150)), F.lit(")")), F.lit(1200))
    return F.when(follow_up(message) & ~topic_shift(message, prior), context).otherwise(x)
