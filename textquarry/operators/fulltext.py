"""Full-text search over a table of postings, made once when chunks are written.

postings(chunk_id, lexeme, pos, weight) are words as rows; search.Index stores them, packed and stemmed, and what
is searched here goes through the same conjunctive search and the same covers. Ranking is semantic parity with a database's cover
density, not its floats.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules, stems
from ..functions.stems import stem
from ..functions.text import either, matches
from . import search
from .vector import top

#: Weights of the classes of fields.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
WORD = r"[\p{L}\p{N}]+"


def lexemes(text: Column | str, stem: bool = False, stop: bool = True) -> Column:
    """The words of a text in lower case; without stop words, and stemmed, if asked."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)
    if stop:
        words = F.filter(words, lambda w: ~w.isin(rules.STOP_WORDS))
    return stemmed(words) if stem else words


def postings(chunks: DataFrame, fields: dict[str, str | Column], stem: bool = False) -> DataFrame:
    """(chunk_id, lexeme, pos, weight): every word of every field; positions run on from field to field.

    fields maps a class of WEIGHTS to a column of text. Stop words leave gaps in the positions.
    """
    rest, base = [], F.lit(0)
    for weight, text in fields.items():
        words = lexemes(text, stop=False)
        rest.append(_placed(words, base, weight))
        base = base + F.size(words) + 1
    stop = rules.STOP_WORDS
    rows = chunks.select("chunk_id", F.explode(F.filter(F.concat(*rest), lambda p: ~p["lexeme"].isin(stop))).alias("p")).select("chunk_id", "p.*")
    return rows.select("chunk_id", stems.stemmed("lexeme").alias("lexeme"), "pos", "weight") if stem else rows


def _placed(words: Column, base: Column, weight: str) -> Column:
    return F.transform(words, lambda w, i: F.struct(w.alias("lexeme"), (base + i + 1).cast("int").alias("pos"), F.lit(weight).alias("weight")))


def packed(posted: DataFrame) -> search.Lists:
    """posted(chunk_id, lexeme, pos, weight) as a search reads it, not stored."""
    code = F.expr("instr('ABCD', weight) - 1")
    return search.Lists(posted.groupBy(F.col("lexeme").alias("stem"), "chunk_id").agg(F.sort_array(F.collect_list((F.col("pos") * 4 + code).cast("int"))).alias("hits")))


def keyword_matches(posted: DataFrame | search.Lists, queries: DataFrame, stem: bool = False) -> DataFrame:
    """(qid, chunk_id, kw_score): chunks that have every lexeme of the query, scored by covers; see search."""
    return search.keyword_matches(posted, queries) if isinstance(posted, search.Lists) else search.cover_scores(search.conjunctive(packed(posted), search.asked_stems(queries, stem)))


def keyword_topk(posted: DataFrame | search.Lists, queries: DataFrame, k: int = 15, stem: bool = False) -> DataFrame:
    return top(keyword_matches(posted, queries, stem), [F.desc("kw_score"), F.col("chunk_id")], k)


def phrase_topk(posted: DataFrame | search.Lists, phrases: DataFrame, k: int = 12, stem: bool = False) -> DataFrame:
    """(qid, chunk_id, kw_score, rank): chunks where the phrase's words stand as in the phrase; the score counts the places."""
    found = search.phrase_matches(posted, phrases) if isinstance(posted, search.Lists) else search.phrase_matches(packed(posted), phrases, stem)
    return top(found, [F.desc("kw_score"), F.col("chunk_id")], k)


cover_density = keyword_matches


def is_case_law(citation: Column | str, topic: Column | str) -> Column:
    citation, topic = (F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")) for x in (citation, topic))
    return matches(citation, rules.CASE_LAW_CITATION) | (F.lower(F.trim(topic)) == rules.CASE_LAW_TOPIC)


def mentions_case_law(query: Column | str, whole_words: bool = False) -> Column:
    low = F.lower(F.col(query) if isinstance(query, str) else query)
    if whole_words:
        return either([low.rlike(rf"(?<![\p{{L}}\p{{N}}])\Q{w}\E(?![\p{{L}}\p{{N}}])") for w in rules.CASE_LAW_QUERY])
    return either([low.contains(w) for w in rules.CASE_LAW_QUERY])


def without_case_law(rows: DataFrame) -> DataFrame:
    """rows(query, citation, topic, ...) without case law, except for queries that ask for it."""
    return rows.where(~is_case_law("citation", "topic") | mentions_case_law("query"))


def merged(primary: DataFrame, extra: DataFrame, k: int = 15) -> DataFrame:
    """(qid, chunk_id, kw_score, rank): each chunk's best score of both lists; the primary list wins ties (F8)."""
    both = primary.select("qid", "chunk_id", "kw_score", F.lit(0).alias("list")).unionByName(extra.select("qid", "chunk_id", "kw_score", F.lit(1).alias("list")))
    best = both.groupBy("qid", "chunk_id").agg(F.max_by(F.struct("kw_score", "list"), F.struct("kw_score", -F.col("list"))).alias("b")).select("qid", "chunk_id", "b.*")
    return top(best, [F.desc("kw_score"), F.col("list"), F.col("chunk_id")], k).drop("list")


def supplemental_phrases(query: Column | str, most: int = 3) -> Column:
    """The first phrases of the table that the query contains."""
    low = F.lower(F.col(query) if isinstance(query, str) else query)
    return F.slice(F.filter(F.array(*(F.when(low.contains(p), F.lit(p)) for p, _ in rules.PHRASES)), lambda x: x.isNotNull()), 1, most)


def stemmed(words: Column) -> Column:
    """English stems (F6), for words that aren't stored."""

    @F.pandas_udf("array<string>")
    def run(rows: pd.Series) -> pd.Series:
        known: dict[str, str] = {}
        return pd.Series([None if r is None else [known.get(w) or known.setdefault(w, stem(w)) for w in r] for r in rows])

    return run(words)
