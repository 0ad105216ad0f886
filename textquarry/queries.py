"""Registered queries over the driver's tables, each with its SQL where SQL can express it.

documents play chunks (source: version, lang: topic), embeddings their vectors (vec_id = doc_id), benchmark the
questions, conversations the turns; the star schema the relational operators.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunk_sql, search_sql
from .functions import chunking, rules, text
from .operators import catalog, conversation, fulltext, fusion, lifecycle, quality, rerank, scoring, search, understand, vector
from .plans import corpus, hybrid
from .sources import html
from .sources.kept import shared_folder
from .streaming import arrivals

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _str(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {_str(pattern)}, 'i')"


def _any(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {_str(w)})" for w in words) + ")" if words else "false"


STRIP_SQL = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"
WORDS_SQL = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"
STOP_SQL = "[" + ", ".join(map(_str, rules.STOP_WORDS)) + "]"

# ---- inputs -------------------------------------------------------------------------------------------------

#: Citations and questions that make rules fire, dealt to documents by number.
CITATIONS = ["8 CFR § 239.1", "USCIS Form I-765", "Vol 12 Part D Ch. 2", "8 U.S.C. § 1158", "Matter of X, 29 I&N Dec. 628 (BIA 2026)", "8 CFR § 274a.12(c)(26)", "INA 212(a)(2)", "8 CFR § 214.2(f)(10)", "8 CFR § 324.1"]
QUESTIONS = [
    "what is a notice to appear", "Can my H-4 spouse get an EAD with Form I-765?", "hello", "What are the naturalization requirements, N-400 and continuous residence?",
    "Do crimes involving moral turpitude affect a green card?", "Can I travel while my I-485 adjustment of status is pending?", "pending asylum and work authorization", "F-1 student STEM OPT work after graduation",
    "I received a Notice to Appear, what should I do about immigration court?", "How do I hide my arrest from USCIS?", "I was arrested for a DUI, what should I do?", "thanks!", "what about the fee?",
    "can l-2 spouse work", "H-1B extension and H-4 EAD renewal while pending", "optional practical training categories",
]
VERSIONS = ["ecfr-title8-full-2026", "ina-v1", "uscis-pm-2026", "bia-2025", "ecfr-title8-sample-x", "other-7"]


def _pick(values: list[str], number: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.pmod(number, F.lit(len(values))).cast("int"))


def _pick_sql(values: list[str], number: str) -> str:
    return f"([{', '.join(map(_str, values))}])[1 + {number} % {len(values)}]"


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    docs, vectors = _table(spark, sf, "documents"), _table(spark, sf, "embeddings")
    rows = docs.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("chunk_text"), _pick(CITATIONS, F.col("doc_id")).alias("citation"), F.col("lang").alias("topic"), F.col("source").alias("subtopic"), F.lit(None).cast("string").alias("official_url"), _pick(VERSIONS, F.col("doc_id")).alias("version_name"))
    return rows.join(vectors.select(F.col("vec_id").alias("chunk_id"), "embedding"), "chunk_id", "left")


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    """benchmark items as questions, with the vector of the same number."""
    items = _table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return items.join(_table(spark, sf, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector")), "qid", "left")


#: The fields of the index, by class of weight: text, question, citation, topic and subtopic.
FIELDS = {"A": ["text"], "B": ["question"], "C": ["citation"], "D": ["lang", "source"]}


def _indexed(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    return _table(spark, sf, "documents").select(i.alias("chunk_id"), "text", _pick(QUESTIONS, F.floor(i / 3).cast("long")).alias("question"), _pick(CITATIONS, i).alias("citation"), "lang", "source")


def _lists(spark: SparkSession, sf: str) -> search.Lists:
    """The stored index of the documents: built by the first search, read by all."""
    return search.opened(spark, search.as_of(spark, f"{sf}/documents.parquet"), _indexed(spark, sf), FIELDS).lists()


def _asked_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Each document with a question and a citation, as a retrieved row."""
    return _chunks(spark, sf).select(
        F.pmod("chunk_id", F.lit(10)).alias("qid"), "chunk_id", _pick(QUESTIONS, F.floor(F.col("chunk_id") / 3).cast("long")).alias("query"), "citation", "topic", "subtopic", "official_url", "version_name",
        F.left("chunk_text", F.lit(500)).alias("snippet"), F.round(F.lit(0.01) + F.pmod("chunk_id", F.lit(97)) / 5000.0, 6).alias("hybrid_score"),
    )


ASKED_SQL = f"""asked AS (SELECT doc_id % 10 AS qid, doc_id AS chunk_id, {_pick_sql(QUESTIONS, '(doc_id // 3)')} AS query, {_pick_sql(CITATIONS, 'doc_id')} AS citation,
  lang AS topic, source AS subtopic, {_pick_sql(VERSIONS, 'doc_id')} AS version_name, left(text, 500) AS snippet, round(0.01::DOUBLE + (doc_id % 97) / 5000.0::DOUBLE, 6) AS hybrid_score FROM documents)"""
FAMILY_SQL = "CASE " + " ".join(f"WHEN {' OR '.join(f'starts_with(lower(version_name), {_str(p)})' for p in ps)} THEN {_str(f)}" for ps, f in rules.FAMILIES) + " ELSE 'other' END"

# ---- vectors ------------------------------------------------------------------------------------------------


def _knn_sql(distance: str, who: str) -> str:
    return f"""SELECT qid, chunk_id, distance, rank FROM (SELECT q.vec_id AS qid, e.vec_id AS chunk_id, round({distance}(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS distance,
      row_number() OVER (PARTITION BY q.vec_id ORDER BY round({distance}(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6), e.vec_id) AS rank
      FROM embeddings e, embeddings q WHERE {who}) WHERE rank <= 15"""


def _knn(spark: SparkSession, sf: str, who: str, metric: str = "l2") -> DataFrame:
    e = _table(spark, sf, "embeddings")
    return vector.vector_topk(e.select(F.col("vec_id").alias("chunk_id"), "embedding"), e.where(who).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector")), 15, metric)


@query(_knn_sql("list_distance", "q.vec_id % 50 = 0"))
def knn_l2(spark, sf):
    return _knn(spark, sf, "vec_id % 50 = 0")


@query(_knn_sql("list_cosine_distance", "q.vec_id % 50 = 0"))
def knn_cosine(spark, sf):
    return _knn(spark, sf, "vec_id % 50 = 0", "cosine")


@query(_knn_sql("list_distance", "q.vec_id % 50 = 0"))
def knn_batch(spark, sf):
    return _knn(spark, sf, "vec_id % 50 = 0")


@query("""SELECT count(*) AS n_chunks, count(*) FILTER (WHERE e.embedding IS NULL) AS n_missing, count(*) FILTER (WHERE len(e.embedding) <> 64) AS n_other_width,
  count(*) FILTER (WHERE len(list_filter(e.embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0) AS n_not_finite FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id""")
def vector_dims_audit(spark, sf):
    return vector.audit(_chunks(spark, sf), 64)


@query("SELECT count(*) AS n_missing FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def embedding_backlog(spark, sf):
    return vector.missing(_chunks(spark, sf).select("chunk_id"), _table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"))).agg(F.count("*").alias("n_missing"))


@query()
def ext_lsh_recall(spark, sf):
    e = _table(spark, sf, "embeddings")
    chunks, asked = e.select(F.col("vec_id").alias("chunk_id"), "embedding"), e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    return vector.lsh_recall(chunks, asked, vector.vector_topk(chunks, asked))


# ---- full text ----------------------------------------------------------------------------------------------

FIELDS_SQL = [("text", 10), (_pick_sql(QUESTIONS, "(doc_id // 3)"), 4), (_pick_sql(CITATIONS, "doc_id"), 2), ("lang", 1), ("source", 1)]
INDEX_SQL = f"{search_sql.tokens_sql(FIELDS_SQL, WORDS_SQL, STOP_SQL)}, {search_sql.asked_sql(WORDS_SQL, STOP_SQL)}, {search_sql.stems_sql('(SELECT lexeme FROM tok UNION SELECT lexeme FROM qw)')}"
KEYWORD_SQL = f"{INDEX_SQL}, {search_sql.COVERS_SQL}"
PHRASE_SQL = search_sql.PHRASES_SQL


@query(f"WITH {KEYWORD_SQL} SELECT qid, chunk_id, kw_score, rank FROM kw")
def keyword_topk(spark, sf):
    return search.keyword_topk(_lists(spark, sf), _questions(spark, sf))


@query(f"WITH {INDEX_SQL}, {PHRASE_SQL} SELECT * FROM (SELECT qid, chunk_id, kw_score, row_number() OVER (PARTITION BY qid ORDER BY kw_score DESC, chunk_id) AS rank FROM phrases) WHERE rank <= 12")
def phrase_topk(spark, sf):
    return search.phrase_topk(_lists(spark, sf), _questions(spark, sf))


@query(f"WITH {KEYWORD_SQL} SELECT qid, chunk_id, kw_score FROM scored")
def cover_density(spark, sf):
    """Every match, not the best of each question alone."""
    return search.keyword_matches(_lists(spark, sf), _questions(spark, sf))


SHORT_SQL = INDEX_SQL.replace(" FROM benchmark", " FROM asked3").replace("fs AS (", f"asked3 AS (SELECT doc_id AS item_id, array_to_string({WORDS_SQL.format('text')}[1:3], ' ') AS text FROM documents WHERE doc_id % 50 = 0), fs AS (", 1)


@query(f"WITH {SHORT_SQL}, {search_sql.COVERS_SQL} SELECT qid, chunk_id, kw_score, rank FROM kw")
def keyword_openings(spark, sf):
    """The first three words of every fiftieth document asked of all: frequent stems, many matches."""
    docs = _table(spark, sf, "documents").where("doc_id % 50 = 0")
    asked = docs.select(F.col("doc_id").alias("qid"), F.array_join(F.slice(search.words("text"), 1, 3), " ").alias("query"))
    return search.keyword_topk(_lists(spark, sf), asked)


STEMMED_SQL = f"WITH {search_sql.tokens_sql([('text', 10)], WORDS_SQL, STOP_SQL, 'benchmark', 'item_id')}, {search_sql.stems_sql('tok')}"


@query(f"{STEMMED_SQL} SELECT chunk_id, stem AS lexeme, pos, 'A' AS weight FROM tok JOIN st USING (lexeme)")
def stemmed_lexemes(spark, sf):
    return fulltext.postings(_table(spark, sf, "benchmark").select(F.col("item_id").alias("chunk_id"), "text"), {"A": "text"}, stem=True)


@query(f"WITH {INDEX_SQL} SELECT stem, count(DISTINCT chunk_id) AS df FROM tok JOIN st USING (lexeme) GROUP BY stem")
def index_terms(spark, sf):
    return _lists(spark, sf).terms


UPDATED_SQL = INDEX_SQL.replace(" FROM documents)", " FROM changed)").replace("fs AS (", "changed AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN left(text, 200) ELSE text END AS text, lang, source FROM documents WHERE doc_id % 11 <> 0), fs AS (", 1)


@query(f"WITH {UPDATED_SQL} SELECT stem, count(DISTINCT chunk_id) AS n_chunks, count(*) AS n_hits, sum(pos)::BIGINT AS places FROM tok JOIN st USING (lexeme) GROUP BY stem")
def index_update(spark, sf):
    """An index of all documents after some were cut and others removed, and after that was compacted."""
    rows = _indexed(spark, sf)
    index = search.Index(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", fields=FIELDS).build(rows)
    index.update(rows.where("chunk_id % 7 = 0").withColumn("text", F.left("text", F.lit(200))))
    index.update(rows.limit(0), gone=rows.where("chunk_id % 11 = 0").select("chunk_id"))
    hits = index.compact().lists().postings.select("stem", "chunk_id", F.explode("hits").alias("hit"))
    return hits.groupBy("stem").agg(F.count_distinct("chunk_id").alias("n_chunks"), F.count("*").alias("n_hits"), F.sum(F.floor(F.col("hit") / 4)).cast("bigint").alias("places"))


@query(f"""WITH {KEYWORD_SQL}, {PHRASE_SQL},
both_ AS (SELECT qid, chunk_id, kw_score, 0 AS l FROM kw UNION ALL SELECT qid, chunk_id, kw_score, 1 FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY kw_score DESC, chunk_id) AS r FROM phrases) WHERE r <= 12),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, chunk_id ORDER BY kw_score DESC, l) AS i FROM both_) WHERE i = 1)
SELECT qid, chunk_id, kw_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY kw_score DESC, l, chunk_id) AS rank FROM best) WHERE rank <= 15""")
def keyword_merge(spark, sf):
    return fulltext.merged(keyword_topk(spark, sf), phrase_topk(spark, sf))


@query(f"WITH {ASKED_SQL} SELECT chunk_id, CASE WHEN (NOT (regexp_matches(citation, {_str(rules.CASE_LAW_CITATION)}, 'i') OR lower(trim(topic)) = 'bia precedent')) OR {_any('lower(query)', rules.CASE_LAW_QUERY)} THEN 1 ELSE 0 END AS kept FROM asked")
def case_law_filter(spark, sf):
    rows = _asked_rows(spark, sf)
    kept = fulltext.without_case_law(rows).select("chunk_id", F.lit(1).alias("k"))
    return rows.join(kept, "chunk_id", "left").select("chunk_id", F.coalesce("k", F.lit(0)).alias("kept"))


@query(f"WITH {ASKED_SQL} SELECT chunk_id, array_to_string(list_filter([{', '.join(f'CASE WHEN contains(lower(query), {_str(p)}) THEN {_str(p)} END' for p, _ in rules.PHRASES)}], lambda x: x IS NOT NULL)[1:3], '|') AS phrases FROM asked")
def supplemental_phrases(spark, sf):
    return _asked_rows(spark, sf).select("chunk_id", F.array_join(fulltext.supplemental_phrases("query"), "|").alias("phrases"))


# ---- fusion -------------------------------------------------------------------------------------------------

NEAR_SQL = """near AS (SELECT * FROM (SELECT b.item_id AS qid, e.vec_id AS chunk_id, round(list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS distance,
  row_number() OVER (PARTITION BY b.item_id ORDER BY round(list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6), e.vec_id) AS rank
  FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id, embeddings e) WHERE rank <= 15)"""


def _near(spark: SparkSession, sf: str) -> DataFrame:
    e = _table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return vector.vector_topk(e, _questions(spark, sf).where("vector is not null").select("qid", "vector"))


def _rrf_sql(wv: float, wk: float) -> str:
    return f"""WITH {KEYWORD_SQL}, {NEAR_SQL} SELECT coalesce(n.qid, k.qid) AS qid, coalesce(n.chunk_id, k.chunk_id) AS chunk_id, n.rank AS vector_rank, k.rank AS keyword_rank,
      round(coalesce({wv}::DOUBLE / (60 + n.rank), 0) + coalesce({wk}::DOUBLE / (60 + k.rank), 0), 6) AS hybrid_score FROM near n FULL JOIN kw k ON n.qid = k.qid AND n.chunk_id = k.chunk_id"""


@query(_rrf_sql(1.0, 0.72))
def rrf_fuse(spark, sf):
    return fusion.rrf_fuse(_near(spark, sf), keyword_topk(spark, sf))


@query(_rrf_sql(1.0, 1.0))
def rrf_classic(spark, sf):
    return fusion.rrf_fuse(_near(spark, sf), keyword_topk(spark, sf), "classic")


@query(f"""WITH {KEYWORD_SQL}, {NEAR_SQL}, u AS (SELECT qid, chunk_id FROM near UNION SELECT qid, chunk_id FROM kw),
s AS (SELECT u.qid, u.chunk_id, round(coalesce(1 - n.distance, 0) * 0.6::DOUBLE + coalesce(k.kw_score, 0) * 0.4::DOUBLE, 6) AS score FROM u LEFT JOIN near n ON n.qid = u.qid AND n.chunk_id = u.chunk_id LEFT JOIN kw k ON k.qid = u.qid AND k.chunk_id = u.chunk_id)
SELECT * FROM (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 10""")
def weighted_06_04(spark, sf):
    return fusion.weighted(_near(spark, sf), keyword_topk(spark, sf))


@query(f"WITH {ASKED_SQL} SELECT qid, chunk_id, citation, hybrid_score FROM (SELECT *, row_number() OVER (PARTITION BY qid, coalesce(citation, '') ORDER BY hybrid_score DESC, chunk_id) AS n FROM asked) WHERE n = 1")
def dedupe_citation(spark, sf):
    return fusion.dedupe_best(_asked_rows(spark, sf)).select("qid", "chunk_id", "citation", "hybrid_score")


@query(f"""WITH {ASKED_SQL}, subs AS (SELECT qid, chunk_id % 7 AS chunk_id, (chunk_id // 10) % 4 AS sub_no, hybrid_score, row_number() OVER (PARTITION BY qid, (chunk_id // 10) % 4 ORDER BY hybrid_score DESC, chunk_id) AS rank FROM asked),
first_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, chunk_id ORDER BY sub_no, rank) AS n FROM subs WHERE rank <= 3) WHERE n = 1)
SELECT * FROM (SELECT qid, chunk_id, sub_no, hybrid_score, row_number() OVER (PARTITION BY qid ORDER BY hybrid_score DESC, sub_no, chunk_id) AS rank FROM first_) WHERE rank <= 5""")
def multi_query_union(spark, sf):
    from pyspark.sql import Window

    rows = _asked_rows(spark, sf).select("qid", F.col("chunk_id").alias("c"), F.pmod(F.floor(F.col("chunk_id") / 10), F.lit(4)).alias("sub_no"), "hybrid_score")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid", "sub_no").orderBy(F.desc("hybrid_score"), "c"))).withColumn("chunk_id", F.col("c") % 7)
    return fusion.multi_query(rows.drop("c")).select("qid", "chunk_id", "sub_no", "hybrid_score", "rank")


@query(f"""WITH {ASKED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY hybrid_score DESC, chunk_id) AS rank FROM asked)
SELECT qid, string_agg('[' || rank || '] ' || coalesce(citation, '') || ' (' || printf('%.6f', hybrid_score) || ') ' || coalesce(snippet, ''), chr(10) ORDER BY rank) AS context FROM r WHERE rank <= 5 GROUP BY qid""")
def context_lines(spark, sf):
    return fusion.context_lines(rerank.ranked(_asked_rows(spark, sf)).where("rank <= 5"))


# ---- scoring and reranking ----------------------------------------------------------------------------------


def _when(condition: str, weight: float) -> str:
    return f"CASE WHEN {condition} THEN {weight}::DOUBLE ELSE 0 END"


def _boost_sql() -> str:
    q, blob, cite = "lower(query)", "blob", "citation"
    law = f"(regexp_matches(citation, {_str(rules.CASE_LAW_CITATION)}, 'i') OR lower(trim(topic)) = 'bia precedent')"
    number = f"regexp_extract({q}, {_str(rules.FORM_NUMBER)}, 1)"
    more = {p: (ns, w) for p, ns, w in rules.PHRASE_MORE}
    phrase = "CASE " + " ".join(f"WHEN contains({q}, {_str(p)}) AND {_any(blob, ns)} THEN {rules.PHRASE_BOOST}::DOUBLE + {_when(_any(blob, more[p][0]), more[p][1]) if p in more else '0'}" for p, ns in rules.PHRASES) + " ELSE 0 END"
    parts = [
        _when(f"{law} AND NOT {_any(q, rules.CASE_LAW_QUERY)}", rules.CASE_LAW_PENALTY),
        "CASE " + " ".join(f"WHEN starts_with(citation, {_str(p)}) THEN {w}::DOUBLE" for p, w in rules.AUTHORITY) + " ELSE 0 END",
        _when(f"{number} <> '' AND (contains(blob, 'i-' || {number}) OR contains(replace(blob, '-', ''), 'i' || {number}))", rules.FORM_BOOST),
        phrase,
        *(_when(f"{_matches('query', p)} AND {_any(blob, ns)}", rules.TOPIC_BOOST) for p, ns in rules.TOPICS),
    ]
    for context, entries in rules.CONTEXTS:
        total = " + ".join(_when(f"{_any(blob, s)} AND NOT {_any(q, a)} AND NOT {_any(blob, t)}", w) for w, s, a, t in entries)
        parts.append(f"CASE WHEN {_matches('query', context)} THEN {total} ELSE 0 END")
    parts.append(_when(f"contains({q}, 'adjustment of status') AND contains({q}, 'eligible') AND contains({cite}, '§ 245.1')", 0.014))
    defining = f"(starts_with({q}, 'what is') OR starts_with({q}, 'what''s'))"
    parts.append(_when(f"{defining} AND {_any(cite, ['§ 324.', '§ 287.', '§ 292.'])} AND NOT {_any(q, ['324', '287', '292', 'enforcement', 'bond', 'representative'])}", -0.010))
    parts.append(_when(f"{defining} AND contains({q}, 'good moral character') AND contains({cite}, '§ 245.') AND NOT contains({cite}, '316.')", -0.008))
    return f"""WITH {ASKED_SQL}, b AS (SELECT *, concat_ws(' ', nullif(lower(citation), ''), nullif(lower(topic), ''), nullif(lower(subtopic), ''), nullif(lower(left(snippet, 400)), '')) AS blob FROM asked)
      SELECT chunk_id, round(greatest({rules.LEAST_BOOST}::DOUBLE, least({rules.MOST_BOOST}::DOUBLE, {' + '.join(parts)})), 6) AS boost FROM b"""


@query(_boost_sql())
def boost_clamp(spark, sf):
    return scoring.with_boost(_asked_rows(spark, sf)).select("chunk_id", "boost")


def _visas_sql(column: str = "query") -> str:
    hit = lambda ps: "(" + " OR ".join(f"regexp_matches(lower({column}), {_str(p)})" for p in ps) + ")"
    listed = ", ".join(f"CASE WHEN {hit(ps)} THEN {_str(k)} END" for k, ps in rules.VISA_PATTERNS.items())
    topics = ", ".join(f"CASE WHEN {hit(ps)} THEN {_str(k)} END" for k, ps in rules.TOPIC_PATTERNS.items())
    return f"list_filter([{listed}], lambda x: x IS NOT NULL) AS found, list_filter([{topics}], lambda x: x IS NOT NULL) AS topics"


VISAS_SQL = f"{ASKED_SQL}, m AS (SELECT *, {_visas_sql()} FROM asked), v AS (SELECT *, CASE WHEN list_contains(found, 'H-4 EAD') THEN list_filter(found, lambda x: x NOT IN ('H-4', 'EAD')) ELSE found END AS visas FROM m)"


def _rerank_sql() -> str:
    low, topical, formal = (f"lower(concat_ws(' ', {', '.join(f'coalesce({c}, {_str(chr(39) * 0)})' for c in cs)}))" for cs in (("citation", "topic", "snippet"), ("topic", "snippet"), ("citation", "snippet")))
    tight = f"replace(replace({low}, '-', ''), ' ', '')"
    visa = " + ".join(f"CASE WHEN list_contains(visas, {_str(v)}) AND coalesce(topic, '') <> '' AND (contains({tight}, {_str(v.lower().replace('-', '').replace(' ', ''))}) OR {_any(low, [s.lower() for s in rules.VISA_SECTIONS.get(v, [])])}) THEN 1 ELSE 0 END" for v in rules.VISA_PATTERNS)
    topic = " + ".join(f"CASE WHEN list_contains(topics, {_str(t)}) AND {_any(topical, ws)} THEN 1 ELSE 0 END" for t, ws in rules.TOPIC_KEYWORDS.items())
    form = " + ".join(f"CASE WHEN {_matches('lower(query)', rf'\b{f.lower()}\b')} AND contains({formal}, {_str(f.lower())}) THEN 1 ELSE 0 END" for f in rules.FORMS)
    section = " OR ".join(f"(list_contains(visas, {_str(v)}) AND {_any('lower(citation)', [s.lower() for s in ss])})" for v, ss in rules.VISA_SECTIONS.items())
    return f"""WITH {VISAS_SQL}, n AS (SELECT *, {visa} AS nv, {topic} AS nt, {form} AS nf, CASE WHEN {section} THEN {rules.SECTION_WEIGHT}::DOUBLE ELSE 0 END AS sec FROM v),
      s AS (SELECT qid, chunk_id, round(CASE WHEN nv + nt + nf = 0 THEN hybrid_score * {rules.NO_MATCH}::DOUBLE ELSE hybrid_score + nv * {rules.VISA_WEIGHT}::DOUBLE + nt * {rules.TOPIC_WEIGHT}::DOUBLE + nf * {rules.FORM_WEIGHT}::DOUBLE + sec END, 6) AS hybrid_score FROM n)
      SELECT qid, chunk_id, hybrid_score, row_number() OVER (PARTITION BY qid ORDER BY hybrid_score DESC, chunk_id) AS rank FROM s"""


@query(_rerank_sql())
def metadata_rerank(spark, sf):
    return rerank.metadata_rerank(understand.rewritten(_asked_rows(spark, sf))).select("qid", "chunk_id", "hybrid_score", "rank")


def _route_sql(what: int) -> str:
    return "CASE " + " ".join(f"WHEN {' AND '.join(_matches('query', p) for p in r[2])} THEN {_str(r[what])}" for r in rules.ROUTES) + (" ELSE 'general' END" if what == 0 else " ELSE 'general_info' END" if what == 1 else " ELSE query END")


def _class_sql() -> str:
    joined = "concat_ws(' ', coalesce(citation, ''), coalesce(topic, ''), coalesce(subtopic, ''), coalesce(snippet, ''))"
    branches = []
    for topic, patterns in rules.TOPIC_CLASSES.items():
        own = []
        for i, (name, p) in enumerate(patterns):
            seen = f"concat_ws(' ', {joined}, {FAMILY_SQL})" if topic == "f1_cpt" and name == "hard_reject" else joined
            own.append(f"WHEN {_matches(seen, p)} THEN {_str(name)}")
            if topic == "stem_opt" and i == 0:
                own.append(f"WHEN {_matches(joined, rules.STEM_SECTION)} AND NOT {_matches(joined, rules.STEM_TERMS)} THEN 'hard_reject'")
        if topic == "i485_advance_parole":
            own.append(f"WHEN {_matches(joined, rules.PAROLE_SECTION)} AND {_matches(joined, rules.PAROLE_TERMS)} THEN 'keep'")
        branches.append(f"WHEN query_topic = {_str(topic)} THEN CASE {' '.join(own)} ELSE 'neutral' END")
    return "CASE " + " ".join(branches) + " ELSE 'neutral' END"


@query(f"""WITH {ASKED_SQL}, t AS (SELECT *, {_route_sql(0)} AS query_topic FROM asked), c AS (SELECT *, {_class_sql()} AS cls FROM t),
g AS (SELECT *, CASE cls WHEN 'keep' THEN 2 WHEN 'neutral' THEN 1 ELSE 0 END AS tier FROM c), w AS (SELECT *, max(tier) OVER (PARTITION BY query_topic) AS best FROM g)
SELECT chunk_id, query_topic, cls FROM w WHERE tier = best""")
def three_tier_filter(spark, sf):
    rows = _asked_rows(spark, sf).withColumn("query_topic", understand.route("query")["topic"]).withColumn("source_family", rerank.source_family("version_name"))
    return rerank.three_tier_filter(rerank.classified(rows), "query_topic").select("chunk_id", "query_topic", "cls")


@query(f"""WITH {ASKED_SQL}, f AS (SELECT *, {FAMILY_SQL} AS fam, row_number() OVER (PARTITION BY qid ORDER BY hybrid_score DESC, chunk_id) AS old FROM asked),
b AS (SELECT *, fam IN ('eCFR Title 8', 'USCIS Policy Manual') AS own FROM f), s AS (SELECT *, bool_or(own) OVER (PARTITION BY qid) AS some_, CASE WHEN own THEN round(hybrid_score + 0.004::DOUBLE, 6) ELSE hybrid_score END AS score FROM b)
SELECT qid, chunk_id, score AS hybrid_score, CASE WHEN some_ THEN row_number() OVER (PARTITION BY qid ORDER BY score DESC, old, chunk_id) ELSE old END AS rank FROM s""")
def family_boost(spark, sf):
    rows = rerank.ranked(_asked_rows(spark, sf)).withColumn("source_family", rerank.source_family("version_name")).withColumn("families", F.array(F.lit("eCFR Title 8"), F.lit("USCIS Policy Manual")))
    return rerank.family_boost(rows).select("qid", "chunk_id", "hybrid_score", "rank")


@query(f"WITH {ASKED_SQL} SELECT version_name, {FAMILY_SQL} AS source_family, count(*) AS n FROM asked GROUP BY ALL")
def source_family(spark, sf):
    return _asked_rows(spark, sf).groupBy("version_name", rerank.source_family("version_name").alias("source_family")).agg(F.count("*").alias("n"))


@query(f"""WITH {ASKED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY hybrid_score DESC, chunk_id) AS rank FROM asked)
SELECT qid, max(hybrid_score) < 0.017 OR count(*) FILTER (WHERE rank <= 5 AND length(coalesce(snippet, '')) < 80) >= 3 AS weak FROM r GROUP BY qid""")
def weak_retrieval(spark, sf):
    return rerank.weak(rerank.ranked(_asked_rows(spark, sf)))


@query(f"WITH {ASKED_SQL} SELECT chunk_id, {' OR '.join(_matches('query', p) for p in rules.HIGH_RISK)} AS high_risk FROM asked")
def high_risk_questions(spark, sf):
    return _asked_rows(spark, sf).select("chunk_id", scoring.any_pattern(F.col("query"), rules.HIGH_RISK).alias("high_risk"))


@query()
def hybrid_retrieval(spark, sf):
    """The flagship: every benchmark question against all chunks."""
    best = hybrid.retrieve(_chunks(spark, sf), _lists(spark, sf), _questions(spark, sf))
    return best.select("qid", "rank", "chunk_id", "citation", "source_family", "vector_rank", "keyword_rank", "boost", "hybrid_score")


@query()
def hybrid_many(spark, sf):
    found = hybrid.retrieve_many(_chunks(spark, sf), _lists(spark, sf), _questions(spark, sf))
    return found.select("qid", "rank", "chunk_id", "sub_no", "hybrid_score")


# ---- understanding ------------------------------------------------------------------------------------------

CLASS_SQL = f"""CASE WHEN s IS NULL OR s = '' THEN 'pass' WHEN length(s) <= {rules.GREETING_CHARS} AND ({' OR '.join(_matches('s', p) for p in rules.GREETINGS)}) THEN 'greeting'
  WHEN {_matches('s', rules.CONSEQUENCE)} THEN 'pass' WHEN {_matches('s', rules.CRIMINAL_MATTER)} AND {_matches('s', rules.CRIMINAL_ACTION)} THEN 'criminal_warning'
  WHEN {' OR '.join(_matches('s', p) for p in rules.REFUSALS)} THEN 'refusal' ELSE 'pass' END"""


@query(f"WITH {ASKED_SQL} SELECT chunk_id, {CLASS_SQL} AS message_class FROM (SELECT chunk_id, {STRIP_SQL.format('query')} AS s FROM asked)")
def classify_msg(spark, sf):
    return _asked_rows(spark, sf).select("chunk_id", understand.message_class("query").alias("message_class"))


@query(f"WITH {ASKED_SQL} SELECT chunk_id, {_route_sql(0)} AS topic, {_route_sql(1)} AS intent, {_route_sql(3)} AS retrieval_query FROM asked")
def route_query(spark, sf):
    return _asked_rows(spark, sf).select("chunk_id", understand.route("query").alias("r")).select("chunk_id", "r.topic", "r.intent", "r.retrieval_query")


@query(f"WITH {VISAS_SQL} SELECT chunk_id, array_to_string(visas, '|') AS visas, array_to_string(topics, '|') AS topics, len(list_filter(visas, lambda x: x NOT IN ('EAD', 'pending'))) >= 2 OR len(topics) >= 2 AS multi_topic FROM v")
def rewrite_query(spark, sf):
    return understand.rewritten(_asked_rows(spark, sf)).select("chunk_id", F.array_join("visas", "|").alias("visas"), F.array_join("topics", "|").alias("topics"), "multi_topic")


@query()
def sub_queries(spark, sf):
    return understand.rewritten(_asked_rows(spark, sf)).select("chunk_id", F.array_join("sub_queries", "|").alias("sub_queries"), F.array_join(understand.filter_tags("visas"), "|").alias("tags"))


@query(f"WITH {ASKED_SQL} SELECT chunk_id, sha256(lower({STRIP_SQL.format('query')})) AS query_hash FROM asked")
def query_hashes(spark, sf):
    return _asked_rows(spark, sf).select("chunk_id", text.query_hash("query").alias("query_hash"))


# ---- conversations ------------------------------------------------------------------------------------------

TURNS_SQL = r"""l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS n FROM conversations),
k AS (SELECT conv_id, turn, n, lower(regexp_replace(regexp_replace(role, '^\s+', ''), '\s+$', '')) AS role, left(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', ''), 400) AS content FROM l WHERE n <= 4),
b AS (SELECT *, coalesce(sum(length(content)) OVER (PARTITION BY conv_id ORDER BY n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k WHERE role IN ('user', 'assistant') AND content <> ''),
turns AS (SELECT conv_id, turn, role, left(content, (1600 - before)::BIGINT) AS content FROM b WHERE before < 1600)"""


@query(f"WITH {TURNS_SQL} SELECT * FROM turns")
def last_turns(spark, sf):
    return conversation.last_turns(_table(spark, sf, "conversations"))


@query(f"WITH {TURNS_SQL} SELECT conv_id, arg_max(content, {{'t': turn, 'c': content}}) AS content FROM turns WHERE role = 'user' GROUP BY conv_id")
def last_user(spark, sf):
    return conversation.last_user(_table(spark, sf, "conversations"))


@query(r"""WITH k AS (SELECT conv_id, turn, lower(regexp_replace(regexp_replace(role, '^\s+', ''), '\s+$', '')) AS role, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS content FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, content DESC) AS n FROM k WHERE role IN ('user', 'assistant') AND content <> '')
SELECT conv_id, turn, role, left(content, CASE role WHEN 'user' THEN 400 ELSE 300 END) AS content FROM n WHERE n <= 4""")
def client_turns(spark, sf):
    return conversation.client_turns(_table(spark, sf, "conversations"))


FOLLOW_SQL = f"CASE WHEN s = '' OR length(s) > 120 THEN false WHEN {_matches('s', rules.FOLLOW_UP)} THEN true WHEN {_matches('s', rules.STANDALONE)} THEN false ELSE len(list_filter(regexp_split_to_array(s, '\\s+'), lambda w: w <> '')) <= 5 AND length(s) < 40 END"


@query(f"SELECT conv_id, turn, role, {FOLLOW_SQL} AS follow_up FROM (SELECT *, {STRIP_SQL.format('text')} AS s FROM conversations)")
def follow_up(spark, sf):
    return _table(spark, sf, "conversations").select("conv_id", "turn", "role", conversation.follow_up("text").alias("follow_up"))


HINTS_SQL = lambda x: "list_filter([" + ", ".join(f"CASE WHEN {_any(f'lower({x})', ws)} THEN {_str(k)} END" for k, ws in rules.TOPIC_HINTS.items()) + "], lambda x: x IS NOT NULL)"


@query(f"""WITH {TURNS_SQL}, p AS (SELECT conv_id, arg_max(content, {{'t': turn, 'c': content}}) AS prior FROM turns WHERE role = 'user' GROUP BY conv_id), j AS (SELECT c.conv_id, c.turn, {STRIP_SQL.format('c.text')} AS s, p.prior, {HINTS_SQL('c.text')} AS now, {HINTS_SQL('p.prior')} AS was FROM conversations c LEFT JOIN p USING (conv_id))
SELECT conv_id, turn, CASE WHEN {FOLLOW_SQL} AND NOT coalesce(prior IS NULL OR prior = '' OR length(s) > 100 OR (len(now) > 0 AND len(was) > 0 AND NOT list_has_any(now, was)), true) THEN left(s || ' (brief context from prior question: ' || left(prior, 150) || ')', 1200) ELSE s END AS retrieval_query FROM j""")
def context_queries(spark, sf):
    rows = _table(spark, sf, "conversations")
    prior = conversation.last_user(rows)
    return rows.join(prior.withColumnRenamed("content", "prior"), "conv_id", "left").select("conv_id", "turn", conversation.retrieval_query("text", "prior").alias("retrieval_query"))


# ---- text and chunks ----------------------------------------------------------------------------------------


@query(r"SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS clean_hash FROM documents")
def ws_clean(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", F.sha2(text.squeezed("text"), 256).alias("clean_hash"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS content_hash, length(text) // 4 AS n_tokens FROM documents")
def content_hash(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", text.content_hash("text").alias("content_hash"), text.token_estimate("text").alias("n_tokens"))


@query(chunk_sql.SENTENCE_PACK)
def sentence_pack(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", F.posexplode(chunking.sentence_chunks("text", 2000)).alias("chunk_index", "chunk_text"))


@query(chunk_sql.STRUCT_CHUNK)
def struct_chunk(spark, sf):
    return chunking.structural_chunks(_table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "chunk_index", "chunk_text", "dropped_chars")


@query(chunk_sql.PARAGRAPH_PACK)
def paragraph_pack(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", F.posexplode(chunking.paragraph_chunks("text")).alias("chunk_index", "chunk_text"))


def _sliding(preset: str) -> None:
    def run(spark, sf):
        return chunking.sliding_chunks(_table(spark, sf, "documents"), preset, keep=("doc_id",))

    run.__name__ = f"sliding_chunk_{preset}"
    query(chunk_sql.windows(preset))(run)


for _preset in chunking.PRESETS:
    _sliding(_preset)

TAGS_SQL = ", ".join(f"array_to_string(list_filter([{', '.join(f'CASE WHEN {_any(chr(108), ws)} THEN {_str(k)} END' for k, ws in table.items())}], lambda x: x IS NOT NULL), '|') AS {name}" for name, table in (("visa_types", rules.VISA_WORDS), ("topics", rules.TOPIC_WORDS), ("forms", rules.FORM_WORDS), ("actions", rules.ACTION_WORDS), ("conditions", rules.CONDITION_WORDS)))


def _tagged(spark: SparkSession, sf: str) -> DataFrame:
    """chunk_id, and what its tags are read from: citation, question, whole text."""
    i = F.col("doc_id")
    return _table(spark, sf, "documents").select(i.alias("chunk_id"), F.concat_ws(" ", _pick(CITATIONS, i), _pick(QUESTIONS, F.floor(i / 3).cast("long")), "text").alias("tagged"))


TAGGED_SQL = f"l AS (SELECT doc_id AS chunk_id, lower(concat_ws(' ', {_pick_sql(CITATIONS, 'doc_id')}, {_pick_sql(QUESTIONS, '(doc_id // 3)')}, text)) AS l FROM documents)"


@query(f"WITH {TAGGED_SQL} SELECT chunk_id, {TAGS_SQL} FROM l")
def tag_dict(spark, sf):
    tables = (("visa_types", rules.VISA_WORDS), ("topics", rules.TOPIC_WORDS), ("forms", rules.FORM_WORDS), ("actions", rules.ACTION_WORDS), ("conditions", rules.CONDITION_WORDS))
    return _tagged(spark, sf).select("chunk_id", *(F.array_join(text.tags(F.col("tagged"), ws), "|").alias(n) for n, ws in tables))


@query(f"WITH {TAGGED_SQL} SELECT chunk_id, CASE WHEN {_any('l', rules.RISK_WORDS['HIGH'])} THEN 'HIGH' WHEN {_any('l', rules.RISK_WORDS['MEDIUM'])} THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM l")
def risk_level(spark, sf):
    return _tagged(spark, sf).select("chunk_id", text.risk(F.col("tagged")).alias("risk_level"))


CITE_RE = r"(\d+)\s+I&N\s+Dec\.\s+(\d+)\s+\(([A-Za-z. ]+?)\s+(\d{4})\)"


@query(f"""WITH {ASKED_SQL} SELECT chunk_id, {', '.join(f"nullif(regexp_extract(citation, {_str(CITE_RE)}, {k}), '')::{kind} AS {name}" for k, kind, name in ((1, 'INT', 'volume'), (2, 'INT', 'page'), (3, 'VARCHAR', 'tribunal'), (4, 'INT', 'year')))},
  trim(regexp_replace(split_part(citation, ',', 1), '^\\s*matter of\\s+', '', 'i')) AS name FROM asked""")
def citation_parse(spark, sf):
    return _asked_rows(spark, sf).select("chunk_id", text.citation_parts("citation").alias("p")).select("chunk_id", "p.*")


@query(r"""SELECT page_id, coalesce(nullif(left(regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '[^\p{L}\p{N}_]+', '_', 'g'), '^_+|_+$', '', 'g'), 120), ''), 'page') AS slug FROM pages""")
def slug_url(spark, sf):
    return _table(spark, sf, "pages").select("page_id", text.slug("url").alias("slug"))


@query(r"""SELECT page_id, nullif(regexp_replace(upper(regexp_extract(lower('https://x.example/forms/i-' || (page_id % 900 + 100) || '?u=' || url), '(?:^|[/_-])([in]-?[0-9]{2,4}[a-z]?)(?:[/?#._-]|$)', 1)), '^([IN])-?', '\1-'), '') AS form FROM pages""")
def form_from_url(spark, sf):
    url = F.concat(F.lit("https://x.example/forms/i-"), (F.col("page_id") % 900 + 100).cast("string"), F.lit("?u="), "url")
    return _table(spark, sf, "pages").select("page_id", text.form_in_url(url).alias("form"))


def _strip_html_sql() -> str:
    x = "html"
    for tag in html.DROPPED:
        x = f"regexp_replace({x}, '<{tag}\\b[^>]*>.*?</{tag}>', ' ', 'gis')"
    return f"SELECT page_id, left(trim(regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'gs'), '\\s+', ' ', 'g')), 12000) AS bare FROM pages"


@query(_strip_html_sql())
def html_strip(spark, sf):
    return _table(spark, sf, "pages").select("page_id", html.bare_text("html", unescape=False).alias("bare"))


@query(chunk_sql.HTML_MAIN)
def html_main(spark, sf):
    return html.main_text(_table(spark, sf, "pages").select("page_id", "html")).select("page_id", "title", "main_text")


@query(chunk_sql.HTML_LINKS)
def html_links(spark, sf):
    return html.links(_table(spark, sf, "pages"), "https://x.example", r"^/(?<word>[^/]+)$").select("url", "page_id", "word")


@query(r"""WITH a AS (SELECT doc_id, regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS t, regexp_replace('SHORT ANSWER' || chr(10) || text, '[\s\p{Z}]+$', '') AS x FROM documents WHERE text IS NOT NULL)
SELECT doc_id, t AS short, 'one|two' AS steps, 'be careful' AS caution, left('SHORT ANSWER' || chr(10) || text || chr(10) || 'Typical next steps:' || chr(10) || '1. one' || chr(10) || '- two' || chr(10) || 'Important caution:' || chr(10) || 'be careful', 300) AS shown FROM documents JOIN a USING (doc_id)""")
def parse_sections(spark, sf):
    answer = F.concat(F.lit("SHORT ANSWER\n"), F.col("text"), F.lit("\nTypical next steps:\n1. one\n- two\nImportant caution:\nbe careful"))
    m = text.sections(answer)
    return _table(spark, sf, "documents").where("text is not null").select("doc_id", m["Short answer"].alias("short"), F.array_join(text.list_items(m["Typical next steps"]), "|").alias("steps"), m["Important caution"].alias("caution"), text.short_answer(answer).alias("shown"))


@query()
def corpus_build(spark, sf):
    chunks, posted = corpus.build(_table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("section"), "text"), 1)
    return chunks.join(posted.groupBy("chunk_id").agg(F.count("*").alias("n_postings")), "chunk_id", "left").select("section", "chunk_index", "risk_level", "n_tokens", "n_postings")


# ---- relational ---------------------------------------------------------------------------------------------


@query("""SELECT r_name, count(*) AS n_lines, count(*) FILTER (WHERE l_returnflag = 'R') AS n_returned FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name ORDER BY n_lines DESC, r_name""")
def lineage_join(spark, sf):
    t = lambda name: _table(spark, sf, name)
    lines = t("lineitem").select("l_orderkey", "l_returnflag").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    sums = lines.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"))  # before the small joins
    rows = sums.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name").agg(F.sum("n").alias("n_lines"), F.sum("r").alias("n_returned")).orderBy(F.desc("n_lines"), "r_name")


@query("""SELECT n_nationkey, n_name, count(c_custkey) AS n, count(c_custkey) FILTER (WHERE c_acctbal < 0) AS n_negative, count(c_custkey) FILTER (WHERE c_mktsegment = 'BUILDING') AS n_building
  FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY n_nationkey, n_name""")
def version_counts(spark, sf):
    children = _table(spark, sf, "customer").withColumn("n_nationkey", F.col("c_nationkey"))
    return quality.counts_by_parent(_table(spark, sf, "nation").select("n_nationkey", "n_name"), children, "n_nationkey", {"n_negative": F.col("c_acctbal") < 0, "n_building": F.col("c_mktsegment") == "BUILDING"})


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def semi_active(spark, sf):
    active = _table(spark, sf, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return _table(spark, sf, "customer").join(active, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def anti_missing(spark, sf):
    return _table(spark, sf, "customer").join(_table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name")


RANGES = [(1, 10, "small"), (11, 30, "medium"), (31, 45, "large")]


@query("SELECT range_name, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN p_size BETWEEN {a} AND {b} THEN '{n}'" for a, b, n in RANGES) + " ELSE 'other' END AS range_name FROM part) GROUP BY range_name")
def range_topic(spark, sf):
    return catalog.in_range(_table(spark, sf, "part"), F.col("p_size"), RANGES, "other").groupBy("range_name").agg(F.count("*").alias("n"))


@query("""SELECT k, side FROM (SELECT doc_id AS k, 'missing' AS side FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT vec_id, 'unexpected' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents))""")
def set_diff(spark, sf):
    return quality.absent(_table(spark, sf, "documents").select(F.col("doc_id").alias("k")), _table(spark, sf, "embeddings").select(F.col("vec_id").alias("k")), "k")


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, sf):
    return _table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).union(_table(spark, sf, "supplier").select("s_nationkey")).distinct()


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE lang = 'en') AS n_en, count(*) FILTER (WHERE source LIKE 'src1%') AS n_src1, min(length(text)) AS shortest, max(length(text)) AS longest, count(DISTINCT source) AS n_sources FROM documents""")
def filtered_agg(spark, sf):
    n = F.length("text")
    return _table(spark, sf, "documents").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == "en").alias("n_en"), F.count_if(F.col("source").like("src1%")).alias("n_src1"), F.min(n).alias("shortest"), F.max(n).alias("longest"), F.count_distinct("source").alias("n_sources"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) AS n FROM orders) WHERE n = 1")
def latest_row(spark, sf):
    return quality.latest(_table(spark, sf, "orders"), "o_custkey", [F.col("o_orderdate").desc_nulls_last(), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT doc_id, source FROM documents WHERE doc_id > 100 ORDER BY doc_id LIMIT 50")
def keyset_page(spark, sf):
    return _table(spark, sf, "documents").where("doc_id > 100").orderBy("doc_id").limit(50).select("doc_id", "source")


@query("SELECT h, count(*) AS n FROM (SELECT sha256(text) AS h FROM documents) GROUP BY h HAVING count(*) > 1")
def dup_ids(spark, sf):
    return quality.duplicates(_table(spark, sf, "documents").select(F.sha2("text", 256).alias("h")), "h")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_name ILIKE '%customer%' AND (c_mktsegment IN ('BUILDING', 'MACHINERY') OR c_acctbal IS NULL OR starts_with(c_name, 'X')) AND c_nationkey <> 3 ORDER BY c_acctbal DESC NULLS LAST, c_custkey")
def predicates(spark, sf):
    c = _table(spark, sf, "customer")
    kept = c.where(F.col("c_name").ilike("%customer%") & (F.col("c_mktsegment").isin("BUILDING", "MACHINERY") | F.col("c_acctbal").isNull() | F.col("c_name").startswith("X")) & (F.col("c_nationkey") != 3))
    return kept.orderBy(F.col("c_acctbal").desc_nulls_last(), "c_custkey").select("c_custkey", "c_name", "c_mktsegment")


# ---- lifecycle ----------------------------------------------------------------------------------------------


def _versions(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as versions: name and status follow from the key."""
    k = F.col("s_suppkey")
    return _table(spark, sf, "supplier").select(k.alias("id"), F.concat(_pick(["ecfr-", "ina-", "uscis-pm-", "bia-"], k), k.cast("string")).alias("version_name"), _pick(["ready", "active", "archived", "building", "active"], k).alias("status"), F.timestamp_seconds(k % 7 * 86400).alias("started_at"), F.lit(None).cast("timestamp").alias("completed_at"), F.lit(None).cast("timestamp").alias("activated_at"))


VERSIONS_SQL = f"""versions AS (SELECT s_suppkey AS id, {_pick_sql(['ecfr-', 'ina-', 'uscis-pm-', 'bia-'], 's_suppkey')} || s_suppkey AS version_name, {_pick_sql(['ready', 'active', 'archived', 'building', 'active'], 's_suppkey')} AS status, s_suppkey % 7 AS started FROM supplier),
pref AS (SELECT *, CASE WHEN starts_with(version_name, 'ecfr-') THEN 'ecfr-' WHEN starts_with(version_name, 'ina-') THEN 'ina-' END AS p FROM versions),
chosen AS (SELECT arg_max(id, {{'s': started, 'i': id}}) AS id FROM pref WHERE p IS NOT NULL AND status IN ('ready', 'active') GROUP BY p),
plan AS (SELECT v.*, CASE WHEN c.id IS NOT NULL AND status = 'active' THEN 'already' WHEN c.id IS NOT NULL AND status = 'ready' THEN 'activate' WHEN c.id IS NULL AND status = 'active' THEN 'demote' ELSE 'keep' END AS plan FROM versions v LEFT JOIN chosen c ON c.id = v.id)"""


@query(f"WITH {VERSIONS_SQL} SELECT id, version_name, status, plan FROM plan")
def activate_plan(spark, sf):
    return lifecycle.plan_set(_versions(spark, sf), ["ecfr-", "ina-"]).select("id", "version_name", "status", "plan")


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as the versions' chunks."""
    return _table(spark, sf, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("chunk_id"), F.col("l_suppkey").alias("version_id"), (F.col("l_returnflag") == "N").alias("is_active"), F.lit(None).cast("array<float>").alias("embedding"))


@query(f"""WITH {VERSIONS_SQL}, c AS (SELECT plan, l_returnflag = 'N' AS old, CASE plan WHEN 'activate' THEN true WHEN 'already' THEN true WHEN 'demote' THEN false ELSE l_returnflag = 'N' END AS new FROM lineitem JOIN plan ON l_suppkey = id),
n AS (SELECT plan, count(*) FILTER (WHERE old <> new) AS n_chunks FROM c GROUP BY plan), v AS (SELECT plan, count(*) AS n_versions FROM plan GROUP BY plan) SELECT plan, n_versions, coalesce(n_chunks, 0) AS n_chunks FROM v LEFT JOIN n USING (plan)""")
def activate_apply(spark, sf):
    return lifecycle.apply_plan(lifecycle.plan_set(_versions(spark, sf), ["ecfr-", "ina-"]), _parts(spark, sf))[2]


@query(f"WITH {VERSIONS_SQL} SELECT version_name, count(*) AS n FROM lineitem JOIN versions ON l_suppkey = id WHERE status = 'active' AND l_returnflag = 'N' GROUP BY version_name")
def visible_chunks(spark, sf):
    return lifecycle.visible(_parts(spark, sf), _versions(spark, sf)).groupBy("version_name").agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT user_id % 40 AS k, date_trunc('day', ts) AS ts, event_type = 'click' AS side, max(value) AS v FROM events GROUP BY ALL),
o AS (SELECT k, side, arg_max(v, ts) AS v, max(ts) AS ts FROM g GROUP BY k, side) SELECT k, v, ts FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts DESC, side DESC) AS n FROM o) WHERE n = 1""")
def upsert_latest(spark, sf):
    rows = _table(spark, sf, "events").groupBy((F.col("user_id") % 40).alias("k"), F.date_trunc("day", "ts").alias("ts"), (F.col("event_type") == "click").alias("side")).agg(F.max("value").alias("v"))
    side = lambda x: rows.where(F.col("side") == x).groupBy("k").agg(F.max_by("v", "ts").alias("v"), F.max("ts").alias("ts"))
    return lifecycle.upsert(side(False), side(True), "k", "ts").select("k", "v", "ts")


@query("SELECT count(DISTINCT sha256(text)) AS n_arriving, count(DISTINCT CASE WHEN NOT seen THEN h END) AS n_new FROM (SELECT text, sha256(text) AS h, bool_or(lang = 'en') OVER (PARTITION BY sha256(text)) AS seen FROM documents)")
def insert_if_absent(spark, sf):
    rows = _table(spark, sf, "documents").select(F.sha2("text", 256).alias("content_hash"), "lang", "doc_id")
    return lifecycle.insert_new(rows.where("lang = 'en'"), rows, ["content_hash"])[1].select("n_arriving", "n_new")


# ---- quality ------------------------------------------------------------------------------------------------


def _state(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf).withColumn("is_active", F.col("chunk_id") % 11 != 0).withColumn("status", F.when(F.col("version_name").startswith("other"), "ready").otherwise("active"))


@query(f"""WITH s AS (SELECT d.doc_id, d.text, {_pick_sql(CITATIONS, 'd.doc_id')} AS citation, {_pick_sql(VERSIONS, 'd.doc_id')} AS version_name, e.embedding, d.doc_id % 11 <> 0 AS a FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id),
t AS (SELECT *, NOT starts_with(version_name, 'other') AS act FROM s), v AS (SELECT *, a AND act AS seen FROM t),
n AS (SELECT count(*) FILTER (WHERE seen)::DOUBLE AS c1, count(*) FILTER (WHERE seen AND embedding IS NULL)::DOUBLE AS c2, count(*) FILTER (WHERE seen AND len(embedding) <> 64)::DOUBLE AS c3, count(*) FILTER (WHERE seen AND trim(citation) = '')::DOUBLE AS c4,
 count(*) FILTER (WHERE seen AND coalesce(trim(text), '') = '')::DOUBLE AS c5, count(*) FILTER (WHERE a AND NOT act)::DOUBLE AS c6, count(*) FILTER (WHERE seen AND contains(version_name, 'sample'))::DOUBLE AS c7, count(DISTINCT CASE WHEN seen THEN version_name END)::DOUBLE AS c8 FROM v)
SELECT 'visible_chunks' AS check_id, c1 >= 100 AS ok, c1 AS observed, '>= 100' AS expected FROM n UNION ALL SELECT 'visible_without_vector', c2 = 0, c2, '= 0' FROM n UNION ALL SELECT 'visible_other_width', c3 = 0, c3, '= 0' FROM n
UNION ALL SELECT 'visible_without_citation', c4 = 0, c4, '= 0' FROM n UNION ALL SELECT 'visible_without_text', c5 = 0, c5, '= 0' FROM n UNION ALL SELECT 'active_in_other_version', c6 = 0, c6, '= 0' FROM n
UNION ALL SELECT 'sample_visible', c7 = 0, c7, '= 0' FROM n UNION ALL SELECT 'active_versions', c8 >= 1, c8, '>= 1' FROM n""")
def dq_checks(spark, sf):
    return quality.corpus_checks(_state(spark, sf), 64, 100)


GOLDEN_SQL = f"""WITH {ASKED_SQL}, r AS (SELECT qid, lower(concat_ws(' ', citation, topic)) AS found_in, row_number() OVER (PARTITION BY qid ORDER BY hybrid_score DESC, chunk_id) AS rank FROM asked),
f AS (SELECT qid, min(CASE WHEN contains(found_in, '239.') OR contains(found_in, 'form') THEN rank END) AS first FROM r GROUP BY qid)"""


@query(GOLDEN_SQL + """ SELECT count(*) AS n_queries, round(avg(coalesce((first <= 1)::INT, 0)), 4) AS top1_rate, round(avg(coalesce((first <= 3)::INT, 0)), 4) AS top3_rate, round(avg(coalesce((first <= 5)::INT, 0)), 4) AS top5_rate,
  round(avg(coalesce((first <= 3)::INT, 0)), 4) >= 0.85 AS accepted FROM f""")
def golden_metrics(spark, sf):
    rows = rerank.ranked(_asked_rows(spark, sf)).select("qid", "rank", F.concat_ws(" ", "citation", "topic").alias("found_in"))
    return quality.golden(rows, rows.select("qid").distinct().withColumn("match_any", F.array(F.lit("239."), F.lit("form"))))


@query(f"""WITH {ASKED_SQL}, r AS (SELECT qid, lower(concat_ws(' ', citation, topic)) AS found_in, row_number() OVER (PARTITION BY qid ORDER BY hybrid_score DESC, chunk_id) AS rank FROM asked),
e AS (SELECT CASE WHEN qid % 2 = 0 THEN 'notices' ELSE 'forms' END AS category, qid, bool_or(rank <= 5 AND contains(found_in, CASE WHEN qid % 2 = 0 THEN '239.' ELSE 'form' END)) AS ok FROM r GROUP BY ALL)
SELECT category, count(*) AS n_queries, count(*) FILTER (WHERE ok) AS n_passing, bool_or(ok) AS covered FROM e GROUP BY category""")
def coverage(spark, sf):
    rows = rerank.ranked(_asked_rows(spark, sf)).select("qid", "rank", F.concat_ws(" ", "citation", "topic").alias("found_in"))
    asked = rows.select("qid").distinct().withColumn("category", F.when(F.col("qid") % 2 == 0, "notices").otherwise("forms"))
    return quality.coverage(rows, asked, spark.createDataFrame([("notices", ["239."]), ("forms", ["form"])], "category string, needles array<string>"))


@query(f"""WITH {ASKED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY hybrid_score DESC, chunk_id) AS rank FROM asked)
SELECT qid, '8 CFR' AS expected_citation, min(CASE WHEN starts_with(citation, '8 CFR') THEN rank END) AS found_rank, coalesce(min(CASE WHEN starts_with(citation, '8 CFR') THEN rank END) = 1, false) AS rank_1 FROM r GROUP BY qid""")
def expected_citation(spark, sf):
    rows = rerank.ranked(_asked_rows(spark, sf))
    return quality.expected_rank(rows, rows.select("qid").distinct().withColumn("expected_citation", F.lit("8 CFR")))


@query("SELECT count(*) AS n_expected, count(l.doc_id) AS n_found, round(100.0::DOUBLE * count(l.doc_id) / count(*), 2) AS percent FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def completeness(spark, sf):
    return quality.completeness(_table(spark, sf, "documents"), _table(spark, sf, "labels"), "doc_id")


@query("SELECT source, count(*) AS n, count(*) FILTER (WHERE l.quality = 1) AS n_good, count(*) FILTER (WHERE l.toxic = 1) AS n_toxic FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source")
def label_counts(spark, sf):
    rows = _table(spark, sf, "documents").select("doc_id", "source").join(_table(spark, sf, "labels"), "doc_id", "left")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("n_good"), F.count_if(F.col("toxic") == 1).alias("n_toxic"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(concat_ws(' ', p_name, p_type)), 'bolt') AND p_brand = 'Brand#13'")
def faceted_search(spark, sf):
    return catalog.faceted(_table(spark, sf, "part"), ["p_name", "p_type"], " Bolt ", "p_brand", "Brand#13").select("p_partkey", "p_name")


@query("SELECT count(*) AS n_entries, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_indexed, count(DISTINCT o_orderpriority) AS n_families FROM orders")
def catalog_stats(spark, sf):
    return catalog.stats(_table(spark, sf, "orders"), "o_orderstatus", "F", "o_orderpriority")


# ---- extensions ---------------------------------------------------------------------------------------------


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def ext_daily_events(spark, sf):
    return arrivals.counts_by_window(_table(spark, sf, "events"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def ext_rollup(spark, sf):
    return _table(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


from . import questions, reports, upkeep  # noqa: E402,F401 - register their queries here
