"""Queries over taking questions in, ingest and its checks; see queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import chunking, text
from .operators import catalog, conversation, intake, lifecycle, quality, rerank, understand, vector
from .queries import ASKED_SQL, CITATIONS, VERSIONS, _asked_rows, _chunks, _pick, _pick_sql, _state, _str, _table, query

#: message, category, what is searched (a category's query by its name, else the text itself), broad topic, narrow or not, intent, prepared answers. By hand.
CASES = [
    ("How do I become a U.S. citizen?", None, None, "naturalization", False, "process_info", ""),
    ("How do I apply for an EAD?", "tps", "tps", "ead", False, "process_info", ""),
    ("What are the requirements for naturalization?", None, "naturalization_residence", None, True, "general_info", ""),
    ("Explain the H-4 visa process", None, "h4_process", None, False, "general_info", "h4_process"),
    ("What is H-4 EAD?", None, "h4_ead", None, False, "general_info", "h4_ead,h4_process"),
    ("My H-4 EAD was denied, what should I do?", None, "h4_ead", None, False, "general_info", ""),
    ("Which crimes make a person inadmissible?", None, "criminal_inadmissibility", None, False, "general_info", "criminal_info"),
    ("Does a DUI make someone deportable?", None, "criminal_deportability", None, False, "general_info", "criminal_info,dui_info"),
    ("Can I apply for asylum?", None, None, "asylum", False, "general_info", ""),
    ("Can I apply for asylum?", "asylum_defensive", "asylum_defensive", "asylum", False, "general_info", ""),
    ("How do I get a green card?", "no such category", None, "aos", False, "process_info", ""),
    ("What should I do after receiving a Notice to Appear?", "nta_court", "nta_court", "nta", False, "general_info", ""),
    ("What is a Notice to Appear?", None, None, None, True, "general_info", ""),
    ("Can I change my status?", None, None, "status_change", False, "case_specific_or_risk", ""),
    ("Can I travel while my application is pending?", "travel_not_sure", "travel_not_sure", "travel", False, "case_specific_or_risk", ""),
    ("How do I file Form I-130?", None, None, "family_petition", False, "process_info", ""),
    ("I overstayed in 2019. How do I apply for employment authorization?", None, None, "ead", False, "case_specific_or_risk", ""),
    ("What is CIMT?", None, "criminal_inadmissibility", None, False, "general_info", ""),
    ("  How does the lottery work?  ", None, None, None, False, "process_info", ""),
    ("Can TPS holders work?", "", None, None, True, "general_info", ""),
]
_TEXTS = [c[0] for c in CASES]


def _list(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else str(v).lower() if isinstance(v, bool) else _str(v) for v in values) + "]"


def _case(k: int) -> str:
    return f"({_list([c[k] for c in CASES])})[1 + doc_id % {len(CASES)}]"


def _resolved() -> str:
    # the queries of the categories that occur, as the reader is shown them
    said = {
        "tps": "Temporary Protected Status TPS employment authorization Form I-765 8 CFR 244", "naturalization_residence": "Naturalization Form N-400 continuous residence physical presence good moral character",
        "h4_process": "H-4 dependent nonimmigrant status spouse child of H-1B 8 CFR 214.2(h)(9)(iv) H-4 visa change of status extension of stay consular processing Form I-539",
        "h4_ead": "H-4 EAD employment authorization H-4 spouse 8 CFR 274a.12(c)(26) Form I-765 H-1B principal approved I-140 AC21 extension beyond six years H-4 dependent employment authorization document",
        "criminal_inadmissibility": "INA 212(a)(2) 8 U.S.C. 1182(a)(2) criminal grounds of inadmissibility crimes involving moral turpitude CIMT controlled substance violation multiple criminal convictions trafficking aggravated felony conviction inadmissibility bar",
        "criminal_deportability": "INA 237(a)(2) 8 U.S.C. 1227(a)(2) criminal grounds of deportability aggravated felony crimes involving moral turpitude controlled substance domestic violence firearms conviction removal deportation",
        "asylum_defensive": "Defensive asylum removal proceedings immigration judge Form I-589", "nta_court": "Notice to Appear removal proceedings immigration court 8 CFR 239 EOIR",
        "travel_not_sure": "Advance parole travel authorization pending immigration case Form I-131",
    }
    return f"({_list([said[c[2]] if c[2] else c[0].strip() for c in CASES])})[1 + doc_id % {len(CASES)}]"


def _messages(spark, sf):
    rows = _table(spark, sf, "documents").select(F.col("doc_id").alias("qid"))
    return rows.select("qid", _pick(_TEXTS, F.col("qid")).alias("message"), _pick([c[1] or "" for c in CASES], F.col("qid")).alias("category"))


@query(f"SELECT doc_id AS qid, {_resolved()} AS resolved FROM documents")
def resolve_query(spark, sf):
    return _messages(spark, sf).select("qid", intake.resolved_query("message", "category").alias("resolved"))


@query(f"SELECT doc_id AS qid, {_case(3)} AS topic, {_case(4)} AS narrow FROM documents")
def broad_topics(spark, sf):
    return _messages(spark, sf).select("qid", intake.broad_topic("message").alias("topic"), intake.is_specific("message").alias("narrow"))


@query(f"""WITH c(topic, question, n_options, first_category) AS (VALUES ('ead', 'Which category best matches you?', 6, 'asylum_pending'), ('asylum', 'Which situation best matches you?', 3, 'asylum_eligibility'),
  ('aos', 'Which path are you asking about?', 3, 'aos_family'), ('naturalization', 'Which situation best matches you?', 4, 'naturalization_residence'), ('nta', 'What do you need help with?', 3, 'nta_court'),
  ('status_change', 'Which best matches you?', 3, 'status_extend'), ('travel', 'Which situation best matches you?', 3, 'travel_aos'), ('family_petition', 'Which relationship category applies?', 3, 'family_immediate'))
SELECT d.doc_id AS qid, c.question, c.n_options, c.first_category FROM (SELECT doc_id, {_case(3)} AS topic FROM documents) d LEFT JOIN c USING (topic)""")
def clarification(spark, sf):
    rows = intake.clarifications(_messages(spark, sf).withColumn("broad_topic", intake.broad_topic("message")))
    options = F.col("clarification.options")
    return rows.select("qid", "clarification.question", F.when(options.isNotNull(), F.size(options)).alias("n_options"), F.get(options, F.lit(0))["category"].alias("first_category"))


@query(f"SELECT doc_id AS qid, {_case(5)} AS intent, {_case(6)} AS prepared FROM documents")
def answer_kind(spark, sf):
    a = F.col("a")
    names = F.filter(F.array(*(F.when(a[n], F.lit(n)) for n in ("criminal_info", "dui_info", "h4_ead", "h4_process"))), lambda x: x.isNotNull())
    rows = _messages(spark, sf).select("qid", intake.answer_intent("message").alias("intent"), intake.prepared_answers("message").alias("a"))
    return rows.select("qid", "intent", F.array_join(names, ",").alias("prepared"))


TOP_SQL = f"{ASKED_SQL}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY hybrid_score DESC, chunk_id) AS rank FROM asked) WHERE rank <= 5)"
CONTEXT_SQL = f"""{TOP_SQL}, ctx AS (SELECT qid, string_agg('[' || rank || '] ' || citation || chr(10) || 'Chunk ID: ' || chunk_id || ' | Hybrid Score: ' || printf('%.6f', hybrid_score)
  || coalesce(chr(10) || 'Topic: ' || nullif(concat_ws(' — ', nullif(topic, ''), nullif(subtopic, '')), ''), '') || coalesce(chr(10) || chr(10) || nullif(snippet, ''), ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM top GROUP BY qid)"""


def _best(spark, sf):
    return rerank.ranked(_asked_rows(spark, sf)).where("rank <= 5").withColumn("risk_level", F.lit(None).cast("string"))


@query(f"WITH {CONTEXT_SQL} SELECT qid, md5(context) AS context_md5, length(context) AS n_chars FROM ctx")
def source_context(spark, sf):
    return intake.source_context(_best(spark, sf)).select("qid", F.md5("context").alias("context_md5"), F.length("context").alias("n_chars"))


@query(f"WITH {TOP_SQL}, f AS (SELECT qid, citation, min(rank) AS r FROM top GROUP BY ALL) SELECT f.qid, row_number() OVER (PARTITION BY f.qid ORDER BY r) AS place, f.citation, t.topic, t.subtopic FROM f JOIN top t ON t.qid = f.qid AND t.rank = f.r")
def citations_once(spark, sf):
    return intake.citations(_best(spark, sf)).select("qid", "place", "citation", "topic", "subtopic")


@query(f"""WITH {CONTEXT_SQL}, t AS (SELECT conv_id, string_agg(upper(role[1]) || lower(role[2:]) || ': ' || text, chr(10) ORDER BY turn, role, text) AS turns FROM conversations WHERE turn <= 2 GROUP BY conv_id)
SELECT t.conv_id AS qid, md5('Earlier turns, for reference only:' || chr(10) || turns || chr(10) || chr(10) || 'Question: what now?' || CASE WHEN t.conv_id % 2 = 0 THEN chr(10) || 'Category chosen: tps' || chr(10) ELSE '' END
  || chr(10) || 'Sources:' || chr(10) || coalesce(context, '') || chr(10) || chr(10) || 'Answer from these sources alone, and cite them.') AS prompt_md5 FROM t LEFT JOIN ctx ON ctx.qid = t.conv_id""")
def prompt_text(spark, sf):
    turns = _table(spark, sf, "conversations").where("turn <= 2").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("conversation"))
    asked = turns.select(F.col("conv_id").alias("qid"), F.lit("what now?").alias("message"), F.when(F.col("conv_id") % 2 == 0, "tps").alias("category"), "conversation")
    return intake.prompts(asked, intake.source_context(_best(spark, sf))).select("qid", F.md5("prompt").alias("prompt_md5"))


# ---- chunks of sections -------------------------------------------------------------------------------------

STARTS = ["(10) Practical training ", "  (i) Curricular practical training ", "(ii) Optional practical training ", "(iii) Internship with an international organization ", "(iii) Curricular practical training ", "(b) Other ", "No marker "]
CITED = ["8 CFR § 214.2(f)(10)", "8 CFR § 214.2(f)(10)(i)", "8 CFR § 214.2(f)(10)(ii)", "8 CFR § 214.2(f)(10)(iii)", "8 CFR § 274a.12(b)(6)(iii)", "8 CFR § 1.2(b)", "8 CFR § 1.2"]
SECTIONS = ["214.2", "214.2", "214.2", "214.2", "274a.12", "1.2", "1.2"]


@query(f"SELECT doc_id, {_pick_sql(CITED, 'doc_id')} AS citation FROM documents")
def canonical_citation(spark, sf):
    i = F.col("doc_id")
    return _table(spark, sf, "documents").select("doc_id", text.chunk_citation(_pick(SECTIONS, i), F.concat(_pick(STARTS, i), F.lit("and more text"))).alias("citation"))


@query("SELECT doc_id, 0 AS chunk_index, length(trim(text)) AS n_chars, md5(trim(text)) AS text_md5 FROM documents WHERE trim(text) <> ''")
def whole_section(spark, sf):
    return chunking.whole_sections(_table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "chunk_index", F.length("chunk_text").alias("n_chars"), F.md5("chunk_text").alias("text_md5"))


@query("SELECT doc_id, generate_subscripts(ls, 1) - 1 AS chunk_index, len(ls) AS total_chunks FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)")
def total_chunks(spark, sf):
    lines = _table(spark, sf, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "line"))
    return chunking.with_totals(lines, "doc_id").select("doc_id", "chunk_index", "total_chunks")


@query("SELECT o_custkey, o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL")
def first_sections(spark, sf):
    return lifecycle.first_seen(_table(spark, sf, "orders"), ["o_custkey", "o_orderpriority"], "o_orderkey")


@query("""SELECT conv_id, max(turn) AS updated, count(*) AS n_turns, left(arg_min(text, turn) FILTER (WHERE lower(trim(role)) = 'user'), 60) AS title FROM conversations GROUP BY conv_id""")
def sessions(spark, sf):
    return conversation.sessions(_table(spark, sf, "conversations")).select("conv_id", "updated", "n_turns", "title")


# ---- ingest -------------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT 1 AS step, 'registry' AS table_name, count(DISTINCT source) AS n_arriving, count(DISTINCT source) FILTER (WHERE source NOT IN (SELECT source FROM documents WHERE doc_id % 2 = 0 AND source IS NOT NULL)) AS n_new FROM documents WHERE source IS NOT NULL
  UNION ALL SELECT 2, 'raw', count(DISTINCT h), count(DISTINCT h) FILTER (WHERE h NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL)) FROM (SELECT md5(text) AS h FROM documents WHERE text IS NOT NULL)
  UNION ALL SELECT 3, 'section', count(DISTINCT doc_id), count(DISTINCT doc_id) FILTER (WHERE doc_id % 2 <> 0) FROM documents) SELECT step, table_name, n_arriving, n_new, n_arriving - n_new AS n_reused FROM c""")
def ingest_chain(spark, sf):
    docs = _table(spark, sf, "documents")
    rows = {"registry": docs.where("source is not null").select("source", "doc_id"), "raw": docs.where("text is not null").select(F.md5("text").alias("hash"), "doc_id"), "section": docs.select("doc_id", "lang")}
    keys = {"registry": ["source"], "raw": ["hash"], "section": ["doc_id"]}
    stored = {n: r.where("doc_id % 2 = 0") for n, r in rows.items()}
    return lifecycle.ingest(stored, [(n, rows[n], keys[n]) for n in rows])[1]


@query("SELECT 'events' AS table_name, count(*) AS n_rows, 0 AS n_cleared, count(*) AS n_left FROM events UNION ALL SELECT 'labels', count(*), count(*), 0 FROM labels")
def privacy_reset(spark, sf):
    return lifecycle.cleared(_table(spark, sf, "events"), "events")[1].unionByName(lifecycle.cleared(_table(spark, sf, "labels"), "labels", execute=True)[1])


@query("SELECT count(*) FILTER (WHERE t AND l.doc_id IS NULL) AS n_insert, count(*) FILTER (WHERE t AND l.doc_id IS NOT NULL) AS n_there, count(*) FILTER (WHERE NOT t) AS n_empty FROM (SELECT doc_id, coalesce(trim(text), '') <> '' AS t FROM documents) d LEFT JOIN labels l USING (doc_id)")
def insert_plan(spark, sf):
    return lifecycle.insert_plan(_table(spark, sf, "documents"), _table(spark, sf, "labels"), ["doc_id"], "text")


@query("SELECT doc_id // 100 AS batch_no, min(doc_id) AS first_id, max(doc_id) AS last_id, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 3 = 0) GROUP BY batch_no")
def embed_plan(spark, sf):
    return lifecycle.embed_plan(_table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id")), _table(spark, sf, "embeddings").where("vec_id % 3 = 0").select(F.col("vec_id").alias("chunk_id")), 100)


def _check_sql(rows: list[tuple[str, str, str, float]], source: str) -> str:
    return " UNION ALL ".join(f"SELECT {_str(n)} AS check_id, coalesce(({x}) {how} {v}, false) AS ok, ({x})::DOUBLE AS observed, {_str(f'{how} {v:g}')} AS expected {source}" for n, x, how, v in rows)


@query(_check_sql([
    ("missing_sections", "SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)", "=", 0),
    ("unexpected_sections", "SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)", "=", 0),
    ("sections_without_chunks", "SELECT count(*) FROM (SELECT DISTINCT doc_id FROM labels) WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)", "=", 0),
    ("active_too_early", "SELECT count(*) FROM embeddings WHERE label = 3 AND vec_id IN (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels)", "=", 0),
    ("embedded_too_early", "SELECT count(*) FROM embeddings WHERE embedding IS NOT NULL AND vec_id IN (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels)", "=", 0)], ""))
def insert_checks(spark, sf):
    section = F.col("doc_id").alias("section")
    chunks = _table(spark, sf, "embeddings").select(F.col("vec_id").alias("section"), (F.col("label") == 3).alias("is_active"), "embedding")
    return quality.insert_checks(_table(spark, sf, "documents").select(section), chunks, _table(spark, sf, "labels").select(section))


STATE_SQL = f"""s AS (SELECT d.doc_id, {_pick_sql(CITATIONS, 'd.doc_id')} AS citation, {_pick_sql(VERSIONS, 'd.doc_id')} AS version_name, e.embedding, d.doc_id % 11 <> 0 AS a FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id),
v AS (SELECT *, a AND NOT starts_with(version_name, 'other') AS seen, NOT starts_with(version_name, 'other') AS active FROM s)"""


@query(f"WITH {STATE_SQL} " + _check_sql([
    ("active_versions", "SELECT count(DISTINCT version_name) FILTER (WHERE active) FROM v", "=", 1),
    ("visible_chunks", "SELECT count(*) FILTER (WHERE seen) FROM v", "=", 500),
    ("visible_other_width", "SELECT count(*) FILTER (WHERE seen AND coalesce(len(embedding), -1) <> 64) FROM v", "=", 0),
    ("missing_citations", "SELECT 2 - count(DISTINCT citation) FILTER (WHERE seen AND citation IN ('8 CFR § 239.1', '8 CFR § 999.9')) FROM v", "=", 0),
    ("logged_answers", "SELECT 3", "=", 0)], ""))
def readiness(spark, sf):
    return quality.readiness(_state(spark, sf), 64, 500, ["8 CFR § 239.1", "8 CFR § 999.9"], 3)


@query(f"WITH {STATE_SQL} " + _check_sql([
    ("active_embedded", "SELECT count(*) FILTER (WHERE seen AND embedding IS NOT NULL) FROM v", ">=", 100),
    ("sample_active", "SELECT count(*) FILTER (WHERE seen AND embedding IS NOT NULL AND contains(version_name, 'sample')) FROM v", "=", 0),
    ("case_law_active", "SELECT count(*) FILTER (WHERE seen AND embedding IS NOT NULL AND starts_with(version_name, 'bia')) FROM v", "=", 0)], ""))
def handoff(spark, sf):
    return quality.handoff(_state(spark, sf), 100)


@query("SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND l_linenumber = 1 AND l_returnflag = 'R'")
def section_join(spark, sf):
    orders, lines = _table(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey"), _table(spark, sf, "lineitem").where("l_linenumber = 1 and l_returnflag = 'R'")
    return orders.join(lines.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber"), "o_orderkey")


@query("SELECT lang, count(*) AS n, coalesce(sum(length(text)), 0)::BIGINT AS n_chars, round(avg(length(text)), 4) AS mean_chars, max(length(text)) AS longest FROM documents GROUP BY lang")
def text_summary(spark, sf):
    return quality.summary(_table(spark, sf, "documents"), "lang", "text")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 10")
def missing_sample(spark, sf):
    return quality.missing_sample(_table(spark, sf, "documents"), _table(spark, sf, "labels"), "doc_id")


@query("""SELECT qid, citation, distance FROM (SELECT q.vec_id AS qid, e.vec_id AS chunk_id, round(list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS distance,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6), e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0) k
  JOIN (SELECT doc_id, """ + _pick_sql(CITATIONS, "doc_id") + """ AS citation FROM documents) d ON d.doc_id = k.chunk_id WHERE rank <= 10""")
def knn_citations(spark, sf):
    e = _table(spark, sf, "embeddings")
    near = vector.vector_topk(e.select(F.col("vec_id").alias("chunk_id"), "embedding"), e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector")), 10)
    return near.join(_chunks(spark, sf).select("chunk_id", "citation"), "chunk_id").select("qid", "citation", "distance")


# ---- small functions over whole tables ----------------------------------------------------------------------


@query("SELECT c_mktsegment, (['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY', 'HOUSEHOLD'].list_position(c_mktsegment))::INT AS place, count(*) AS n FROM customer WHERE contains(lower(c_name), '1') GROUP BY ALL")
def grouped_search(spark, sf):
    return catalog.grouped(catalog.faceted(_table(spark, sf, "customer"), ["c_name"], "1"), "c_mktsegment", ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD"])


@query("SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE contains(lower(concat_ws(' ', c_name, c_mktsegment, n_name)), 'ing')")
def joined_search(spark, sf):
    rows = _table(spark, sf, "customer").join(F.broadcast(_table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")), "c_nationkey")
    return catalog.faceted(rows, ["c_name", "c_mktsegment", "n_name"], "ING").select("c_custkey")


@query("SELECT doc_id, printf('BIA_ID_%d_chunk_%04d', doc_id, doc_id % 7) AS name, make_date(2000 + (doc_id % 20)::INT, 1, 1)::VARCHAR AS decided FROM documents")
def chunk_names(spark, sf):
    i = F.col("doc_id")
    return _table(spark, sf, "documents").select("doc_id", text.chunk_name(i, i % 7).alias("name"), text.first_of_year((i % 20 + 2000).cast("int")).cast("string").alias("decided"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'empty query' WHEN 1 THEN 'query too long' WHEN 2 THEN 'top_k out of range' END AS wrong, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN repeat('x', 1001) WHEN 2 THEN 'fine' ELSE 'also fine' END AS query FROM documents""")
def request_check(spark, sf):
    i = F.col("doc_id") % 4
    rows = _table(spark, sf, "documents").select("doc_id", F.when(i == 0, "  ").when(i == 1, "x" * 1001).when(i == 2, " fine ").otherwise("also fine").alias("query"), F.when(i == 2, 11).otherwise(F.lit(10)).alias("top_k"))
    return understand.validated(rows).select("doc_id", "wrong", "query")


@query("SELECT page_id, len(list_distinct(list_filter([html, left(html, 10000), left(html, 8000), left(html, 6000), left(html, 4000), left(html, 2500), left(html, 1500), left(html, 800), url || ' ' || left(html, 500), url], lambda x: x IS NOT NULL AND trim(x) <> ''))) AS n_attempts FROM pages WHERE url IS NOT NULL AND html IS NOT NULL")
def embedding_attempts(spark, sf):
    return _table(spark, sf, "pages").where("url is not null and html is not null").select("page_id", F.size(vector.attempts("html", "url")).alias("n_attempts"))


@query("SELECT doc_id, (CASE WHEN coalesce(trim(source), '') = '' THEN 1 ELSE 0 END + CASE WHEN length(coalesce(text, '')) < 100 THEN 1 ELSE 0 END) AS n_problems FROM documents")
def record_problems(spark, sf):
    return quality.record_problems(_table(spark, sf, "documents"), ["source"]).select("doc_id", F.size("problems").alias("n_problems"))


@query("SELECT 'hash_least' AS check_id, min(length(sha256(text))) = 64 AS ok, min(length(sha256(text)))::DOUBLE AS observed, '= 64' AS expected FROM conversations UNION ALL SELECT 'hash_most', max(length(sha256(text))) = 64, max(length(sha256(text)))::DOUBLE, '= 64' FROM conversations UNION ALL SELECT 'text_columns', true, 0, '= 0'")
def log_check(spark, sf):
    return quality.log_check(_table(spark, sf, "conversations").select("conv_id", F.sha2("text", 256).alias("question_hash")))


@query("SELECT conv_id, string_agg(n || '. ' || text, chr(10) ORDER BY n) AS steps FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM conversations) GROUP BY conv_id")
def numbered_steps(spark, sf):
    rows = _table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return rows.select("conv_id", catalog.numbered(F.transform("t", lambda t: t["text"])).alias("steps"))
