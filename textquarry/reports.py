"""Queries over answers of a fixed form, checks of a dataset with what it must hold, guards, and pages of decisions; see queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import rules, text
from .operators import quality, rerank, understand
from .queries import ASKED_SQL, CITATIONS, QUESTIONS, VERSIONS, _asked_rows, _matches, _pick, _pick_sql, _route_sql, _state, _str, _table, query
from .sources import html, xml

# ---- answers ------------------------------------------------------------------------------------------------

#: By doc_id: answers without a form, without a caution, whole, with repeated headers, and with some of the headers.
ANSWERS = [
    ("", "", None),
    ("Short answer:\n", "", None),
    ("SHORT ANSWER\n", "\nWhat this means\nm\nTypical next steps:\n1. s\nOfficial sources:\no\nimportant caution:\nc", "Short answer:\n{t}\nWhat this means:\nm\nTypical next steps:\n1. s\nOfficial sources:\no\nImportant caution:\nc"),
    ("Before.\nShort answer:\nWhat this means:\nm\nShort answer:\n", "\nOfficial sources:\no\nShort answer:\nlate\nTypical next steps:\ns\nImportant caution:\nc", "Before.\n\nShort answer:\n{t}\n\nWhat this means:\nm\n\nOfficial sources:\no\n\nTypical next steps:\ns\n\nImportant caution:\nc"),
    ("short answer\n", "\nImportant caution\nc", None),
]


def _said(x: str) -> str:
    return "(" + " || chr(10) || ".join(map(_str, x.split("\n"))) + ")"


def _answer_sql() -> str:
    wrapped = f"{_said('Short answer:' + chr(10))} || {{0}} || {_said(''.join(f'{chr(10)}{chr(10)}{h}:{chr(10)}{b}' for h, b in rules.WRAP.items()) + chr(10) * 2 + 'Important caution:' + chr(10))} || caution"
    some = f"{_said('Short answer:' + chr(10))} || t || {_said(chr(10) + 'Important caution:' + chr(10) + 'c')}"
    whole = lambda x: " || t || ".join(_said(p) for p in x.split("{t}"))
    cases = {0: wrapped.format("t"), 1: f"{_said('Short answer:' + chr(10))} || t || {_said(chr(10) * 2 + 'Important caution:' + chr(10))} || caution", 2: whole(ANSWERS[2][2]), 3: whole(ANSWERS[3][2]), 4: wrapped.format(f"({some})")}
    return f"""WITH a AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t, {_str(rules.CAUTION)} || CASE WHEN doc_id % 2 = 0 THEN {_str(rules.RISK_CAUTION)} ELSE '' END AS caution FROM documents)
SELECT doc_id, CASE doc_id % 5 {' '.join(f'WHEN {k} THEN {x}' for k, x in cases.items())} END AS answer FROM a WHERE t <> ''"""


@query(_answer_sql())
def structured_answers(spark, sf):
    """documents as answers in five states, brought to the form."""
    rows = _table(spark, sf, "documents").select("doc_id", text.squeezed("text").alias("t")).where("t <> ''")
    raw = F.concat(_pick([a for a, _, _ in ANSWERS], F.col("doc_id")), "t", _pick([b for _, b, _ in ANSWERS], F.col("doc_id")))
    return rows.select("doc_id", text.structured(raw, F.col("doc_id") % 2 == 0).alias("answer"))


@query(f"WITH {ASKED_SQL}, r AS (SELECT chunk_id, {_route_sql(0)} AS topic FROM asked) SELECT chunk_id, topic, CASE topic {' '.join(f'WHEN {_str(k)} THEN {_str(v)}' for k, v in rules.GUIDANCE.items())} END AS guidance FROM r")
def route_guidance(spark, sf):
    rows = _asked_rows(spark, sf).select("chunk_id", understand.route("query")["topic"].alias("topic"))
    return rows.withColumn("guidance", understand.guidance("topic"))


# ---- risk and coverage --------------------------------------------------------------------------------------

HIT = "A removal order. "
#: DuckDB takes only ASCII letters for those of words.
ASCII = r"regexp_replace(told, '[^\x00-\x7F]', 'x', 'g')"
RISK_SQL = " OR ".join("({0})".format(_matches("{0}", p)) for p in rules.HIGH_RISK)


@query(f"""WITH {ASKED_SQL}, q AS (SELECT chunk_id % 40 AS qid, {_pick_sql(QUESTIONS, '(chunk_id % 40)')} AS query, citation, topic, subtopic, CASE WHEN chunk_id % 7 = 0 THEN {_str(HIT)} ELSE '' END || coalesce(snippet, '') AS snippet,
 row_number() OVER (PARTITION BY chunk_id % 40 ORDER BY hybrid_score DESC, chunk_id) AS rank FROM asked),
g AS (SELECT qid, min(query) AS query, string_agg(coalesce(citation, '') || ' ' || coalesce(topic, '') || ' ' || coalesce(subtopic, '') || ' ' || left(snippet, 200), ' ' ORDER BY rank) FILTER (WHERE rank <= 3) AS told FROM q GROUP BY qid)
SELECT qid, {RISK_SQL.replace('{0}', 'query')} OR {RISK_SQL.replace('{0}', ASCII)} AS high_risk FROM g""")
def high_risk_results(spark, sf):
    """Questions of high risk by what they ask or by what their first three results tell."""
    rows = _asked_rows(spark, sf).withColumn("qid", F.pmod("chunk_id", F.lit(40)))
    rows = rows.withColumn("query", _pick(QUESTIONS, F.col("qid"))).withColumn("snippet", F.concat(F.when(F.col("chunk_id") % 7 == 0, HIT).otherwise(""), F.coalesce("snippet", F.lit(""))))
    return rerank.high_risk(rerank.ranked(rows))


GUARDED = ["8 CFR § 208.7", "Asylum Manual Ch. 2", "8 CFR § 274a.12(c)(8) asylum", "8 CFR § 214.2(f)(10)"]


@query(f"""WITH {ASKED_SQL}, r AS (SELECT chunk_id % 50 AS qid, {_pick_sql(GUARDED, '(chunk_id % 50 // 5 % 3 * (chunk_id // 50) % 4)')} AS citation, row_number() OVER (PARTITION BY chunk_id % 50 ORDER BY hybrid_score DESC, chunk_id) AS rank FROM asked),
e AS (SELECT qid, CASE WHEN qid % 3 = 0 THEN 'opt' ELSE 'asylum' END AS category, bool_or(rank <= 5 AND contains(lower(citation), CASE WHEN qid % 3 = 0 THEN '8 cfr' ELSE 'asylum' END)) AS hit,
 count(*) FILTER (WHERE rank <= 3 AND (contains(citation, '208.') OR contains(lower(citation), 'asylum')) AND NOT (contains(citation, '274a') OR contains(citation, '214.2'))) = 3 AS bare FROM r GROUP BY qid)
SELECT category, count(*) AS n_queries, count(*) FILTER (WHERE hit AND NOT (bare AND category = 'opt')) AS n_passing, bool_or(hit AND NOT (bare AND category = 'opt')) AS covered FROM e GROUP BY category""")
def coverage_guarded(spark, sf):
    """Coverage in which questions on practical training fail where all they find is of asylum."""
    i = F.col("chunk_id")
    number = (F.floor(i % 50 / 5) % 3 * F.floor(i / 50)) % 4
    rows = rerank.ranked(_asked_rows(spark, sf).withColumn("qid", i % 50).withColumn("citation", _pick(GUARDED, number)))
    asked = rows.select("qid").distinct().withColumn("category", F.when(F.col("qid") % 3 == 0, "opt").otherwise("asylum")).withColumn("guarded", F.col("category") == "opt")
    needles = spark.createDataFrame([("opt", ["8 CFR"]), ("asylum", ["asylum"])], "category string, needles array<string>")
    return quality.coverage(rows.withColumn("found_in", F.col("citation")), asked, needles)


# ---- a dataset with what it must hold -----------------------------------------------------------------------

EXPECTED = [*CITATIONS[:4], "8 CFR § 999.9"]
CHECKS = {"expected_missing": "NOT there", "expected_inactive": "there AND NOT active", "expected_without_vector": "there AND NOT embedded", "expected_other_width": "other_width"}


@query(f"""WITH s AS (SELECT d.doc_id, d.text, {_pick_sql(CITATIONS, 'd.doc_id')} AS citation, {_pick_sql(VERSIONS, 'd.doc_id')} AS version_name, e.embedding, d.doc_id % 11 <> 0 AS a FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id),
t AS (SELECT *, NOT starts_with(version_name, 'other') AS act FROM s),
f AS (SELECT x.c, count(t.doc_id) > 0 AS there, coalesce(bool_and(a), false) AS active, coalesce(bool_and(embedding IS NOT NULL), false) AS embedded, coalesce(bool_or(len(embedding) <> 64), false) AS other_width
 FROM (SELECT unnest([{', '.join(map(_str, EXPECTED))}]) AS c) x LEFT JOIN t ON t.citation = x.c AND act GROUP BY x.c)
{' UNION ALL '.join(f"SELECT {_str(k)} AS check_id, count(*) FILTER (WHERE {c}) = 0 AS ok, count(*) FILTER (WHERE {c})::DOUBLE AS observed, '= 0' AS expected FROM f" for k, c in CHECKS.items())}
UNION ALL SELECT 'answers_logged', count(*) = 0, count(*)::DOUBLE, '= 0' FROM events WHERE event_type = 'error'""")
def dataset_checks(spark, sf):
    """The checks on expected citations and on logs; those that dq_checks has too are left out here."""
    expected = spark.createDataFrame([(c,) for c in EXPECTED], "citation string")
    found = quality.dataset_checks(_state(spark, sf), expected, _table(spark, sf, "events").where("event_type = 'error'"), 64, 100)
    return found.where(F.col("check_id").startswith("expected_") | (F.col("check_id") == "answers_logged"))


# ---- decisions ----------------------------------------------------------------------------------------------

ON_A_PAGE = 12


@query(f"""WITH d AS (SELECT doc_id // {ON_A_PAGE} AS page_id, doc_id, source, coalesce(trim(regexp_replace(text, '\\s+', ' ', 'g')), '') AS note, count(*) OVER (PARTITION BY doc_id // {ON_A_PAGE}) AS n FROM documents)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY doc_id) AS number, doc_id::VARCHAR AS decision, 'Matter of ' || coalesce(source, '') || ', 9 I&N Dec. ' || doc_id || ' (BIA 2001)' AS citation, 'Matter of ' || coalesce(source, '') AS case_name,
 'https://x.example/' || doc_id || '.pdf' AS pdf_url, CASE WHEN page_id % 2 = 0 AND n > 10 OR length(note) <= 20 OR starts_with(note, 'Updated') THEN '' ELSE note END AS headnotes FROM d""")
def decision_pages(spark, sf):
    """documents written as pages of decisions, in the old layout and the new by turns, and read back."""
    i = F.col("doc_id").cast("string")
    cite = F.concat(F.lit("<td>Matter of <i>"), F.coalesce(xml.escaped("source"), F.lit("")), F.lit("</i>, 9 I&amp;N Dec. "), i, F.lit(" (BIA 2001)</td>"))
    cite = F.regexp_replace(cite, "</i>,", ",</i>")  # tags part words
    link = lambda said: F.concat(F.lit('<td><a href="/'), i, F.lit(f'.pdf">{said}'), i, F.lit("</a> (PDF)</td>"))
    row = F.concat(F.lit("<tr>"), cite, link(""), F.lit("</tr>"))
    block = F.concat(F.lit("<table><tr>"), cite, link("ID "), F.lit("</tr></table>\n<p>Updated on a day of that year</p><p>short</p><p>"), F.coalesce(xml.escaped("text"), F.lit("")), F.lit("</p>\n"))
    rows = _table(spark, sf, "documents").select(F.floor(F.col("doc_id") / ON_A_PAGE).alias("page_id"), "doc_id", row.alias("row"), block.alias("block"))
    pages = rows.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", "row", "block"))).alias("all"))
    each = lambda name: F.transform("all", lambda x: x[name])
    old = F.concat(F.lit("<html><body><table>"), F.array_join(each("row"), "\n"), F.lit("</table></body></html>"))
    page = F.when((F.col("page_id") % 2 == 0) & (F.size("all") > 10), old).otherwise(F.concat(F.lit("<html><body>"), F.array_join(each("block"), "<hr/>"), F.lit("</body></html>")))
    found = html.decisions(pages.select("page_id", page.alias("html")), base="https://x.example/")
    return found.withColumn("headnotes", F.array_join("headnotes", "\n"))
