"""Answers of a fixed form, pages of decisions, checks and guards, by rows made by hand."""

import pytest
from pyspark.sql import functions as F

from textquarry.functions import chunking, rules, text
from textquarry.operators import quality, rerank, understand
from textquarry.sources import html

FORM = "What this means:\nm\n\nTypical next steps:\ns\n\nOfficial sources:\no\n\nImportant caution:\nc"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("answer", "expected"), [
    (None, None),
    ("", ""),
    ("no form at all", "no form at all"),
    ("Short answer:\na", "Short answer:\na"),
    ("Short answer:\nShort answer:\na", "Short answer:\na"),
    ("Short answer:\n\nShort answer:\na", "Short answer:Short answer:\na"),  # an empty line goes with the header behind it, as in the rule for spelling
    ("Hello.\nshort answer\na\nWhat this means:\nm\nSHORT ANSWER:\nb", "Hello.\n\nShort answer:\na\n\nWhat this means:\nm"),
    ("What this means:\nm\nShort answer:\nWhat this means:\nn", "What this means:\nm\n\nShort answer:"),
])
def test_headers_once(spark, answer, expected):
    assert one(spark, text.deduplicated(F.lit(answer).cast("string"))) == expected


def test_structured(spark):
    whole = f"Short answer:\na\n\n{FORM}"
    shown = one(spark, text.structured(F.lit(whole)))
    assert [shown.count(f"{h}:") for h in rules.SECTIONS] == [1] * 5 and rules.CAUTION not in shown
    assert one(spark, text.structured(F.lit("Short answer:\na  \n"))) == f"Short answer:\na\n\nImportant caution:\n{rules.CAUTION}"
    wrapped = one(spark, text.structured(F.lit("just words"), F.lit(True)))
    assert wrapped.startswith("Short answer:\njust words\n\nWhat this means:\n") and wrapped.endswith(rules.CAUTION + rules.RISK_CAUTION)
    assert one(spark, text.structured(F.lit(None).cast("string"))).startswith("Short answer:\n\n\nWhat this means:")


def test_guidance_for_every_route(spark):
    assert {r[0] for r in rules.ROUTES} == set(rules.GUIDANCE)
    said = spark.createDataFrame([(t,) for t in [*rules.GUIDANCE, "general", None]], "topic string").withColumn("g", understand.guidance("topic")).collect()
    assert {r.topic: r.g for r in said} == rules.GUIDANCE | {"general": None, None: None}


BLOCK = '<table><tr><td>Matter of {0}, 27 I&amp;N Dec. 1 (BIA 2017)</td><td><a href="/eoir/{1}.pdf">ID {1}</a> (PDF)</td></tr></table>\n<p>Updated on some later day of the year</p><p>A headnote of &lt;more&gt; than twenty signs.</p><p>short</p>'
OLD = '<tr><td>Matter of&nbsp;{0}, 8 I&amp;N Dec. 3 (BIA 1958)</td><td><a href="https://y.example/{1}.pdf">{1}</a> (PDF)</td></tr>'


def test_decisions_of_both_layouts(spark):
    new = "<hr>".join(BLOCK.format(n, i) for n, i in (("A-B-", 4193), ("C-", 4194))) + "<hr/><p>An end without any link at all, long enough.</p>"
    old = "<table>" + "".join(OLD.format(f"N{i}", 2000 + i) for i in range(11)) + "<tr><td>no link (PDF)</td></tr></table>"
    few = "<table>" + "".join(OLD.format(f"N{i}", 2000 + i) for i in range(10)) + "</table>"  # ten rows aren't the old layout
    pages = spark.createDataFrame([(1, new), (2, old), (3, few), (4, None), (5, "")], "page_id int, html string")
    found = html.decisions(pages, base="https://x.example").orderBy("page_id", "number").collect()
    assert [(r.page_id, r.number, r.decision) for r in found] == [(1, 1, "4193"), (1, 2, "4194"), *((2, i + 1, str(2000 + i)) for i in range(11))]
    assert found[0].citation == "Matter of A-B-, 27 I&N Dec. 1 (BIA 2017)" and found[0].case_name == "Matter of A-B-"
    assert found[0].pdf_url == "https://x.example/eoir/4193.pdf" and found[0].headnotes == ["A headnote of <more> than twenty signs."]
    assert found[2].case_name == "Matter of N0" and found[2].pdf_url == "https://y.example/2000.pdf" and found[2].headnotes == []


def test_pieces_are_cut_at_their_ends_whatever_their_place(spark):
    """Pieces lose white space, not the figures of their place."""
    body = "x" * 1500
    sections = spark.createDataFrame([(1, f"0 first {body} (a) 1 second {body} (1) {body}0")], "id int, text string")
    found = [r.chunk_text for r in chunking.structural_chunks(sections).orderBy("chunk_index").collect()]
    assert found == [f"0 first {body}", f"(a) 1 second {body}", f"(1) {body}0"]
    paragraphs = one(spark, chunking.paragraph_chunks(F.lit(f"0 one 0\n\n1 {body} 1\n \n {body}{body}2\n")))
    assert paragraphs == [f"0 one 0\n\n1 {body} 1", f"{body}{body}2"]


def test_short_chunks_go_and_are_counted(spark):
    rows = spark.createDataFrame([(1, "short"), (2, ""), (3, None), (4, "y" * 100), (5, "z" * 2000 + ". tail.")], "id int, text string")
    found = chunking.structural_chunks(rows).orderBy("id").collect()
    assert [(r.id, r.chunk_index, len(r.chunk_text), r.dropped_chars) for r in found] == [(4, 0, 100, 0), (5, 0, 2001, 5)]
    adjacent = spark.createDataFrame([(1, "w" * 1990 + " (a) (b) " + "v" * 150)], "id int, text string")  # both markers begin a segment; the first is short
    assert [(r.chunk_text[:4], r.dropped_chars) for r in chunking.structural_chunks(adjacent).orderBy("chunk_index").collect()] == [("wwww", 3), ("(b) ", 3)]


def test_high_risk_by_first_three(spark):
    row = lambda q, rank, **k: (q, k.get("query", "hello"), rank, k.get("citation"), None, None, k.get("snippet"))
    rows = [row(1, 1), row(2, 3, snippet="a removal order"), row(3, 4, snippet="a removal order"), row(4, 1, snippet="s" * 199 + " removal"), row(5, 1, query="My NTA came"), row(6, 1, query=None, citation="fraud")]
    rows += [row(7, 2, snippet="asylum"), row(7, 1, snippet="the deadline"), row(8, 1, snippet="asylum"), row(8, 2, snippet="the deadline")]  # told in order of rank
    found = rerank.high_risk(spark.createDataFrame(rows, "qid int, query string, rank int, citation string, topic string, subtopic string, snippet string"))
    assert {r.qid: r.high_risk for r in found.collect()} == {1: False, 2: True, 3: False, 4: False, 5: True, 6: True, 7: False, 8: True}


def test_guarded_questions(spark):
    cited = {1: ["8 CFR 208.7", "Asylum guide", "8 CFR 208.13"], 2: ["8 CFR 208.7", "asylum 274a.12", "8 CFR 208.13"], 3: ["8 CFR 208.7", "208.1"], 4: ["8 CFR 208.7", "Asylum guide", "8 CFR 208.13"], 5: ["8 CFR 208.7", None, "208.2"]}
    results = spark.createDataFrame([(q, k + 1, c, "stem") for q, cs in cited.items() for k, c in enumerate(cs)], "qid int, rank int, citation string, found_in string")
    asked = spark.createDataFrame([(q, str(q), q != 4) for q in cited], "qid int, category string, guarded boolean")
    needles = spark.createDataFrame([(str(q), ["stem"]) for q in cited], "category string, needles array<string>")
    assert {r.category: r.covered for r in quality.coverage(results, asked, needles).collect()} == {"1": False, "2": True, "3": True, "4": True, "5": True}
    assert all(r.covered for r in quality.coverage(results, asked.drop("guarded"), needles).collect())


def test_dataset_checks(spark):
    schema = "chunk_id int, chunk_text string, citation string, embedding array<double>, version_name string, is_active boolean, status string"
    good, bad = [0.0, 1.0], [0.0]
    chunks = spark.createDataFrame([(1, "t", "a", good, "v", True, "active"), (2, "t", "b", good, "v", False, "active"), (3, "t", "c", None, "v", True, "active"), (4, "t", "d", bad, "v", True, "active"), (5, "t", "e", good, "w", True, "ready"), (6, "t", "a", good, "v", True, "active")], schema)
    expected = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",), ("a",), (None,)], "citation string")
    found = {r.check_id: (r.ok, r.observed) for r in quality.dataset_checks(chunks, expected, spark.range(2), 2, 1).collect()}
    assert found["expected_missing"] == (False, 1.0) and found["expected_inactive"] == (False, 1.0) and found["expected_without_vector"] == (False, 1.0) and found["expected_other_width"] == (False, 1.0)
    assert found["answers_logged"] == (False, 2.0) and found["visible_chunks"] == (True, 4.0) and len(found) == 13
    clean = quality.dataset_checks(chunks.where("chunk_id in (1, 6)"), expected.where("citation = 'a'"), spark.range(0), 2, 1).collect()
    assert all(r.ok for r in clean)
    assert {r.check_id for r in quality.dataset_checks(chunks.limit(0), expected, spark.range(0), 2, 1).where("not ok").collect()} == {"visible_chunks", "active_versions", "expected_missing"}
