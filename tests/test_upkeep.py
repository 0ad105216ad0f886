"""Streams that restart, XML of any size, vectors in batches that are cut short, cells, job logs, publication."""

import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry.operators import cells, embedding, lifecycle, vector
from textquarry.queries import ORACLE_SQL, QUERIES
from textquarry.sources import html, xml
from textquarry.sources.snapshots import Conflict
from textquarry.streaming import arrivals


def folder():
    return tempfile.mkdtemp(prefix="spark-")


# ---- streams ------------------------------------------------------------------------------------------------


def test_stream_stores_each_key_once_over_restarts(spark):
    place = folder()
    schema = "id int, text string"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{place}/in")
    run = lambda: arrivals.ingest(spark, f"{place}/in", spark.createDataFrame([], schema).schema, f"{place}/out", f"{place}/state", files_a_batch=1)
    stored = lambda: sorted((r.text or "") for r in spark.read.parquet(f"{place}/out").collect())
    put([(1, "a"), (2, "b"), (3, "a"), (4, None)])
    run()
    assert stored() == ["", "a", "b"]
    run()  # nothing new
    put([(5, "b"), (6, "c")])
    put([(7, "c"), (8, ""), (9, "d")])
    run()
    assert stored() == ["", "a", "b", "c", "d"]


def test_stream_replays_a_batch_that_was_not_committed(spark):
    import glob
    import os

    place = folder()
    schema = spark.createDataFrame([], "text string").schema
    spark.createDataFrame([("a",), ("b",), ("a",)], schema).write.parquet(f"{place}/in")
    arrivals.ingest(spark, f"{place}/in", schema, f"{place}/out", f"{place}/state")
    for f in glob.glob(f"{place}/state/commits/*0") + glob.glob(f"{place}/state/commits/.*0.crc"):  # as if it had died before the commit
        os.remove(f)
    arrivals.ingest(spark, f"{place}/in", schema, f"{place}/out", f"{place}/state")
    assert sorted(r.text for r in spark.read.parquet(f"{place}/out").collect()) == ["a", "b"]


# ---- XML ----------------------------------------------------------------------------------------------------


def test_regulations_entities_order_and_broken_elements(spark):
    place = folder()
    long = "Enough words to be kept as a section of its own, surely."
    with open(f"{place}/a.xml", "w") as f:
        f.write(f"""<?xml version="1.0"?><ECFR><DIV5 N="1" TYPE="PART"><HEAD>Part</HEAD>
<DIV8 N="§ 103.2" TYPE="SECTION"><HEAD>§ 103.2 <I>Filing</I> &amp; fees.</HEAD><P>One <I>two</I> three &lt;four&gt; &#167;&#160;5.</P>
  <!-- <P>not</P> --><P>{long}</P><CITA>[end]</CITA></DIV8><DIV8 N="9" TYPE="APPENDIX"><P>{long}</P></DIV8><DIV8 N=" " TYPE="SECTION"><P>{long}</P></DIV8>
<DIV8 N="7" TYPE="SECTION"><P>short</P></DIV8><DIV8 N="8" TYPE="SECTION"><P>{long}</Q></DIV8>
<DIV8 N="10" TYPE="SECTION"><P>{long}</P></DIV8></DIV5></ECFR>""")
    found = {r.number: r for r in xml.regulation_sections(spark, place).collect()}
    assert set(found) == {"103.2", None, "10"}
    assert found["103.2"].title == "§ 103.2 Filing & fees."
    assert found["103.2"].text == f"§ 103.2 Filing & fees.One two three <four> § 5. {long}[end]"
    assert found[None].broken and "</Q>" in found[None].text and not found["10"].broken and found["10"].title == ""


def test_large_titles_are_read_by_many_tasks(spark):
    place = folder()
    with open(f"{place}/big.xml", "w") as f:
        f.write("<X>" + "".join(f'<DIV8 N="{i}" TYPE="SECTION"><P>{"word " * 400}é</P>\n</DIV8>' for i in range(6000)) + "</X>")  # 12 MB
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        rows = xml.elements(spark, place, "DIV8")
        assert rows.rdd.getNumPartitions() >= 10
        found = xml.regulation_sections(spark, place)
        assert found.count() == 6000 and found.select("number").distinct().count() == 6000 and found.where("broken").count() == 0
        assert {r.n for r in found.select(F.length("text").alias("n")).distinct().collect()} == {2001}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_code_sections_with_prefixes(spark):
    place = folder()
    with open(f"{place}/c.xml", "w") as f:
        f.write('<d xmlns:u="http://u.example"><u:SECTION id="a"><u:NUM value="101">§ 101.</u:NUM><u:HEADING>Terms &amp; more</u:HEADING><u:SUBSECTION><u:PARA>One.</u:PARA><u:PARA>Two <u:i>three</u:i>.</u:PARA></u:SUBSECTION></u:SECTION><u:SECTION><u:PARA>No number</u:PARA></u:SECTION><u:SECTION><u:NUM>5</u:SECTION></d>')
    found = [tuple(r)[1:] for r in xml.code_sections(spark, place, "u:SECTION").collect()]
    assert found[0] == ("101", "Terms & more", "One.\n\nTwo three.", False) and found[1] == (None, "Untitled", "No number", False) and found[2][3]


def test_code_sections_of_odd_documents_are_those_of_sql(spark, tmp_path):
    import duckdb

    texts = [None, "", "  ", "\n", "\u00a0", "\x0c", "\u3000a\u3000", "a \u2003", "\ufffe", "a\uffff b & \ue000", "\u3000&", "& ]]>", "<!-- a", "&#32;", "a" * 8000 + "&\n😀"]
    rows = [(i, t, s) for s in (None, "", "web", " a  b & <c>\n", "Untitled", "none", "\uffff") for i, t in enumerate(texts, len(texts) * len(s or "-------"))]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    expected = con.execute(f"SELECT number, title, text FROM ({ORACLE_SQL['xml_code_sections']})").fetchall()
    key = lambda r: tuple(x or f"{x!r}" for x in r)
    assert sorted(map(tuple, QUERIES["xml_code_sections"](spark, str(tmp_path)).collect()), key=key) == sorted(expected, key=key)



# ---- vectors ------------------------------------------------------------------------------------------------


def test_a_killed_run_of_embedding_ends_as_an_unbroken_one(spark):
    chunks = spark.createDataFrame([(i, None if i == 7 else " " if i == 8 else f"text number {i}") for i in range(50)], "chunk_id long, chunk_text string")
    there = chunks.where("chunk_id in (3, 30)").select("chunk_id")
    rows = lambda ledger: sorted((r.chunk_id, tuple(r.embedding)) for r in ledger.vectors().collect())
    whole = embedding.Ledger(spark, f"file://{folder()}/v")
    assert whole.run(chunks, embedding.hashed, 64, 10, there) == 5
    assert len(rows(whole)) == 46

    def dies(texts):
        if any("number 24" in t for t in texts):
            raise RuntimeError("killed")
        return embedding.hashed(texts)

    cut = embedding.Ledger(spark, f"file://{folder()}/v")
    assert cut.run(chunks, embedding.hashed, 64, 10, there, most=1) == 1
    with pytest.raises(Exception, match="killed"):
        cut.run(chunks, dies, 64, 10, there)
    assert sorted(cut.done()) == ["0", "1"]  # the batch that failed is not committed
    assert cut.run(chunks, embedding.hashed, 64, 10, there) == 3 and cut.run(chunks, embedding.hashed, 64, 10, there) == 0
    assert rows(cut) == rows(whole) and cut.report().count() == 5
    with pytest.raises(Exception, match="in place of 64"):
        embedding.Ledger(spark, f"file://{folder()}/v").run(chunks, lambda t: np.zeros((len(t), 3)), 64, 10)


def test_batches_are_embedded_together_in_few_commits(spark):
    chunks = spark.createDataFrame([(i, f"text number {i}") for i in range(95)], "chunk_id long, chunk_text string")
    rows = lambda ledger: sorted((r.chunk_id, tuple(r.embedding)) for r in ledger.vectors().collect())
    one, many = (embedding.Ledger(spark, f"file://{folder()}/v") for _ in range(2))
    assert one.run(chunks, embedding.hashed, 64, 10) == 10 and many.run(chunks.where("chunk_id between 40 and 49"), embedding.hashed, 64, 10) == 1
    assert many.run(chunks, embedding.hashed, 64, 10, commits=3) == 9  # before and behind what is done
    assert len(many.snapshots.versions()) == 1 + 4 and many.run(chunks, embedding.hashed, 64, 10, commits=3) == 0
    assert rows(many) == rows(one) and len(rows(one)) == 95
    assert sorted(many.report().collect()) == sorted(one.report().collect())


def test_cells_find_most_neighbours_and_read_a_part(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(12, 16)) * 4
    rows = [(i, (middles[i % 12] + rng.normal(size=16)).tolist()) for i in range(1500)] + [(9000, None), (9001, [1.0] * 3)]
    chunks = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    centroids = cells.learned(chunks.where("size(embedding) = 16"), 24)
    table = cells.stored(chunks, centroids, f"{folder()}/cells")
    assert table.count() == 1500
    asked = chunks.where("chunk_id % 50 = 0 AND size(embedding) = 16").select(F.col("chunk_id").alias("qid"), F.col("embedding").alias("vector"))
    exact = vector.vector_topk(table, asked)
    probes = cells.calibrated(table, centroids)
    found = cells.search(table, centroids, asked, probes)
    assert cells.recall(found, exact).agg(F.avg("recall")).first()[0] >= 0.9
    assert cells.share_read(table, asked, centroids, probes) < 0.35
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan


def test_cells_over_the_table(spark, sf):
    rows = QUERIES["cell_search"](spark, sf).collect()
    assert len(rows) == 10 and sum(r.recall for r in rows) / len(rows) >= 0.9 and all(0 < r.share_read <= 1 for r in rows)


# ---- jobs and publication -----------------------------------------------------------------------------------


def test_job_log(spark):
    at = lambda h: f"2024-01-{1 + h // 24:02d} {h % 24:02d}:00:00"
    rows = [("good", "queued", 0), ("good", "running", 1), ("good", "success", 2), ("bad", "success", 0), ("again", "running", 0), ("again", "failed", 1), ("again", "running", 2), ("twice", "running", 0), ("twice", "running", 1), ("late", "queued", 60), ("odd", "asleep", 5), ("after", "running", 0), ("after", "success", 1), ("after", "running", 2)]
    log = spark.createDataFrame([(j, s, at(h), k) for k, (j, s, h) in enumerate(rows)], "job string, status string, at string, seq int").withColumn("at", F.col("at").cast("timestamp"))
    found = {r.job: (r.n_rows, r.n_illegal, r.status, r.hung) for r in lifecycle.job_states(log, F.lit(at(72)).cast("timestamp")).collect()}
    assert found == {"good": (3, 0, "success", False), "bad": (1, 1, "success", False), "again": (3, 0, "running", True), "twice": (2, 1, "running", True), "late": (1, 0, "queued", False), "odd": (1, 1, "asleep", False), "after": (3, 1, "running", True)}


def test_two_writers_publish_from_one_state(spark):
    place = f"file://{folder()}/p"
    table = lambda n: spark.range(n).toDF("id")
    assert lifecycle.current(spark, place) == {}
    assert lifecycle.publish({"a": table(1), "b": table(1)}, place) == 1
    reader = lifecycle.current(spark, place)
    assert lifecycle.publish({"a": table(2), "b": table(2)}, place, began_from=1) == 2
    with pytest.raises(Conflict):
        lifecycle.publish({"a": table(3), "b": table(3)}, place, began_from=1)
    assert [reader[n].count() for n in "ab"] == [1, 1]  # what it began to read stays as it was
    assert [lifecycle.current(spark, place)[n].count() for n in "ab"] == [2, 2]
    with pytest.raises(ValueError):
        lifecycle.publish({}, place)


def test_pages_and_elements_are_searched_once(spark, tmp_path):
    plan = lambda rows: rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan(html.decisions(spark.createDataFrame([(1, "<hr>")], "page_id long, html string"))).count("<tr\\b") <= 2  # of a page, not of each of its parts
    (tmp_path / "a.xml").write_text("<SECTION><NUM>§ 1.</NUM><PARA> a &amp; b </PARA><PARA>c</PARA></SECTION><DIV8 N='2' TYPE='SECTION'><HEAD> h </HEAD>a\tb</DIV8>")
    code, regulations = xml.code_sections(spark, f"file://{tmp_path}"), xml.regulation_sections(spark, f"file://{tmp_path}", least=4)
    assert plan(code).count("<x>") <= 5 and plan(regulations).count("<x>") <= 2  # nullif writes number and title out twice, texts are made once
    assert [(r.number, r.title, r.text, r.broken) for r in code.collect()] == [("1", "Untitled", "a & b\n\nc", False)]
    assert [(r.number, r.title, r.text, r.broken) for r in regulations.collect()] == [("2", "h", "h a b", False)]
