"""An index's words are found over bytes: the same as the pattern finds, without shuffling or joining a word."""

import pyarrow as pa
from pyspark.sql import functions as F

from textquarry.functions import lexing
from textquarry.functions.text import tags
from textquarry.operators import fulltext, search
from textquarry.plans import corpus

TEXTS = ["", None, "Ümlaut_x ÉTAPE 12½ Ⅷ x", "end", "begin", "日本語 𝒳y 𐐀z 😀a", "ΣΑΣ İstanbul ǅ", " - ", "áb ª٣ _", "ends in é", "é begins", "x" * 5000]


def test_words_over_bytes_are_the_patterns(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string").select("i", F.lower("text").alias("low"), search.words("text").alias("words")).orderBy("i").collect()
    letters = lexing.letters(spark)
    found, sizes = lexing.find(pa.array([r.low for r in rows]).slice(0), letters)
    assert found.to_pylist() == [w for r in rows for w in r.words] and sizes.tolist() == [len(r.words) for r in rows]
    part, counts = lexing.find(pa.array([r.low for r in rows]).slice(3, 4), letters)
    assert part.to_pylist() == [w for r in rows[3:7] for w in r.words] and counts.tolist() == [len(r.words) for r in rows[3:7]]
    assert lexing.find(pa.array([], pa.string()), letters)[1].tolist() == []


def test_postings_are_made_where_chunks_are_read(spark, monkeypatch):
    chunks = spark.createDataFrame([(i, t, "The visas") for i, t in enumerate(TEXTS)], "chunk_id long, text string, title string")
    found, classes = search._fields(chunks.repartition(3), {"A": ["text"], "C": ["title"]})
    letters = lexing.letters(spark)
    whole = {(r.stem, r.chunk_id): r.hits for r in search._packed(found, classes, letters).collect()}
    assert whole["visa", 2] == [(6 + 1 + 2) * 4 + 2] and whole["end", 9] == [4] and len(whole["x", 2]) == 2
    monkeypatch.setattr(search, "PIECE", 1)
    assert {(r.stem, r.chunk_id): r.hits for r in search._packed(found, classes, letters).collect()} == whole
    plan = search._packed(search._fields(chunks, {"A": ["text"]})[0], [0], letters)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Aggregate" not in plan


def test_rows_of_one_chunk_id_are_one_chunk(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "visa"), (1, "card visas"), (2, "visa")], "chunk_id long, text string")
    lists = search.Index(spark, f"file://{tmp_path}/index", buckets=2, fields={"A": ["text"]}).build(chunks).lists()
    assert {(r.stem, r.df) for r in lists.terms.collect()} == {("visa", 2), ("card", 1)}
    assert {(r.stem, r.chunk_id, tuple(r.hits)) for r in lists.postings.collect()} == {("visa", 1, (4, 8)), ("card", 1, (4,)), ("visa", 2, (4,))}


def test_tags_are_searched_in_one_pass_over_batches(spark):
    words = {"visa": ["visa", "e-visa", "visas"], "form": ["form i-1", "i-1"], "none": ["zz"], "empty": []}
    rows = spark.createDataFrame([(1, "An E-VISA, FORM I-1"), (2, "i-"), (3, None), (4, ""), (5, "é zZ")], "i int, text string")
    found = rows.select("i", tags(F.col("text"), words).alias("a"), tags(F.col("text"), {"x": ["i-"]}).alias("b"))
    assert {r.i: (r.a, r.b) for r in found.collect()} == {1: (["visa", "form"], ["x"]), 2: ([], ["x"]), 3: ([], []), 4: ([], []), 5: (["none"], [])}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "exists(" not in plan


def test_stemmed_postings_and_a_corpus_shuffle_no_word(spark):
    texts = spark.createDataFrame([(1, "The visas, visa"), (2, None)], "chunk_id long, text string")
    posted = fulltext.postings(texts, {"A": "text"}, stem=True)
    assert sorted(tuple(r) for r in posted.collect()) == [(1, "visa", 2, "A"), (1, "visa", 3, "A")]
    _, built = corpus.build(spark.createDataFrame([("1", "Visas must be filed. " * 20)], "section string, text string"), 1)
    for rows in (posted, built):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
    assert "rlike" not in plan.lower() and "(?=" not in plan  # chunks are cut once, and read
    assert built.where("lexeme = 'visa'").count() == 20
