"""Edges that the tables don't have."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry.functions import chunking
from textquarry.operators import fulltext, fusion, vector
from textquarry.sources import html


def test_stems():
    # fixed values: words and stems of the published algorithm's vocabulary
    for word, stem in {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "falling": "fall", "happy": "happi", "relational": "relat", "goodness": "good", "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "controll": "control"}.items():
        assert fulltext.stem(word) == stem, word


@pytest.mark.parametrize("preset", sorted(chunking.PRESETS))
def test_windows_end(preset):
    for text in ["", " ", "x", "x" * 5000, "Some words. " * 600, ("line\n\n" * 900)]:
        chunks = chunking.windows(text, preset)
        assert all(chunks)
        if text.strip() and not chunking.PRESETS[preset][5]:
            assert chunks[-1].endswith(text.strip()[-1])


def test_cut_references_stay():
    page = "<title>a &amp;&amp</title><article>x &lt;y&gt; &nbsp;z &copy &notit; &#65; &#66 R&D; &amp;lt; &</article>"
    assert html.page_text(page) == ("a &&amp", "x <y> \xa0z &copy &notit; A &#66 R&D; &lt; &")


def test_windows_are_handed_on_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(chunking, "PIECE", 10_000)
    texts = [None, "", *("Some words here. " * n for n in (10, 3000, 40, 700))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1)
    want = [(i, k, c) for i, t in enumerate(texts) for k, c in enumerate(chunking.windows(t or "", "decisions"))]
    found = chunking.sliding_chunks(docs, "decisions", keep=("doc_id",))
    assert sorted(map(tuple, found.collect())) == want and found.columns == ["doc_id", "chunk_index", "chunk_text"]
    whole = chunking.sliding_chunks(docs, "decisions")
    assert sorted((r.doc_id, r.chunk_index, r.chunk_text) for r in whole.collect()) == want and whole.columns == ["doc_id", "text", "chunk_index", "chunk_text"]


def test_top_k_ties_nulls_and_limits(spark):
    chunks = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (4, [0.0, 0.0])], "chunk_id long, embedding array<double>")
    asked = spark.createDataFrame([(7, [1.0, 0.0])], "qid int, vector array<double>")
    assert [r.chunk_id for r in vector.vector_topk(chunks, asked, 2).orderBy("rank").collect()] == [1, 3]
    assert {r.chunk_id for r in vector.vector_topk(chunks, asked, 9, "cosine").collect()} == {1, 3}  # a zero vector has no cosine
    with pytest.raises(ValueError):
        vector.few(asked.unionByName(asked), 1)


@pytest.mark.parametrize("metric", ["l2", "cosine", "inner_product"])
def test_top_k_by_blocks_is_that_of_all_pairs(spark, metric, monkeypatch):
    monkeypatch.setattr(vector, "BLOCK", 40)
    monkeypatch.setattr(vector, "ASKED", 7)
    monkeypatch.setattr(vector, "CELLS", 100)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6).round(i % 3)]) for i in range(150)] + [(200 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(60)]
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [0.0] * 6), (303, [float("nan")] * 6), (304, [float("inf"), 1.0, 1.0, 1.0, 1.0, 1.0]), (305, [1.0, 2.0]), (306, [3.0, 1.0]), (307, []), (308, [1e200] * 6), (309, [1e-170] * 6), (310, [0.0000005, 0.0, 0.0, 0.0, 0.0, 0.0])]
    chunks = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    asked = chunks.where("chunk_id % 5 = 0 OR chunk_id > 300").select(F.col("chunk_id").alias("qid"), F.col("embedding").alias("vector"))
    pairs = chunks.crossJoin(asked).select("qid", "chunk_id", F.round(vector.distance("embedding", "vector", metric), 6).alias("distance")).where("distance is not null")
    plain = lambda df: sorted((r.qid, r.rank, r.chunk_id, repr(r.distance + 0.0)) for r in df.collect())
    assert plain(vector.vector_topk(chunks, asked, 9, metric)) == plain(vector.top(pairs, [F.col("distance"), F.col("chunk_id")], 9))
    # pairs are never rows of the plan
    assert not any(x in vector.vector_topk(chunks, asked, 9, metric)._jdf.queryExecution().toString() for x in ("NestedLoopJoin", "CartesianProduct"))


def test_lsh_recall_is_that_of_a_join_of_buckets(spark):
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(6)
    chunks = spark.createDataFrame([(i, (rng.normal(size=8) * 2).tolist()) for i in range(400)], "chunk_id long, embedding array<double>")
    asked = chunks.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("qid"), F.col("embedding").alias("vector"))
    exact = vector.vector_topk(chunks, asked)
    found = {r.qid: r.recall for r in vector.lsh_recall(chunks, asked, exact).collect()}
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=1.0, numHashTables=6, seed=7)
    items, of = chunks.select("chunk_id", array_to_vector("embedding").alias("v")), asked.select("qid", array_to_vector("vector").alias("v"))
    joined = model.fit(items).approxSimilarityJoin(items, of, 10.0, "d").select("datasetB.qid", "datasetA.chunk_id", "d")
    near = {(r.qid, r.chunk_id) for r in vector.top(joined, [F.col("d"), F.col("chunk_id")], 15).collect()}
    for qid, rows in itertools.groupby(sorted((r.qid, r.chunk_id) for r in exact.collect()), lambda r: r[0]):
        rows = list(rows)
        assert found[qid] == sum(r in near for r in rows) / len(rows)
    assert 0 < sum(found.values()) < len(found)
    assert "NestedLoopJoin" not in vector.lsh_recall(chunks, asked, exact)._jdf.queryExecution().toString()


def test_fusion_of_partly_equal_lists(spark):
    lists = [spark.createDataFrame(rows, "qid int, chunk_id int, rank int") for rows in ([(1, 10, 1), (1, 11, 2)], [(1, 11, 1), (1, 12, 2)])]
    found = {r.chunk_id: r for r in fusion.rrf_fuse(*lists).collect()}
    assert found[10].keyword_rank is None and found[12].vector_rank is None
    assert found[11].hybrid_score == pytest.approx(1 / 62 + 0.72 / 61, abs=1e-6)
    empty = lists[0].limit(0)
    assert fusion.rrf_fuse(empty, empty).count() == 0


def test_phrases_and_postings(spark):
    texts = spark.createDataFrame([(1, "the green card interview"), (2, "card green"), (3, None), (4, "")], "chunk_id int, text string")
    posted = fulltext.postings(texts, {"A": "text", "B": F.lit("green")}, stem=True)
    asked = spark.createDataFrame([("q", "green card")], "qid string, query string")
    assert [r.chunk_id for r in fulltext.phrase_topk(posted, asked).collect()] == [1]
    assert {r.chunk_id for r in fulltext.keyword_topk(posted, asked).collect()} == {1, 2}
