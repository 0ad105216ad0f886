"""More lexemes than are broadcast give the same results."""

import pytest
from pyspark.sql import functions as F

from textquarry.operators import fulltext


@pytest.mark.parametrize("search", ["keyword_topk", "phrase_topk", "cover_density"])
def test_over_100_000_lexemes(spark, search):
    posted = fulltext.postings(spark.createDataFrame([(1, "green card w7"), (2, "card green")], "chunk_id int, text string"), {"A": "text"})
    many = spark.range(60_000).select(F.col("id").alias("qid"), F.concat(F.lit("green card w"), "id").alias("query"))
    assert [(r.qid, r.chunk_id) for r in getattr(fulltext, search)(posted, many).collect()] == [(7, 1)]
