"""Operator 5's models keep every n-gram, however many there are."""

import random

import pytest
from pyspark.sql import functions as F

from textquarry.llm import urls


def test_scores_are_those_of_all_grams(spark):
    rng = random.Random(3)
    path = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(40))
    rows = [(i, f"http://{'a.org/fr' if i % 2 else 'b.net'}/{path()}") for i in range(8000)] + [(-1, None), (-2, "http://c.com/abc")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    learned = urls.ruled(pages).where("rule is not null and pmod(xxhash64(url), 5L) <> 0").select("url", F.col("rule_verdict").alias("verdict"))
    counts = {v: {r.gram: r.n for r in urls._gram_counts(learned).where(F.col("verdict") == v).collect()} for v in ("allow", "block")}
    assert min(map(len, counts.values())) > 200_000
    plain = urls.Ratio(urls.Model(counts["allow"]), urls.Model(counts["block"]))
    found = {r.page_id: r.score for r in urls.judge(pages).collect()}
    assert len(found) == len(rows)
    for i, url in rows[-300:]:
        assert found[i] == pytest.approx(plain.score(url), abs=1e-9)
