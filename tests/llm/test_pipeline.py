"""Each stage against plain versions on what the one before has kept, over a whole small table."""

import corpus_pipeline
from pyspark.sql import functions as F
from samples import documents
from test_documents import PLAIN, lower, plain_hits, plain_repeats, sha
from test_near_dedup import plain_kept

from textquarry.llm.tables import keep


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_dedup", "substrings", "decontaminate", "mix"]

    one = keep(stages["language_id"](spark, docs, sf))
    assert sorted(r.doc_id for r in one.collect()) == sorted(r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or ""))

    two = keep(stages["near_dedup"](spark, one, sf))
    rows = [(r.doc_id, r.text) for r in one.collect()]
    assert sorted(r.doc_id for r in two.collect()) == plain_kept(rows)

    three = keep(stages["substrings"](spark, two, sf))
    rows = [(r.doc_id, r.text) for r in two.collect()]
    found = {r.doc_id: r for r in three.collect()}
    before = dict(rows)
    assert len(found) == len(rows)
    for i, _, removed, kept in plain_repeats(rows):
        assert found[i].text == before[i] if not removed else sha(found[i].text) == kept
        assert found[i].n_chars == len(found[i].text) or not removed

    four = keep(stages["decontaminate"](spark, three, sf))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if PLAIN.findall(lower(r.text))]
    assert sorted(r.doc_id for r in four.collect()) == sorted(h[0] for h in plain_hits([(r.doc_id, r.text) for r in found.values()], items) if not h[5])

    for df in (one, two, three, four):
        assert df.columns == columns
    five = stages["mix"](spark, four, sf)
    assert five.count() == four.count()
    assert five.columns[: len(columns)] == columns
    order = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert order(corpus_pipeline.run(spark, sf)) == order(five)


def test_empty(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


NAMES = ("block", "kept", "n_words", "n_removed", "rest", "_row_key", "_lang_pred", "_score", "k1", "k2", "node", "size", "copies", "row")


def test_clashing_names_and_awkward_rows(spark, sf):
    docs = documents(spark).drop("block", "k", "score", "code").withColumns({n: F.lit(n) for n in NAMES})
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    for name, stage in stages.items():
        docs = keep(stage(spark, docs, sf))
        assert docs.columns[: len(columns)] == columns, name
        for n in NAMES:
            assert {r[0] for r in docs.select(n).distinct().collect()} <= {n}
    assert docs.count() > 0 and docs.where("copies <> 'copies'").count() == 0
    assert docs.where("_copies is null or taken > 3 * _size").count() == 0
