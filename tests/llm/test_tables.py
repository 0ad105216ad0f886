"""Kept tables belong to the scope and thread that keeps them."""

import os
from threading import Barrier, Thread

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from textquarry.llm import graph, tables


def there(spark) -> set[str]:
    return {x for x in os.listdir(tables.shared_dir(spark)) if x.startswith("kept-")}


def test_settle_leaves_its_result_alone(spark):
    before = there(spark)
    out, path = tables.settle_at(spark, lambda: tables.keep(tables.keep(spark.range(5)).where("id > 1")))
    assert there(spark) - before == {os.path.basename(path)}
    assert out.count() == 3
    tables.drop(spark, [path])
    assert there(spark) == before


def test_scopes_nest_and_clear_after_errors(spark):
    before = there(spark)
    with tables.scope(spark) as outer:
        inner = tables.settle(spark, lambda: tables.keep(spark.range(4)))
        assert len(outer) == 1 and inner.count() == 4
        with pytest.raises(ZeroDivisionError), tables.scope(spark):
            tables.keep(spark.range(9))
            raise ZeroDivisionError
        assert len(outer) == 1 and inner.count() == 4
    with pytest.raises(Exception), tables.scope(spark):  # noqa: B017
        tables.keep(spark.range(3).select(F.expr("assert_true(id < 1)")))
    assert there(spark) == before


def test_threads_keep_apart(spark):
    """One thread settles while another's table is still to be read; components run in both."""
    both, found = Barrier(2, timeout=120), {}

    def one():
        def make():
            kept = tables.keep(spark.range(7))
            both.wait()
            both.wait()
            return kept

        found["one"] = tables.settle(spark, make).count()

    def other():
        both.wait()
        kept = tables.keep(spark.range(11))
        links = spark.createDataFrame([(k, k + 1) for k in range(20)], "a long, b long")
        found["roots"] = graph.components(links).select("root").distinct().collect()
        both.wait()
        found["other"] = kept

    threads = [Thread(target=f) for f in (one, other)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert found["one"] == 7
    assert found["other"].count() == 11
    assert [r.root for r in found["roots"]] == [0]


def test_run_gives_the_session_back(spark, sf):
    spark.conf.set(tables.ROWS_A_BATCH, "7777")
    try:
        corpus_pipeline.run(spark, sf)
        assert spark.conf.get(tables.ROWS_A_BATCH) == "7777"
    finally:
        spark.conf.unset(tables.ROWS_A_BATCH)
