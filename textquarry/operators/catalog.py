"""Searching and counting small catalogues, and looking at a session's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def faceted(rows: DataFrame, fields: list[str], text: Column | str = "", facet: str | None = None, value: Column | str | None = None) -> DataFrame:
    """Rows whose facet has the value (null: any) and one of whose fields holds the text, whatever its case."""
    wanted = F.lower(F.trim(F.lit(text) if isinstance(text, str) else text))
    hay = F.lower(F.concat_ws(" ", *fields))
    rows = rows.where((wanted == "") | F.contains(hay, wanted))
    return rows.where(F.col(facet) == value) if facet and value is not None else rows


def grouped(rows: DataFrame, facet: str, order: list[str]) -> DataFrame:
    """(facet, place, n) of the groups that have rows, in a fixed order."""
    places = rows.sparkSession.createDataFrame([(v, i + 1) for i, v in enumerate(order)], f"{facet} string, place int")
    return rows.groupBy(facet).agg(F.count("*").alias("n")).join(F.broadcast(places), facet).select(facet, "place", "n")


def stats(rows: DataFrame, status: str, indexed: str, family: str) -> DataFrame:
    """One row: entries, those with the status, different families (T4)."""
    return rows.agg(F.count("*").alias("n_entries"), F.count_if(F.coalesce(F.col(status) == indexed, F.lit(False))).alias("n_indexed"), F.count_distinct(family).alias("n_families"))


def numbered(steps: Column | str) -> Column:
    """Steps as lines `1. ...`."""
    return F.array_join(F.transform(steps, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)), "\n")


def in_range(rows: DataFrame, number: Column, ranges: list[tuple[int, int, str]], other: str) -> DataFrame:
    """rows with `range_name` of the first interval that holds the number, else other."""
    out = F.lit(other)
    for low, high, name in reversed(ranges):
        out = F.when(number.between(low, high), name).otherwise(out)
    return rows.withColumn("range_name", out)


def tables(spark: SparkSession) -> DataFrame:
    """(table, column, type) of the session's tables and views."""
    rows = [(t.name, c.name, c.dataType) for t in spark.catalog.listTables() for c in spark.catalog.listColumns(t.name)]
    return spark.createDataFrame(rows, "`table` string, `column` string, type string")


def absent_tables(spark: SparkSession, required: list[str]) -> list[str]:
    return sorted(set(required) - {t.name for t in spark.catalog.listTables()})
