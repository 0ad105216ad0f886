"""Structured sources: manifests, inventories; and what is only an interface here (PDF, HTTP). Sections of XML are in xml."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

def manifest(spark: SparkSession, path: str, schema: str | T.StructType, kind: str = "json", glob: str | None = None) -> DataFrame:
    """Rows of JSON lines or CSV under a path, with their file's name; files that don't fit the glob aren't opened."""
    reader = spark.read.schema(schema).option("recursiveFileLookup", True)
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    rows = reader.option("header", True).csv(path) if kind == "csv" else reader.json(path)
    return rows.select("*", F.col("_metadata.file_path").alias("file_path"))


def write_manifest(rows: DataFrame, path: str, kind: str = "json") -> None:
    """Writes rows; in CSV, lists are joined by ` ||| `."""
    if kind == "csv":
        rows = rows.select(*(F.array_join(c.name, " ||| ").alias(c.name) if isinstance(c.dataType, T.ArrayType) else F.col(c.name) for c in rows.schema))
        rows.write.mode("overwrite").option("header", True).csv(path)
    else:
        rows.write.mode("overwrite").json(path)


def inventory(categories: DataFrame) -> DataFrame:
    """(url, category) of categories(category, official_urls array<struct<url, ingest>>): those to ingest, a url's first category."""
    rows = categories.select("category", F.posexplode("official_urls").alias("place", "u")).where("u.ingest").select("category", "place", "u.url")
    first = F.row_number().over(Window.partitionBy("url").orderBy("category", "place"))
    return rows.withColumn("_n", first).where("_n = 1").select("url", "category")


def volume_topic(volume: Column, topics: dict[int, tuple[str, str]]) -> Column:
    """(topic, subtopic) of a volume's number."""
    table = F.create_map(*(x for k, (t, s) in topics.items() for x in (F.lit(k), F.struct(F.lit(t).alias("topic"), F.lit(s).alias("subtopic")))))
    return table[volume]


def pdf_text(files: DataFrame, read: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """(path, text): a PDF's pages joined by blank lines (S10). `read` gives a file's pages; none is installed here."""
    if read is None:
        raise NotImplementedError("give a function that reads the pages of a PDF")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["\n\n".join(read(c)) for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["path", "text"])

    return files.select("path", "content").mapInArrow(run, "path string, text string")
