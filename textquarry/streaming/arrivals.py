"""Arriving rows as a stream: what has come before is known from keyed state, so nothing stored is read again.

The state store keeps the keys seen so far, partitioned by key over the executors and checkpointed with the stream's progress; the file
sink commits each batch once. A restart therefore repeats nothing, and a replayed batch gives the same files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ingest(spark: SparkSession, source: str, schema: T.StructType, sink: str, checkpoint: str, keys: tuple[str, ...] = ("content_hash",), files_a_batch: int | None = None) -> None:
    """Reads all Parquet files that have come to `source` since the last call, and appends the rows with new keys to `sink`.

    Without a column content_hash, one is made of `text`. Of rows with equal keys in one batch any one stays: keys are to settle what matters of a row. A null key is
    a key like any other. The first call fixes how many partitions the state has, by spark.sql.shuffle.partitions.
    """
    reader = spark.readStream.schema(schema)
    stream = (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).parquet(source)
    if "content_hash" in keys and "content_hash" not in stream.columns:
        stream = stream.withColumn("content_hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    fresh = stream.dropDuplicates(list(keys))
    fresh.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stored_rows(spark: SparkSession, sink: str, schema: T.StructType) -> DataFrame:
    """The sink's rows as committed, none before the first batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sink)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(schema).parquet(sink) if there else spark.createDataFrame([], schema)


def counts_by_window(events: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """(start, event_type, n) of events(ts, event_type), of a stream or a table; events later than `late` are dropped from a stream."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
