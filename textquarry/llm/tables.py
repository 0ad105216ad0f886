"""Reading the tables and keeping intermediate results where all executors see them."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BITS = 27


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset and everything runs on this machine, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="textquarry-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Of the scope that runs in this thread, the tables it has kept and not handed on.
_owned: ContextVar[list[str] | None] = ContextVar("owned", default=None)


@contextmanager
def scope(spark: SparkSession) -> Iterator[list[str]]:
    """Owns the tables kept within, by this thread alone; those still owned at its end, even one by an error, are deleted.

    Outside any scope a table belongs to whoever owns the shared folder.
    """
    paths: list[str] = []
    token = _owned.set(paths)
    try:
        yield paths
    finally:
        _owned.reset(token)
        drop(spark, paths)


def _own(path: str) -> None:
    if (paths := _owned.get()) is not None:
        paths.append(path)


def keep_at(df: DataFrame) -> tuple[DataFrame, str]:
    """df, written as Parquet to the shared folder and read back, which cuts its lineage; and where it lies."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kept-{uuid.uuid4().hex}"
    _own(path)  # before it is written, so that a failed write leaves nothing
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def keep(df: DataFrame) -> DataFrame:
    return keep_at(df)[0]


def settle_at(spark: SparkSession, make: Callable[[], DataFrame]) -> tuple[DataFrame, str]:
    """What make returns, kept, and where it lies; the tables that were kept on the way there are deleted."""
    with scope(spark) as paths:
        out, path = keep_at(make())
        paths.remove(path)
    _own(path)
    return out, path


def settle(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    return settle_at(spark, make)[0]


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that nothing will read again."""
    owned = _owned.get()
    for path in list(paths):
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        if owned is not None and path in owned:
            owned.remove(path)


ROWS_A_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def few_rows_a_batch(spark: SparkSession, rows: int = 2000) -> None:
    """Sets how many rows Python gets at a time: texts are long, and both sides hold a batch or two."""
    spark.conf.set(ROWS_A_BATCH, str(rows))


@contextmanager
def own_batches(spark: SparkSession) -> Iterator[None]:
    """Gives the session its size of batches back at the end."""
    before = spark.conf.get(ROWS_A_BATCH)
    try:
        yield
    finally:
        spark.conf.set(ROWS_A_BATCH, before)


def row_key(documents: DataFrame) -> list[Column]:
    """128 bits, in two columns, that stand for a row of documents(doc_id, text)."""
    return [F.xxhash64("doc_id", "text"), F.xxhash64(F.lit(7), "text", "doc_id")]


class Marks:
    """A bitmap of at most 2**MOST_BITS bits that holds keys, for finding rows that are surely of none."""

    def __init__(self, keys: DataFrame, key: str):
        bits = self.bits = min(MOST_BITS, max(10, (16 * keys.count()).bit_length()))
        words = keys.select(F.shiftrightunsigned(key, 64 - bits).alias("spot")).groupBy(F.expr("spot >> 6").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(spot & 63 as int)))").alias("bits")).toArrow()
        self.marks = np.zeros(1 << (bits - 6), np.uint64)
        self.marks[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)

    def has(self, keys: pa.Array) -> np.ndarray:
        place = keys.to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - self.bits)
        return (self.marks[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def sieve(documents: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame, tuple[str, str]]:
    """documents in two parts: rows that are surely not of keys(k1, k2), and the others with their keys, whose names come last.

    A bitmap tells them apart, so that texts that needn't be looked up aren't shuffled; a full one leaves every row to the second part.
    """
    marks = Marks(keys, "k1")
    k1, k2 = fresh(documents.columns, "k1", "k2")
    keyed = documents.select("*", *(c.alias(n) for c, n in zip(row_key(documents), (k1, k2), strict=True)))
    at = keyed.columns.index(k1)

    def part(hit: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(marks.has(batch.column(at)) == hit))

        return keyed.mapInArrow(run, keyed.schema)

    return part(False).drop(k1, k2), part(True), (k1, k2)


def without(documents: DataFrame, keys: DataFrame) -> DataFrame:
    """documents without the rows of keys(k1, k2)."""
    clear, others, (k1, k2) = sieve(documents, keys)
    gone = keys.select(F.col("k1").alias(k1), F.col("k2").alias(k2))
    return clear.unionByName(others.join(gone, [k1, k2], "left_anti").drop(k1, k2))


def fresh(taken: list[str], *names: str) -> list[str]:
    """names, with underlines ahead of those that are taken."""
    low = {t.lower() for t in taken}
    out = []
    for name in names:
        while name.lower() in low:
            name = f"_{name}"
        out.append(name)
        low.add(name.lower())
    return out


def shares(total_bytes: int, each: int, least: int = 1) -> int:
    return max(least, math.ceil((total_bytes or 0) / each))
