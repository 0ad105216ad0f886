"""Approximate vector search by cells (V7): coarse centroids, a table partitioned by cell, probes of the nearest cells.

Centroids are learned by k-means from a bounded sample (LEARN_FROM vectors of the least hashes of their ids); every vector is stored in the partition of its nearest one.
A search reads the partitions of the `probes` cells nearest to each question and compares exactly there. How many probes are
needed depends on the data: calibrated() takes the fewest that find the wanted share of the true neighbours of some sampled vectors. Flat
spaces need most of the cells, and the report says what share was read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .search import settled
from .vector import nearest_by, top, vector_topk

LEARN_FROM = 20_000
SAMPLED = 200


def learned(chunks: DataFrame, cells: int, rounds: int = 8, most: int = LEARN_FROM) -> np.ndarray:
    """Centroids of `most` vectors of chunks(chunk_id, embedding), by k-means from the first of them."""
    some = chunks.where("embedding is not null").select(F.xxhash64("chunk_id").alias("h"), "chunk_id", "embedding").orderBy("h", "chunk_id").limit(most).collect()
    x = np.array([r.embedding for r in some], np.float64)
    if not len(x):
        return x.reshape(0, 0)
    centroids = np.unique(x, axis=0)[np.random.default_rng(7).permutation(len(np.unique(x, axis=0)))[:cells]]
    for _ in range(rounds):
        own = _nearest(x, centroids, 1)[:, 0]
        for c in np.unique(own):
            centroids[c] = x[own == c].mean(0)
    return centroids


def _nearest(x: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the n nearest centroids of each row, nearest first, ties to the smaller."""
    d = (centroids**2).sum(1)[None] - 2 * x @ centroids.T
    return np.argsort(d, axis=1, kind="stable")[:, :n]


def stored(chunks: DataFrame, centroids: np.ndarray, path: str) -> DataFrame:
    """chunks(chunk_id, embedding) at path, partitioned by cell; vectors that are null or of another width are left out."""
    width = centroids.shape[1]

    @F.pandas_udf("int")
    def cell(v: pd.Series) -> pd.Series:
        return pd.Series(_nearest(np.stack(v.to_numpy()).astype(np.float64), centroids, 1)[:, 0]) if len(v) else pd.Series([], dtype="int32")

    rows = chunks.where((F.size("embedding") == width) & F.expr("NOT exists(embedding, x -> x IS NULL)")).withColumn("cell", cell("embedding"))
    # a large cell is split over tasks: its rows go to several files
    rows.hint("rebalance", "cell").write.partitionBy("cell").parquet(path)
    return chunks.sparkSession.read.parquet(path)


def _probed(queries: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """(qid, vector, cell) of the cells that each question reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), np.float64).reshape(batch.num_rows, centroids.shape[1])
            cells = _nearest(x, centroids, probes)
            row = np.repeat(np.arange(len(x)), cells.shape[1])
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in batch.columns), pa.array(cells.ravel().astype(np.int32))], names=["qid", "vector", "cell"])

    some = queries.where(F.size("vector") == centroids.shape[1]).select("qid", "vector")
    return some.mapInArrow(run, f"qid {some.schema['qid'].dataType.simpleString()}, vector {some.schema['vector'].dataType.simpleString()}, cell int")


def search(cells: DataFrame, centroids: np.ndarray, queries: DataFrame, probes: int, k: int = 15, metric: str = "l2") -> DataFrame:
    """(qid, chunk_id, distance, rank) among the probed cells of a stored table; only their partitions are read."""
    asked = settled(_probed(queries, centroids, probes), 100_000)
    wanted = [r.cell for r in asked.select("cell").distinct().collect()]  # as many as there are centroids, at most
    found = nearest_by(cells.where(F.col("cell").isin(wanted)).select("cell", "chunk_id", "embedding"), asked, k, metric, ("cell",))
    return top(found.withColumn("distance", F.round("distance", 6)), [F.col("distance"), F.col("chunk_id")], k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(qid, recall): the share of exact neighbours found."""
    hit = exact.select("qid", "chunk_id").join(found.select("qid", "chunk_id", F.lit(1).alias("hit")), ["qid", "chunk_id"], "left")
    return hit.groupBy("qid").agg((F.count("hit") / F.count("*")).alias("recall"))


def calibrated(cells: DataFrame, centroids: np.ndarray, wanted: float = 0.97, k: int = 15, sampled: int = SAMPLED) -> int:
    """The fewest probes that find `wanted` of the true neighbours of some stored vectors, by halving."""
    some = cells.select(F.xxhash64(F.lit(3), "chunk_id").alias("h"), "chunk_id", "embedding").orderBy("h", "chunk_id").limit(sampled)
    asked = settled(some.select(F.col("chunk_id").alias("qid"), F.col("embedding").alias("vector")), sampled)
    exact = settled(vector_topk(cells, asked, k).select("qid", "chunk_id"), sampled * k)
    # in which cell each true neighbour lies, and how many cells are nearer to the question
    places = settled(cells.select("chunk_id", "cell").join(exact, "chunk_id"), sampled * k).collect()
    order = {r.qid: np.argsort(_nearest(np.array([r.vector], np.float64), centroids, len(centroids))[0]) for r in asked.collect()}
    depth = np.sort([int(order[r.qid][r.cell]) + 1 for r in places])
    return int(depth[max(0, int(np.ceil(wanted * len(depth))) - 1)]) if len(depth) else 1


def share_read(cells: DataFrame, asked: DataFrame, centroids: np.ndarray, probes: int) -> float:
    """The mean share of the stored vectors that a question is compared with."""
    sizes = cells.groupBy("cell").agg(F.count("*").alias("n"))
    seen = _probed(asked, centroids, probes).groupBy("cell").agg(F.count("*").alias("times"))
    row = sizes.join(seen, "cell", "left").agg(F.sum(F.col("n") * F.coalesce("times", F.lit(0))).alias("pairs"), F.sum("n").alias("n")).first()
    return float(row.pairs or 0) / max(1, (row.n or 0) * asked.count())
