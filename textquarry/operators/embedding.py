"""Vectors for chunks that have none, in batches that are committed one by one (V8).

A ledger (see sources.snapshots) names the batches that are done and where their vectors lie. A run takes the batches that aren't named, in
order, and commits each as it is written: one that was killed leaves files that nothing names, and the next run does that batch again,
to the same vectors. A batch is a range of ids, so no task sorts all of them, and its work is spread over the cluster.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.snapshots import Snapshots
from .lifecycle import embed_plan

Embedder = Callable[[list[str]], np.ndarray]


def hashed(texts: list[str], width: int = 64) -> np.ndarray:
    """A deterministic stand-in for a model: signed counts of the words' hashes, of length one."""
    out = np.zeros((len(texts), width), np.float32)
    for row, text in enumerate(texts):
        for word in text.lower().split():
            h = zlib.crc32(word.encode())
            out[row, h % width] += 1 if h & 1 << 31 else -1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


class WrongWidth(ValueError):
    """A model has given vectors of another width: its batch isn't committed."""


def embedded(chunks: DataFrame, embed: Embedder, width: int) -> DataFrame:
    """(chunk_id, embedding) of chunks(chunk_id, chunk_text); chunks without text have no vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                vectors = np.asarray(embed(part.column(1).to_pylist()), np.float32)
                if vectors.shape != (part.num_rows, width):
                    raise WrongWidth(f"{vectors.shape[1:]} in place of {width}")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.FixedSizeListArray.from_arrays(pa.array(vectors.ravel()), width).cast(pa.list_(pa.float32()))], names=["chunk_id", "embedding"])

    some = chunks.where("trim(chunk_text) <> ''").select(F.col("chunk_id").cast("bigint").alias("chunk_id"), "chunk_text")
    return some.mapInArrow(run, "chunk_id bigint, embedding array<float>")


class Ledger:
    def __init__(self, spark, folder: str):
        self.spark, self.snapshots = spark, Snapshots(spark, folder)

    def done(self) -> dict[str, dict]:
        return self.snapshots.current()[1].get("batches", {})

    def vectors(self) -> DataFrame:
        """All that is committed."""
        schema, paths = "chunk_id bigint, embedding array<float>", sorted({b["path"] for b in self.done().values()})
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def report(self) -> DataFrame:
        """(batch_no, first_id, last_id, n) of the batches done; n counts chunks, those without text too."""
        return self.spark.createDataFrame([(int(k), b["first_id"], b["last_id"], b["n"]) for k, b in self.done().items()], "batch_no bigint, first_id bigint, last_id bigint, n bigint")

    def run(self, chunks: DataFrame, embed: Embedder, width: int, batch: int, stored: DataFrame | None = None, most: int | None = None, commits: int | None = None) -> int:
        """Does the batches of `batch` ids that are left of chunks without a vector in stored, `most` of them at most; how many were done.

        The plan has a row a batch, which the driver holds: batches are to be large. Each commit reads chunks once: with `commits`, neighbouring
        batches are done together, so that their number doesn't follow that of the batches; a killed run loses the ones it was at.
        Two runs at once do no harm: the one that commits second finds a conflict and stops.
        """
        none = self.spark.createDataFrame([], "chunk_id bigint")
        plan = embed_plan(chunks.select("chunk_id"), none if stored is None else stored.select("chunk_id"), batch).where("batch_no IS NOT NULL")
        done, left, gap = self.done(), [], True
        for row in sorted(plan.collect()):
            if str(row.batch_no) in done:
                gap = True
                continue
            left.append((row, gap))
            gap = False
        left = left[:most]
        each = -(-len(left) // commits) if commits else 1
        parts: list[list] = []
        for row, gap in left:
            if not parts or gap or len(parts[-1]) >= each:
                parts.append([])
            parts[-1].append(row)
        for rows in parts:
            some = chunks.where((F.col("chunk_id") >= rows[0].first_id) & (F.col("chunk_id") <= rows[-1].last_id))
            if stored is not None:
                some = some.join(stored.select("chunk_id"), "chunk_id", "left_anti")
            began, state = self.snapshots.current()
            path = self.snapshots.place("vectors")
            embedded(some, embed, width).write.parquet(path)
            new = {str(r.batch_no): {"path": path, "first_id": r.first_id, "last_id": r.last_id, "n": r.n} for r in rows}
            self.snapshots.commit(began, {"batches": state.get("batches", {}) | new})
        return len(left)
