"""Operator 11, centroid clustering: Lloyd's rounds in whole numbers, nearest centroids by annulus search.

The centroids stand sorted by norm. A vector's exact distance to those of the nearest norms, one on each side, bounds
that to its nearest: by the triangle inequality only centroids whose norm lies within that bound of the vector's own
can be as near. Two binary searches cut out that annulus; what lies in it, its edges included, is compared exactly,
and ties fall to the smaller number. Norms are doubles, so the edges are set a little wider than they are.

Each round is one pass over the vectors where they lie: a task adds up its vectors by cluster, and only those sums, a row
for each cluster and component, are shuffled. The driver holds the centroids: k * width numbers, whatever the data's size.

Defined results: vectors that are null, of another width, or that hold a component that is null, not finite, or whose whole number
reaches LARGEST (a squared distance would no longer fit a long) are left out; rows that repeat a vec_id are
vectors of their own; the first centroids are those of the least sha256 of `1:<vec_id>`, ties by components; a null
vec_id comes last; fewer vectors than k give fewer centroids, an empty table an empty result; further columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 64
CENTROIDS = 16
ROUNDS = 3
SCALE = 64
LARGEST = 1 << 27
STRETCH = 1 << 13  # vectors compared at a time


def whole_vectors(column: pa.Array, width: int = WIDTH, scale: float = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """(rows, numbers): which rows are kept, and floor(scale * x) of their components."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), width), False).to_numpy(zero_copy_only=False))
    values = column.take(pa.array(rows)).flatten().cast(pa.float64())
    x = np.where(pc.is_null(values).to_numpy(zero_copy_only=False), np.nan, values.to_numpy(zero_copy_only=False)).reshape(len(rows), width)
    with np.errstate(invalid="ignore", over="ignore"):
        x = np.floor(x * scale)
        good = (np.abs(x) < LARGEST).all(1)  # not where a component is not a number
    return rows[good], x[good].astype(np.int64)


class Annulus:
    """Nearest of some centroids."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        norms = _norms(centroids)
        self.order = np.argsort(norms, kind="stable")
        self.norms = norms[self.order]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of each row's nearest centroid, ties to the smaller number."""
        parts = [self._nearest(x[at : at + STRETCH]) for at in range(0, len(x), STRETCH)] or [(np.zeros(0, np.int64),) * 2]
        return tuple(np.concatenate(p) for p in zip(*parts, strict=True))

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places, in the order of norms, from which and before which each row's annulus lies."""
        norms = _norms(x)
        at = np.searchsorted(self.norms, norms)
        near = [_squared(x, self.centroids[self.order[np.clip(at + side, 0, len(self.order) - 1)]]) for side in (-1, 0)]
        reach = np.sqrt(np.minimum(*near).astype(np.float64))
        slack = 1e-9 * (norms + reach + 1)
        return np.searchsorted(self.norms, norms - reach - slack, "left"), np.searchsorted(self.norms, norms + reach + slack, "right")

    def _nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = self.bounds(x)
        best, number = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(self.order))
        for place in range(int(low.min(initial=0)), int(high.max(initial=0))):
            some = np.flatnonzero((low <= place) & (place < high))
            c = self.order[place]
            d = _squared(x[some], self.centroids[c])
            nearer = (d < best[some]) | (d == best[some]) & (c < number[some])
            best[some[nearer]], number[some[nearer]] = d[nearer], c
        return number, best


def _norms(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return np.einsum("ij,ij->i", d, d)


def first_centroids(vectors: DataFrame, k: int = CENTROIDS, width: int = WIDTH, scale: float = SCALE) -> np.ndarray:
    """k rows at most reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = whole_vectors(batch.column(1), width, scale)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), width).cast(pa.list_(pa.int64()))], names=["h", "x"])

    hashed = vectors.select(F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).alias("h"), "embedding")
    rows = hashed.mapInArrow(run, "h string, x array<bigint>").orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()
    return np.array([r.x for r in rows], np.int64).reshape(len(rows), width)


def moved(vectors: DataFrame, centroids: np.ndarray, scale: float = SCALE) -> np.ndarray:
    """The centroids after one round: the floor of each cluster's exact mean, those of empty clusters as they were."""
    k, width = centroids.shape
    find = Annulus(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, width), object), np.zeros(k, np.int64)
        for batch in batches:
            _, x = whole_vectors(batch.column(0), width, scale)
            number, _ = find.nearest(x)
            for c in np.unique(number).tolist():
                own = x[number == c]
                sums[c] += own.sum(0)
                counts[c] += len(own)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, width)), pa.array(np.tile(np.arange(width), len(some))), pa.array([str(v) for v in sums[some].ravel()], pa.string()), pa.array(np.repeat(counts[some], width))], names=["cluster", "place", "total", "n"])

    added = vectors.select("embedding").mapInArrow(run, "cluster bigint, place bigint, total string, n bigint")
    after = centroids.copy()
    for r in added.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).toLocalIterator():
        after[r.cluster, r.place] = int(r.total) // r.n
    return after


def assigned(vectors: DataFrame, centroids: np.ndarray, scale: float = SCALE) -> DataFrame:
    """(vec_id, cluster, distance) of every vector that is kept."""
    find, width = Annulus(centroids), centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = whole_vectors(batch.column(1), width, scale)
            number, distance = find.nearest(x)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(number, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    schema = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, cluster int, distance bigint"
    return vectors.select("vec_id", "embedding").mapInArrow(run, schema)


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, scale: float = SCALE) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance), centroids) of vectors(vec_id, embedding)."""
    centroids = first_centroids(vectors, k, width, scale)
    if not len(centroids):
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")).limit(0), centroids
    for _ in range(rounds):
        centroids = moved(vectors, centroids, scale)
    return assigned(vectors, centroids, scale), centroids


def digest(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """rows with cluster_inertia, inertia, centroid_sha256; the join is with a row for each centroid."""
    spark = rows.sparkSession
    names = [(c, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids.tolist())]
    names = spark.createDataFrame(names, "cluster int, centroid_sha256 string")
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    by_cluster = rows.groupBy("cluster").agg(total.alias("own"))
    sums = by_cluster.select("cluster", F.col("own").cast("bigint").alias("cluster_inertia")).join(by_cluster.agg(F.sum("own").cast("bigint").alias("inertia")), how="cross")
    return rows.join(F.broadcast(names.join(sums, "cluster")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


# the rounds are one expression repeated
def _round_sql(before: int) -> str:
    return f""", a{before} AS MATERIALIZED (SELECT vec_id, v, cluster, d FROM (SELECT x.vec_id, x.v, c.cluster, list_inner_product(x.v, x.v) - 2 * list_inner_product(x.v, c.v) + list_inner_product(c.v, c.v) AS d,
  row_number() OVER (PARTITION BY x.row ORDER BY list_inner_product(x.v, x.v) - 2 * list_inner_product(x.v, c.v) + list_inner_product(c.v, c.v), c.cluster) AS place FROM x, c{before} c) WHERE place = 1)"""


def _moved_sql(before: int) -> str:
    return f""", c{before + 1} AS MATERIALIZED (SELECT cluster, coalesce(m.v, c.v) AS v FROM c{before} c LEFT JOIN (SELECT cluster, list(floor(s / n) ORDER BY i) AS v FROM (SELECT cluster, i, sum(v[i]) AS s, count(*) AS n FROM a{before}, range(1, {WIDTH + 1}) t(i) GROUP BY cluster, i) GROUP BY cluster) m USING (cluster))"""


ORACLE_SQL = (
    f"""WITH x AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding::DOUBLE[], lambda e: floor({SCALE} * e)) AS v FROM embeddings
  WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {WIDTH}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) - 1 AS cluster, v FROM x QUALIFY cluster < {CENTROIDS})"""
    + "".join(_round_sql(k) + _moved_sql(k) for k in range(ROUNDS))
    + _round_sql(ROUNDS)
    + f"""
SELECT a.vec_id, a.cluster::INT AS cluster, a.d::BIGINT AS distance, (sum(a.d) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.v::BIGINT[], ',')) AS centroid_sha256 FROM a{ROUNDS} a JOIN c{ROUNDS} c USING (cluster)"""
)
