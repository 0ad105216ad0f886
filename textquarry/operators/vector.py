"""Exact vector search: distances as expressions for rows, top-k by blocks of chunks met by blocks of queries.

A task gets one block of each, finds by a matrix product which pairs may be among a query's k nearest, computes those
alone as the expressions do, and hands on k rows a query: pairs are never rows, and no side passes the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_QUERIES = 10_000
BLOCK = 65_536  # vectors of a block of chunks
ASKED = 8_192  # queries of a block
CELLS = 4_000_000  # numbers of a matrix of distances


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def _doubles(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("array<double>")


def l2(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(_sum(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y))))


def dot(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine distance; null if either vector is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, 1 - dot(a, b) / norm)


def distance(a: Column | str, b: Column | str, metric: str) -> Column:
    return {"l2": l2, "cosine": cosine, "inner_product": lambda x, y: -dot(x, y)}[metric](a, b)


def top(rows: DataFrame, by: list[Column], k: int, group: str = "qid", rank: str = "rank") -> DataFrame:
    """The first k rows of each group, numbered from 1; `by` must end in a key that is unique in the group."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(group).orderBy(*by))).where(F.col(rank) <= k)


def few(queries: DataFrame, most: int = MOST_QUERIES) -> DataFrame:
    """queries, to be broadcast; an error if there are more than `most`."""
    if queries.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} queries: give them in blocks")
    return F.broadcast(queries)


def _vectors(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By width: the places of the vectors without a null, and these as doubles."""
    lists = column.combine_chunks()
    widths = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
    out = {}
    for width in np.unique(widths[widths >= 0]).tolist():
        at = np.flatnonzero(widths == width)
        flat = pc.list_flatten(lists.take(pa.array(at))).cast(pa.float64())
        whole = ~flat.is_null().to_numpy(zero_copy_only=False).reshape(len(at), width).any(1)
        out[width] = at[whole], flat.to_numpy(zero_copy_only=False).reshape(len(at), width)[whole]
    return out


def _computed(x: np.ndarray, y: np.ndarray, metric: str) -> np.ma.MaskedArray:
    """Distances of the rows of x and y, to the same bits as distance(); masked where that is null."""

    def added(parts: Iterator[np.ndarray]) -> np.ndarray:
        total = np.zeros(len(x))
        for part in parts:  # in order, as the expression adds
            total = total + part
        return total

    width = range(x.shape[1])
    with np.errstate(all="ignore"):
        if metric == "l2":
            return np.ma.masked_array(np.sqrt(added((x[:, j] - y[:, j]) * (x[:, j] - y[:, j]) for j in width)), False)
        dots = added(x[:, j] * y[:, j] for j in width)
        if metric == "inner_product":
            return np.ma.masked_array(-dots, False)
        norm = np.sqrt(added(x[:, j] * x[:, j] for j in width)) * np.sqrt(added(y[:, j] * y[:, j] for j in width))
        return np.ma.masked_array(1 - dots / norm, ~((norm > 0) | np.isnan(norm)))  # to Spark, NaN is more than 0


def _rounded(d: np.ndarray) -> np.ndarray:
    """d to six digits, half away from zero in decimal, as Spark rounds."""
    size = np.abs(d)
    with np.errstate(all="ignore"):
        units = size * 1e6
        out = np.floor(units + 0.5) / 1e6
        doubtful = np.abs(units - np.floor(units) - 0.5) <= 1e-9 + 4e-16 * units
    out = np.where(size < 2.0**52, out, size)
    for i in np.flatnonzero(doubtful & (size < 2.0**52)).tolist():
        out[i] = float(Decimal(repr(float(size[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return np.copysign(out, d)


def _within(least: np.ndarray, error: np.ndarray, metric: str) -> np.ndarray:
    """Up to where the approximate distances (squares, for l2) lie of what may be no farther, once rounded, than `least`."""
    if metric == "l2":
        far = np.sqrt(np.maximum(least, 0) + error)
        return (far * (1 + 1e-12) + 1.1e-6) ** 2 + error
    return least + np.abs(least) * 1e-12 + 2 * error + 1.1e-6


def _candidates(x: np.ndarray, y: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of x, row of y), by a matrix product, with all that may be among the k nearest rows of y to a row of x; ordinary numbers only."""
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    long, unit = np.sqrt(yy.max(initial=0)), (x.shape[1] + 8) * 1e-15
    if metric == "cosine":
        near, error = -(x / np.sqrt(xx)[:, None]) @ (y / np.sqrt(yy)[:, None]).T, np.full(len(x), 4 * unit)
    elif metric == "l2":
        near, error = xx[:, None] + yy[None] - 2 * (x @ y.T), unit * (np.sqrt(xx) + long) ** 2
    else:
        near, error = -(x @ y.T), unit * np.sqrt(xx) * long
    if len(y) <= k:
        return np.divmod(np.arange(near.size), len(y))
    least = np.partition(near[:, : max(4096, 2 * k)], k - 1, axis=1)[:, k - 1]
    row, at = np.nonzero(near <= _within(least, error, metric)[:, None])
    value = near[row, at]
    order = np.lexsort((value, row))
    row, at, value = row[order], at[order], value[order]
    least = value[np.searchsorted(row, np.arange(len(x))) + k - 1]  # each row has k at least
    some = value <= _within(least, error, metric)[row]
    return row[some], at[some]


def _first(group: np.ndarray, k: int) -> np.ndarray:
    """Whether an entry is among the first k of its group; groups stand together."""
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, int)
    return np.arange(len(group)) - np.repeat(start, np.diff(np.r_[start, len(group)])) < k


def _ordinary(x: np.ndarray, metric: str) -> np.ndarray:
    fit = (np.isfinite(x) & (np.abs(x) < 1e100)).all(1)
    if metric == "cosine":
        with np.errstate(all="ignore"):
            fit &= (x * x).sum(1) > 1e-200
    return fit


def _nearest(asked: np.ndarray, stored: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of asked, row of stored, distance) of the k nearest of each row of asked; of equal distances the earlier rows."""
    # of equal vectors only the first k can be among the nearest, so copies make no more pairs
    same = np.unique(_as_keys(stored), return_inverse=True)[1].ravel()
    order = np.argsort(same, kind="stable")
    some = np.sort(order[_first(same[order], k)])
    x, out = stored[some], []
    fit, odd = np.flatnonzero(_ordinary(x, metric)), np.flatnonzero(~_ordinary(x, metric))
    plain = _ordinary(asked, metric)
    step = max(1, CELLS // max(1, len(x)))
    for a in range(0, len(asked), step):
        rows = np.arange(a, min(a + step, len(asked)))
        usual, other = rows[plain[rows]], rows[~plain[rows]]
        row, at = [np.repeat(other, len(x)), np.repeat(usual, len(odd))], [np.tile(np.arange(len(x)), len(other)), np.tile(odd, len(usual))]
        if len(usual) and len(fit):
            i, j = _candidates(asked[usual], x[fit], k, metric)
            row.append(usual[i])
            at.append(fit[j])
        row, at = np.concatenate(row), np.concatenate(at)
        pieces = [_computed(asked[row[p : p + BLOCK]], x[at[p : p + BLOCK]], metric) for p in range(0, len(row), BLOCK)]
        d = np.ma.concatenate(pieces) if pieces else np.ma.masked_array(np.zeros(0), False)
        there = ~np.ma.getmaskarray(d)
        row, at, d = row[there], at[there], d.data[there]
        order = np.lexsort((at, _rounded(d), row))  # NaN comes last
        order = order[_first(row[order], k)]
        out.append((row[order], some[at[order]], d[order]))
    return tuple(np.concatenate([o[c] for o in out]) for c in range(3)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _as_keys(x: np.ndarray) -> np.ndarray:
    """Each row as one value, equal where all its bytes are."""
    x = np.ascontiguousarray(x)
    return x.view(np.dtype((np.void, x.shape[1] * 8))).ravel() if x.shape[1] else np.zeros(len(x), np.int8)


def nearest_by(chunks: DataFrame, queries: DataFrame, k: int, metric: str, on: tuple[str, ...] = ()) -> DataFrame:
    """(qid, chunk_id, distance), the k nearest chunks(on..., chunk_id, embedding) of each of queries(on..., qid, vector) with equal values of `on`, or more.

    Each side of a group is dealt into blocks by a hash, each block of the one meets each of the other in a task. A task's memory
    follows BLOCK and ASKED; a query has up to k rows of each block.
    """
    spark = chunks.sparkSession
    chunks, queries = chunks.where("embedding is not null"), queries.where("vector is not null")
    count = lambda rows: (rows.groupBy(*on).count().agg(F.max("count")).first()[0] if on else rows.count()) or 0
    n, m = count(chunks), count(queries)
    across = 4 * spark.sparkContext.defaultParallelism
    asked = max(1, -(-m // ASKED))
    stored = max(1, -(-n // BLOCK), min(-(-n // 2048), -(-across // asked)) if not on else 1)
    dealt = lambda key, blocks: F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = queries.select(*on, dealt("qid", asked).alias("qb"), every(stored).alias("cb"), "qid", "vector")
    right = chunks.select(*on, every(asked).alias("qb"), dealt("chunk_id", stored).alias("cb"), "chunk_id", "embedding")
    schema = T.StructType([T.StructField("qid", queries.schema["qid"].dataType), T.StructField("chunk_id", chunks.schema["chunk_id"].dataType), T.StructField("distance", T.DoubleType())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.take(pc.sort_indices(right["chunk_id"], null_placement="at_start"))
        found, there = [], _vectors(right["embedding"])
        for width, (places, x) in _vectors(left["vector"]).items():
            if width in there:
                row, at, d = _nearest(x, there[width][1], k, metric)
                found.append((places[row], there[width][0][at], d))
        row, at, d = (np.concatenate([f[c] for f in found]) if found else np.zeros(0, int) for c in range(3))
        return pa.table({"qid": left["qid"].take(pa.array(row)), "chunk_id": right["chunk_id"].take(pa.array(at)), "distance": pa.array(d.astype(np.float64), pa.float64())})

    keys, parts = [*on, "qb", "cb"], max(across, min(asked * stored, 2000))
    # a number of partitions of their own: small inputs, but much work
    both = left.repartition(parts, *keys).groupBy(*keys).cogroup(right.repartition(parts, *keys).groupBy(*keys))
    return both.applyInArrow(run, schema)


def vector_topk(chunks: DataFrame, queries: DataFrame, k: int = 15, metric: str = "l2") -> DataFrame:
    """(qid, chunk_id, distance, rank) of chunks(chunk_id, embedding), nearest to queries(qid, vector) first.

    Chunks without a vector are left out, and pairs whose distance is null; ties fall to the smaller chunk_id.
    """
    found = nearest_by(chunks.select("chunk_id", "embedding"), queries.select("qid", "vector"), k, metric)
    return top(found.withColumn("distance", F.round("distance", 6)), [F.col("distance"), F.col("chunk_id")], k)


def with_snippet(ranked: DataFrame, chunks: DataFrame, characters: int = 500) -> DataFrame:
    """Text is fetched only for what is ranked (k rows a query)."""
    return chunks.select("chunk_id", F.left("chunk_text", F.lit(characters)).alias("snippet")).join(F.broadcast(ranked), "chunk_id")


def audit(chunks: DataFrame, width: int) -> DataFrame:
    """One row: how many vectors are missing, of another width, or hold a number that isn't finite."""
    v = F.col("embedding")
    odd = F.exists(_doubles(v), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    count = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    return chunks.agg(F.count("*").alias("n_chunks"), count(v.isNull(), "n_missing"), count(F.size(v) != width, "n_other_width"), count(odd, "n_not_finite"))


def missing(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks without a vector yet: what a resumed embedding run still has to do (V8)."""
    return chunks.join(vectors.select("chunk_id"), "chunk_id", "left_anti")


def attempts(text: Column | str, citation: Column | str) -> Column:
    """Shorter and shorter inputs for an embedder that refuses long ones, each once (V9)."""
    text = F.col(text) if isinstance(text, str) else text
    citation = F.coalesce(F.col(citation) if isinstance(citation, str) else citation, F.lit(""))
    cuts = [F.left(text, F.lit(n)) for n in (10_000, 8_000, 6_000, 4_000, 2_500, 1_500, 800)]  # fixed values
    all_ = F.array(text, *cuts, F.concat_ws(" ", citation, F.left(text, F.lit(500))), citation)
    return F.array_distinct(F.filter(all_, lambda x: x.isNotNull() & (F.trim(x) != "")))


def hashed_embedding(text: Column | str, width: int = 64) -> Column:
    """A deterministic stand-in for a model: signed counts of the words' hashes, of length one."""
    text = F.col(text) if isinstance(text, str) else text
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)
    zero = F.transform(F.sequence(F.lit(1), F.lit(width)), lambda _: F.lit(0.0))

    def add(state: Column, w: Column) -> Column:
        h = F.xxhash64(w)
        at = F.pmod(h, F.lit(width))
        return F.transform(state, lambda x, i: F.when(i == at, x + F.when(h < 0, -1.0).otherwise(1.0)).otherwise(x))

    counts = F.aggregate(words, zero, add)
    norm = F.sqrt(_sum(F.transform(counts, lambda x: x * x)))
    return F.when(norm > 0, F.transform(counts, lambda x: x / norm))


def lsh_recall(chunks: DataFrame, queries: DataFrame, exact: DataFrame, k: int = 15) -> DataFrame:
    """Of exact top-k neighbours, the share that random-projection buckets also find: (qid, recall).

    What shares a bucket of a table is compared by blocks (see nearest_by), so pairs are never rows, however large the buckets.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=1.0, numHashTables=6, seed=7)
    items = chunks.where("embedding is not null").select("chunk_id", "embedding", array_to_vector(_doubles("embedding")).alias("v"))
    model = model.fit(items)
    buckets = lambda rows, *kept: model.transform(rows).select(F.posexplode("h").alias("table", "hash"), *kept).select("table", vector_to_array("hash")[0].cast("long").alias("bucket"), *kept)
    asked = queries.where("vector is not null").select("qid", "vector", array_to_vector(_doubles("vector")).alias("v"))
    found = nearest_by(buckets(items, "chunk_id", "embedding"), buckets(asked, "qid", "vector"), k, "l2", ("table", "bucket"))
    near = top(found.where("distance < 10").select("qid", "chunk_id", F.round("distance", 6).alias("d")).distinct(), [F.col("d"), F.col("chunk_id")], k)
    both = exact.where(F.col("rank") <= k).join(near.select("qid", "chunk_id", F.lit(1).alias("hit")), ["qid", "chunk_id"], "left")
    return both.groupBy("qid").agg((F.count("hit") / F.count("*")).alias("recall"))


VECTOR = T.ArrayType(T.FloatType())
