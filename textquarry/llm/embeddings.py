"""Operator 6, embedding near-dedup by a subspace pigeonhole join.

Unit vectors with cosine >= c have squared distance <= 2 - 2c. Vectors are turned by the eigenvectors of
their second moments and cut into BLOCKS blocks of dimensions, the strongest dealt out in turn; each block
gets a share of the squared distance in proportion to its part of the total. A pair within the
whole distance is within its share in at least one block (pigeonhole), so the union over blocks of the pairs
found by a range join in that block's subspace holds every pair; each of these is compared in full, in double precision.

Equal vectors are one node with a count. Nodes are dealt out into tiles of about TILE: cells of the turned space, cut in two along
the widest dimension again and again. Where to cut is fitted on a sample of at most SAMPLE nodes; that decides only which
task compares what, every node is dealt, and ties of a cut's dimension are split by a hash of the node. A pair of tiles is a task
if, in some block's subspace, their cells come within the block's share, and in all dimensions together within
the whole distance. A task takes a stretch of rows at a time: all blocks' range joins over it, the union of
what they find, the full comparison, and the sums; so it holds the pairs of one stretch, whatever a cluster's size.
Tasks return sums of links for each vector, and links as stars (each vector with the least that it reaches there):
their number doesn't grow with the square of a cluster.

How much the cells prune depends on the data: clusters apart from each other meet in few tasks, but with a flat spectrum, as in
random vectors, all dimensions matter alike, cells of no subspace come apart by more than its share, all pairs of tiles
remain and work grows with the square of the number of different vectors; the README has figures.

Vectors of each length are compared with their own. Defined results: a vector that is null, zero, or holds null or
non-finite components links with nothing, and is its own component; a null vec_id takes part,
but names no component, and is kept only where none of its component has a vec_id (component_id is null then); repeated rows are linked copies of each other if their vector can link;
an empty table gives an empty result; only vec_id and embedding are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import components, stars
from .tables import keep

COSINE = 0.9
BLOCKS = 4
TILE = 1 << 14
MOST_TILES = 20_000
SAMPLE = 100_000
MARGIN = 1e-5  # of squared distances, for rounding in single precision
STRETCH = 512
CHUNK = 1 << 16  # pairs compared in full together


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _moments(vectors: DataFrame, width: int) -> np.ndarray:
    """Sum of the outer products of all unit vectors; a row of width**2 sums from each task's batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            u = _units(_matrix(batch.column(0)))
            total += u.T @ u if len(u) else 0
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "sums"])

    rows = vectors.select("vector").mapInArrow(run, "i int, sums array<double>").select("i", F.posexplode("sums").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    out = np.zeros((width, width))
    for r in rows:
        out[r.i, r.j] = r.x
    return out


class Cells:
    """Cells of the space, cut in two along the widest dimension at its median, from a sample."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.dim, self.cut, self.below = [], [], []  # of each cut; a negative number below is a cell's, -1 - number
        self.count = 0
        self.root = self._grow(sample, cells)
        self.dims, self.cuts, self.next = np.array(self.dim, np.int64), np.array(self.cut), np.array(self.below, np.int64).reshape(-1, 2)

    def _grow(self, rows: np.ndarray, cells: int) -> int:
        if cells <= 1 or len(rows) < 2:
            self.count += 1
            return -self.count
        d = int(np.argmax(np.var(rows, axis=0)))
        cut = float(np.quantile(rows[:, d], (cells // 2) / cells))
        k = len(self.dim)
        self.dim.append(d), self.cut.append(cut), self.below.append((0, 0))
        left = rows[:, d] < cut
        if not left.any() or left.all():  # ties: a hash of the node splits them
            left = np.arange(len(rows)) % 2 == 0
        self.below[k] = (self._grow(rows[left], cells // 2), self._grow(rows[~left], cells - cells // 2))
        return k

    def of(self, rows: np.ndarray, node: np.ndarray) -> np.ndarray:
        at = np.full(len(rows), self.root, np.int64)
        salt = node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        depth = 0
        while (open_ := np.flatnonzero(at >= 0)).size:
            k = at[open_]
            x = rows[open_, self.dims[k]]
            right = np.where(x == self.cuts[k], (salt[open_] >> np.uint64(20 + depth % 40)) & np.uint64(1) == 1, x > self.cuts[k])
            at[open_] = self.next[k, right.astype(np.int64)]
            depth += 1
        return -1 - at


class Turn:
    """The rotation, the dimensions of each block and its share of the squared distance."""

    def __init__(self, moments: np.ndarray, blocks: int, cosine: float):
        values, vectors = np.linalg.eigh(moments)
        order = np.argsort(-values, kind="stable")
        values, width = np.maximum(values[order], 0), len(order)
        self.matrix = vectors[:, order]
        blocks = max(1, min(blocks, width))
        dims = [np.arange(b, width, blocks) for b in range(blocks)]
        self.whole = 2 - 2 * cosine
        energy = np.array([values[d].sum() for d in dims])
        energy = energy / energy.sum() if energy.sum() > 0 else np.full(blocks, 1 / blocks)
        self.blocks = [(d, self.whole * e) for d, e in zip(dims, energy, strict=True)]


def _tile_links(turn: Turn, cosine: float):
    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        node, times = table.column("node").to_numpy(), table.column("times").to_numpy()
        unit = _units(_matrix(table.column("vector")))
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = not len(right)
        right = left if same else right
        turned = unit @ turn.matrix
        # in a block one product gives |a|^2 + |b|^2 - 2ab; single precision, with a margin, as the full comparison follows
        blocks = []
        for dims, share in turn.blocks:
            a, b = turned[left][:, dims], turned[right][:, dims]
            a = np.column_stack([a * -2, (a * a).sum(1), np.ones(len(a))]).astype(np.float32)
            b = np.column_stack([b, np.ones(len(b)), (b * b).sum(1)]).astype(np.float32)
            blocks.append((a, np.ascontiguousarray(b.T), np.float32(share + MARGIN)))
        del turned
        links, root = np.zeros(len(node)), np.arange(len(node))
        for i in range(0, len(left), STRETCH):
            k = min(i + STRETCH, len(left))
            from_ = i if same else 0  # pairs within a tile once
            near = np.zeros((k - i, len(right) - from_), bool)
            for a, b, share in blocks:
                near |= a[i:k] @ b[:, from_:] <= share
            x, y = np.nonzero(near)
            x, y = x + i, y + from_
            if same:
                x, y = x[x < y], y[x < y]
            for at in range(0, len(x), CHUNK):
                p, q = left[x[at : at + CHUNK]], right[y[at : at + CHUNK]]
                ok = np.einsum("ij,ij->i", unit[p], unit[q]) >= cosine
                p, q = p[ok], q[ok]
                if len(p):
                    links += np.bincount(p, times[q], len(node)) + np.bincount(q, times[p], len(node))
                    own = np.flatnonzero(root != np.arange(len(node)))
                    root = stars(len(node), np.concatenate([p, own]), np.concatenate([q, root[own]]))
        some = np.flatnonzero(links)
        return pa.table({"node": node[some], "links": links[some].astype(np.int64), "root": node[root[some]]})

    return run


def _usable(x: F.Column) -> F.Column:
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return x.isNotNull() & ~bad & F.exists(x, lambda v: v != 0)


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    kind = "float" if embeddings.schema["embedding"].dataType == T.ArrayType(T.FloatType()) else "double"  # floats stay small
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("vector"))
    rows = rows.withColumn("usable", F.coalesce(_usable(F.col("vector")), F.lit(False)))
    # 0.0 and -0.0 group alike
    usable = keep(rows.where("usable").select("vec_id", F.transform("vector", lambda v: v + F.lit(0.0).cast(kind)).alias("vector")))
    nodes = usable.groupBy("vector").agg(F.count("*").alias("times"), F.min("vec_id").alias("least"))
    nodes = keep(nodes.withColumn("node", F.monotonically_increasing_id()))
    linked = None
    for r in nodes.groupBy(F.size("vector").alias("width")).count().orderBy("width").collect():
        part = _linked(nodes.where(F.size("vector") == r.width), r["count"], r.width, cosine, blocks, tile)
        linked = part if linked is None else linked.unionByName(part)
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if linked is None:
        return alone
    members = usable.join(linked.join(nodes.select("node", "vector"), "node"), "vector")
    return members.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")).unionByName(alone)


def _list(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.reshape(-1)))


def _tiles(nodes: DataFrame, n: int, turn: Turn, tile: int) -> tuple[DataFrame, DataFrame]:
    """(node, part) of all nodes, and the tasks (part, task, side)."""
    spark, width = nodes.sparkSession, len(turn.matrix)
    share = min(1.0, SAMPLE / n)
    some = nodes.where(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < int(share * (1 << 30))).select("vector").limit(2 * SAMPLE).toArrow().column("vector")
    cells = Cells(_units(_matrix(some)) @ turn.matrix if len(some) else np.zeros((0, width)), min(MOST_TILES, -(-n // tile)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turned = _units(_matrix(batch.column(1))) @ turn.matrix
            part = cells.of(turned, batch.column(0).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(part, pa.int32()), _list(turned)], names=["node", "part", "turned"])

    placed = nodes.select("node", "vector").mapInArrow(place, "node bigint, part int, turned array<double>")
    boxes = placed.select("part", F.posexplode("turned").alias("d", "v")).groupBy("part", "d").agg(F.min("v").alias("low"), F.max("v").alias("high")).toArrow()
    part, d = boxes.column("part").to_numpy(), boxes.column("d").to_numpy()
    names = np.unique(part)
    low, high = np.zeros((len(names), width)), np.zeros((len(names), width))
    low[np.searchsorted(names, part), d], high[np.searchsorted(names, part), d] = boxes.column("low").to_numpy(), boxes.column("high").to_numpy()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                gap = np.maximum(0, np.maximum(low[i:] - high[i], low[i] - high[i:])) ** 2
                near = np.zeros(len(gap), bool)
                for dims, share in turn.blocks:
                    near |= gap[:, dims].sum(1) <= share + MARGIN
                j = i + np.flatnonzero(near & (gap.sum(1) <= turn.whole + MARGIN))
                task, apart = i * len(names) + j, j > i
                ends = np.concatenate([np.full(len(j), names[i]), names[j[apart]]])
                yield pa.RecordBatch.from_arrays([pa.array(ends, pa.int32()), pa.array(np.concatenate([task, task[apart]]), pa.int64()), pa.array(np.repeat([0, 1], [len(j), apart.sum()]), pa.int32())], names=["part", "task", "side"])

    return placed.select("node", "part"), spark.range(len(names)).mapInArrow(meet, "part int, task bigint, side int")


def _linked(nodes: DataFrame, n: int, width: int, cosine: float, blocks: int, tile: int) -> DataFrame:
    """(node, n_links, component_id)."""
    turn = Turn(_moments(nodes, width), blocks, cosine)
    placed, tasks = _tiles(nodes, n, turn, tile)
    dealt = placed.join(nodes.select("node", "times", "vector"), "node").join(tasks, "part")
    found = keep(dealt.groupBy("task").applyInArrow(_tile_links(turn, cosine), "node bigint, links bigint, root bigint"))
    roots = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.join(roots, "node", "left").join(links, "node", "left").select("node", "least", "times", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(least, "root").select("node", (F.col("links") + F.col("times") - 1).alias("n_links"), "component_id")
