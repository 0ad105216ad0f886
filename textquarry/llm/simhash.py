"""Operator 8, SimHash near-dedup by a Gray-order hierarchical index.

A document's fingerprint has a bit set if over half of its 3-word shingles' XXH64 hashes (seed 42,
repeats included) have. Equal fingerprints are one node with its number of documents; different
ones link at 2 or fewer differing bits.

The distinct fingerprints are sorted by Gray rank, by which neighbours differ in few bits, and
cut into groups of at most about GROUP. A group's upper node is what its fingerprints share: a mask
of the bits equal in all, and their pattern. Two groups can only hold a link if their patterns
differ in 2 or fewer bits of both masks, so few of the pairs of groups remain (with l bits of prefix,
about 1 + l + l*l/2 partners each). The remaining pairs are tasks: each builds the lower levels
of the index over one group, every node with the bits that it shares beyond its parent's, and
walks it with the leaves of the other, adding up the differences level by level and leaving a
subtree when they pass 2. What is left is compared exactly. A task returns its links as stars (each
fingerprint with the least that it reaches there), so a cluster of any size gives no more links than
it has members; nothing is capped.

There are at most MOST_GROUPS groups: their masks are all that the driver sees.

Defined results: texts without words (also null) have fingerprint zero; fewer than three words
are one shingle; rows of null doc_id are grouped but never give a component its name, which is null
if it has no other; repeated rows get the same values; an empty table gives an empty result; other
columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, stars
from .tables import keep
from .words import SPACE, U64, find, slices

SHINGLE = 3
SEED = 42
MOST_BITS = 2
GROUP = 1 << 16
MOST_GROUPS = 20_000
FAN = 8
PART = 1 << 17  # shingles looked at together


def majority(hashes: Iterator[tuple[np.ndarray, np.ndarray]], n: np.ndarray, bits: int = 64) -> np.ndarray:
    """The fingerprint of each text, which has n shingles, from (hash, number of text) of all shingles in parts."""
    width = -(-bits // 8)
    sums = np.zeros((len(n), 8 * width), np.int32)
    for value, doc in hashes:
        begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else doc
        if len(begin):
            each = np.unpackbits(value.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width], axis=1, bitorder="little")
            sums[doc[begin]] += np.add.reduceat(each, begin, axis=0, dtype=np.int32)
    out = np.zeros((len(n), 8), np.uint8)
    out[:, :width] = np.packbits(2 * sums > n[:, None], axis=1, bitorder="little")
    codes = out.view("<u8").reshape(-1)
    return (codes & U64(2**bits - 1)).view(np.int64)


def _fingerprints(texts: pa.Array, shingle: int) -> np.ndarray:
    words = find(texts, SPACE, lower=True)
    first, counts = words.first, words.counts
    size = np.where(counts > 0, np.minimum(counts, shingle), 0)  # words of a shingle
    n = np.where(counts > 0, counts - size + 1, 0)
    before, data, digest = np.cumsum(n) - n, memoryview(words.data), xxhash.xxh64_intdigest

    def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at in range(0, int(n.sum()), PART):
            number = np.arange(at, min(at + PART, int(n.sum())))
            doc = np.searchsorted(before + n, number, side="right")
            start = number - before[doc] + first[:-1][doc]
            begins, ends = words.starts[start].tolist(), words.ends[start + size[doc] - 1].tolist()
            yield np.fromiter((digest(data[a:b], SEED) for a, b in zip(begins, ends, strict=True)), U64, len(begins)), doc

    return majority(parts(), n)


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Per row: doc_id, code (the fingerprint as a signed long)."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [_fingerprints(batch.column(1).slice(a, b - a), shingle) for a, b in slices(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([np.zeros(0, np.int64), *codes]))], names=["doc_id", "code"])

    return docs.mapInArrow(run, "doc_id bigint, code bigint")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each 64-bit code in the reflected Gray order."""
    x = codes.astype(U64)
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> U64(shift))
    return x


def _rank_column(code: str) -> F.Column:
    """The upper 62 bits of the Gray rank, as a number that isn't negative."""
    x = F.shiftrightunsigned(F.col(code), 1)
    y = F.col(code).bitwiseXOR(x)
    for shift in (2, 4, 8, 16, 32):
        y = y.bitwiseXOR(F.shiftrightunsigned(y, shift))
    return F.shiftrightunsigned(y, 2)


class _Index:
    """Levels of nodes over codes in Gray order; each node has FAN below it."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes[np.argsort(gray_rank(codes), kind="stable")]
        both, some = self.codes, self.codes
        self.levels = []  # from the leaves up: mask of the shared bits, their pattern
        while True:
            begin = np.arange(0, len(both), FAN)
            both, some = np.bitwise_and.reduceat(both, begin), np.bitwise_or.reduceat(some, begin)
            mask = ~(both ^ some)
            self.levels.append((mask, both & mask))
            if len(both) <= FAN:
                break

    def search(self, other: _Index, most: int, same: np.uint64 | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places in self.codes and other.codes of all codes that differ in `most` bits at most, and in none of the bits `same`."""
        mask, pattern = self.levels[0]
        step = max(1, (1 << 19) // max(1, len(other.levels[-1][0]) * 16))
        for begin in range(0, len(mask), step):
            leaf = np.arange(begin, min(begin + step, len(mask)))
            top = len(other.levels[-1][0])
            left, node = np.repeat(leaf, top), np.tile(np.arange(top), len(leaf))
            seen = np.zeros(len(left), U64)  # the bits compared above
            gone = np.zeros(len(left), np.uint8)
            for level in range(len(other.levels) - 1, -1, -1):
                m, p = other.levels[level]
                common = mask[left] & m[node]
                apart = (pattern[left] ^ p[node]) & common
                gone = gone + np.bitwise_count(apart & ~seen)
                ok = gone <= most
                if same is not None:
                    ok &= apart & same == 0
                left, node, seen, gone = left[ok], node[ok], common[ok], gone[ok]
                if level:
                    below = len(other.levels[level - 1][0])
                    left, seen, gone = (np.repeat(x, FAN) for x in (left, seen, gone))
                    node = (node[:, None] * FAN + np.arange(FAN)).reshape(-1)
                    ok = node < below
                    left, node, seen, gone = left[ok], node[ok], seen[ok], gone[ok]
            for at in range(0, len(left), 1 << 14):
                i = (left[at : at + (1 << 14), None] * FAN + np.arange(FAN))[:, :, None]
                j = (node[at : at + (1 << 14), None] * FAN + np.arange(FAN))[:, None, :]
                i, j = (x.reshape(-1) for x in np.broadcast_arrays(i, j))
                ok = (i < len(self.codes)) & (j < len(other.codes))
                i, j = i[ok], j[ok]
                apart = self.codes[i] ^ other.codes[j]
                ok = np.bitwise_count(apart) <= most
                if same is not None:
                    ok &= apart & same == 0
                yield i[ok], j[ok]


def _pair_links(most: int):
    def links(table: pa.Table) -> pa.Table:
        code, side = table.column("code").to_numpy().view(U64), table.column("side").to_numpy()
        left = _Index(code[side == 0])
        right = _Index(code[side == 1]) if (side == 1).any() else left
        n = len(left.codes)
        label = np.arange(n + (0 if right is left else len(right.codes)))
        codes = left.codes if right is left else np.concatenate([left.codes, right.codes])
        for i, j in left.search(right, most):
            j = j if right is left else j + n
            found = stars(len(label), np.concatenate([i, np.arange(len(label))]), np.concatenate([j, label])) if len(i) else label
            label = found
        own = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": codes[own].view(np.int64), "b": codes[label[own]].view(np.int64)})

    return links


def links(codes: DataFrame, most: int = MOST_BITS, group: int = GROUP) -> DataFrame:
    """Links (a, b) that join all distinct codes of codes(code) which chains of near ones connect."""
    spark = codes.sparkSession
    ranked = keep(codes.select("code", _rank_column("code").alias("rank")))
    n = ranked.count()
    groups = min(MOST_GROUPS, -(-n // group))
    bounds = ranked.approxQuantile("rank", [k / groups for k in range(1, groups)], 1 / (4 * groups)) if groups > 1 else []
    placed = _placed(ranked, np.unique(np.array(bounds, np.int64)))
    upper = placed.groupBy("part").agg(F.expr("bit_and(code)").alias("both"), F.expr("bit_or(code)").alias("some")).orderBy("part").collect()
    part = np.array([r.part for r in upper], np.int64)
    both, some = (np.array([r[k] for r in upper], np.int64).view(U64) for k in ("both", "some"))
    mask = ~(both ^ some)
    tasks = []
    for k in range(len(part)):
        far = np.bitwise_count((both[k] ^ both[k:]) & mask[k] & mask[k:])
        tasks += [(int(part[k]), int(part[j])) for j in k + np.flatnonzero(far <= most)]
    rows = [(a, t, 0) for t, (a, b) in enumerate(tasks)] + [(b, t, 1) for t, (a, b) in enumerate(tasks) if a != b]
    roles = spark.createDataFrame(rows, "part int, task int, side int")
    return placed.join(roles, "part").groupBy("task").applyInArrow(_pair_links(most), "a bigint, b bigint")


def _placed(ranked: DataFrame, bounds: np.ndarray) -> DataFrame:
    """(code, part) of ranked(code, rank): part is how many of the ascending bounds are at most the rank."""
    if not len(bounds):
        return ranked.select("code", F.lit(0).alias("part"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = np.searchsorted(bounds, batch.column(1).to_numpy(), side="right")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(part, pa.int32())], names=["code", "part"])

    return ranked.select("code", "rank").mapInArrow(place, "code bigint, part int")


def roots(codes: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """(code, root) of distinct codes(code): root is a code that names the group."""
    found = components(links(codes, most))
    return codes.join(found.withColumnRenamed("node", "code"), "code", "left").select("code", F.coalesce("root", "code").alias("root"))


def groups(documents: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """Per row: doc_id, code, root (a code that names the group), component_id."""
    rows = keep(fingerprints(documents))
    nodes = keep(rows.groupBy("code").agg(F.min("doc_id").alias("least")))
    named = roots(nodes.select("code"), most)
    least = named.join(nodes, "code").groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(named.join(least, "root"), "code")


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), "component_id")
