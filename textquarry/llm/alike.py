"""Operator 8 for groups by similarity: SimHash fingerprints in the Gray-order index, and a check of what it finds on whole sets.

Documents are alike if their sets of 5-word shingles have Jaccard similarity 0.8 or more. Such sets are vectors of ones
with a cosine of 8/9 at least, so each bit of their SimHash fingerprints differs with a chance of up to arccos(8/9) / pi = 0.151; one fingerprint
within the few bits that the index prunes by misses most pairs. Each set therefore gets several fingerprints ("tables"), of shingle hashes mixed with
numbers of their own; a pair within MOST_BITS bits in any of them is found. How many bits and tables depends on the number of
documents, see size(): bits grow with its logarithm, so that a code has hardly a neighbour by chance, and tables are as many as find RECALL of the pairs of
similarity 0.8 by the binomial formula (more of more similar ones): 32 bits in 29 tables for 256,000 documents, 41 bits in 84 for 100 million.

The fingerprints of a table are dealt out by each of BANDS bands of their bits: two within MOST_BITS bits have one band in common, so each goes to BANDS
tasks, however many documents there are. A task builds the Gray-order index over its part, the band's bits above all others, and walks it where the band agrees.
It joins fingerprints that links chain together to the least of them, their hub: those of one hub are a group, and
one may be in a group of each of its tasks. First each member of a group is checked against one pivot, the node of least hash in it, the same
in as many tables as hold it. What this joins is known to be one. Then every pair of a group within MOST_BITS bits that is still apart is
checked too (see unmet and met), so no pair that the index finds is left out, whatever the group's size; where the pivots have joined a group, no such pair
remains. Checks are on whole sets: groups of sets that aren't alike are taken apart again. Equal sets are one node. Sets are fetched for no pair that
is near in one table by chance alone, as the fingerprints over all tables tell (see likely; alike sets fail that with a chance under 10**-13).

Defined results: words are as in operator 8; fewer than five are one shingle; texts without words (also null) are
copies of each other; of each group the row of the smallest doc_id stays (null is later than all, ties fall to a hash of the row);
repeated rows are copies; an empty table gives an empty result; all columns stay, whatever their names. Shingles and
sets are known by 64-bit hashes, rows by 128 bits. A text takes about 150 bytes of a task's memory for each of its words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from .graph import components, stars
from .tables import Marks, fresh, keep, row_key, settle, shares, sieve
from .words import SPACE, U64, find, grams, mix, slices, within

SHINGLE = 5
LEAST = (4, 5)
MOST_BITS = 2
RECALL = 0.97  # of pairs of similarity 0.8
SPARE_BITS = 14  # beyond the logarithm of the number of documents: a code has some 500 / 2**14 neighbours by chance
MOST_TABLES = 256
WORD_BITS = 12
BANDS = MOST_BITS + 1
DEALT = 1 << 14  # nodes dealt out at a time
MEMBERS = 2_500  # of a block of a group
MEMBER_BYTES = 4096  # of a member's set, about
MET_BYTES = 16 << 20  # of the sets that a task gets, about
PAIRS = 1 << 20  # codes compared at a time
_DIFFER = math.acos(2 * LEAST[0] / sum(LEAST)) / math.pi
#: The parity columns of a shortened Hamming code of distance 3.
_PARITY = (3, 5, 6, 7, 9, 10, 11, 12)


def size(documents: int) -> tuple[int, int]:
    """(bits, tables) of the fingerprints for so many documents."""
    bits = min(64 - WORD_BITS, max(28, max(1, documents).bit_length() + SPARE_BITS))
    found = sum(math.comb(bits, k) * _DIFFER**k * (1 - _DIFFER) ** (bits - k) for k in range(MOST_BITS + 1))
    return bits, min(MOST_TABLES, math.ceil(math.log(1 - RECALL) / math.log(1 - found)))


def _code_word(table: int) -> int:
    """WORD_BITS bits of a table: those of any two tables differ in three at least."""
    parity = 0
    for k, column in enumerate(_PARITY):
        parity ^= column if table >> k & 1 else 0
    return table << 4 | parity


def _sets(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of all texts, ascending in each, and how many each has."""
    words = find(texts, SPACE, lower=True)
    hashes = words.hashes()
    whole = within(words.counts, shingle)
    row, value = [words.row[: len(whole)][whole]], [grams(hashes, shingle)[whole]]
    for n in range(1, shingle):
        few = np.flatnonzero(words.counts == n)
        if len(few):
            row.append(few)
            value.append(mix(grams(hashes, n)[words.first[few]] + U64(n)))
    row, value = np.concatenate(row), np.concatenate(value)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return value[new], np.bincount(row[new], minlength=len(texts))


def _nodes(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    data, end = memoryview(values.tobytes()), (8 * np.cumsum(counts)).tolist()
    return np.fromiter((xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip([0, *end[:-1]], end, strict=True)), U64, len(end)).view(np.int64)


def _each(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for a, b in slices(texts):
        yield a, b, *_sets(texts.slice(a, b - a))


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _codes(values: np.ndarray, counts: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The fingerprint of each set in each table."""
    row, out = np.repeat(np.arange(len(counts)), counts), np.zeros((len(counts), tables), U64)
    mixed = mix(np.arange(1, tables + 1, dtype=U64))
    for t in range(tables):
        parts = ((mix(values[k : k + simhash.PART] ^ mixed[t]), row[k : k + simhash.PART]) for k in range(0, len(row), simhash.PART))
        out[:, t] = simhash.majority(parts, counts, bits).view(U64)
    return out


def _packed(codes: np.ndarray, bits: int) -> np.ndarray:
    """Each code in as few bytes as hold its bits."""
    return codes.astype("<u8")[..., None].view(np.uint8)[..., : -(-bits // 8)]


def _unpacked(data: np.ndarray) -> np.ndarray:
    out = np.zeros((*data.shape[:-1], 8), np.uint8)
    out[..., : data.shape[-1]] = data
    return out.view("<u8")[..., 0].astype(U64)


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that stand one after another in data and end there."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _rows(documents: DataFrame, bits: int, tables: int) -> DataFrame:
    """(doc_id, k1, k2, node, codes): key, hash of the set and packed fingerprints of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, codes = [np.zeros(0, np.int64)], [np.zeros((0, tables), U64)]
            for _, _, values, counts in _each(batch.column(3)):
                nodes.append(_nodes(values, counts))
                codes.append(_codes(values, counts, bits, tables))
            data = _packed(np.concatenate(codes), bits)
            lists = _binary(data, np.arange(1, len(data) + 1) * (tables * data.shape[-1]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.concatenate(nodes)), lists], names=["doc_id", "k1", "k2", "node", "codes"])

    docs = _texts(documents)
    return docs.select("doc_id", *(c.alias(n) for c, n in zip(row_key(docs), ("k1", "k2"), strict=True)), "text").mapInArrow(run, "doc_id bigint, k1 bigint, k2 bigint, node bigint, codes binary")


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs(a, b), those whose whole sets are alike."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("one")), "a").join(sets.select(F.col("node").alias("b"), F.col("members").alias("two")), "b")
    same = F.size(F.array_intersect("one", "two")).cast("long")
    return both.where(same * sum(LEAST) >= (F.size("one") + F.size("two")).cast("long") * LEAST[0]).select("a", "b")


def _most_apart(bits: int) -> float:
    """In how many of all bits of their fingerprints alike sets may differ: twelve standard deviations beyond what those of similarity 0.8 do, 0.3 of them at least.

    Of sets of four and five shingles 0.19 differ, more than of larger ones; of any two texts, half.
    """
    return max(0.3 * bits, bits * _DIFFER + 12 * math.sqrt(bits * _DIFFER * (1 - _DIFFER)))


def likely(pairs: DataFrame, coded: DataFrame, bits: int) -> DataFrame:
    """pairs(a, b) but for those whose fingerprints, over all tables of coded(node, codes), tell that they are near in one by chance alone."""
    most = _most_apart(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
            yield batch.filter(pa.array(np.bitwise_count(one ^ two).sum(axis=1, dtype=np.int64) <= most)).select(["a", "b"])

    codes = lambda node, name: coded.select(F.col("node").alias(node), F.col("codes").alias(name))
    both = pairs.join(codes("a", "one"), "a").join(codes("b", "two"), "b").select("a", "b", "one", "two")
    return both.mapInArrow(run, "a bigint, b bigint")


def _members(documents: DataFrame, rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, members) of the wanted nodes, from one row of each, and of few others."""
    marks = Marks(rows.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("k1").alias("k1")), "k1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, values, counts in _each(batch.column(1).filter(pa.array(marks.has(batch.column(0))))):
                ends = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(_nodes(values, counts)), pa.ListArray.from_arrays(ends, pa.array(values.view(np.int64)))], names=["node", "members"])

    docs = _texts(documents)
    return docs.select(row_key(docs)[0].alias("k1"), "text").mapInArrow(run, "node bigint, members array<bigint>").dropDuplicates(["node"])


def _checked(pairs: DataFrame, documents: DataFrame, rows: DataFrame) -> DataFrame:
    """Of candidate pairs(a, b), those whose whole sets are alike; sets are fetched for these pairs alone."""

    def check() -> DataFrame:
        own = keep(pairs)
        nodes = own.select(F.col("a").alias("node")).unionByName(own.select(F.col("b").alias("node"))).distinct()
        return _alike(own, _members(documents, rows, nodes))

    return settle(documents.sparkSession, check)


def _bands(bits: int) -> list[tuple[int, int]]:
    """Lowest bit of each band, and how many it has."""
    cuts = [bits * k // BANDS for k in range(BANDS + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _upper_bits(documents: int, bits: int) -> int:
    """How many of a band's upper bits tell its parts apart, so that these have about simhash.GROUP codes."""
    return min(bits // BANDS, max(0, (max(1, documents) - 1) // simhash.GROUP).bit_length())


def _deal(bits: int, tables: int, upper: int):
    bands = _bands(bits)
    record = np.dtype([("node", "<i8"), ("code", np.uint8, (-(-bits // 8),))])

    def dealt(nodes: np.ndarray, data: np.ndarray) -> Iterator[pa.RecordBatch]:
        codes = _unpacked(data)
        for t in range(tables):
            for band, (low, width) in enumerate(bands):
                part = (codes[:, t] >> U64(low + width - upper) & U64((1 << upper) - 1)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                sent = np.empty(len(order), record)
                sent["node"], sent["code"] = nodes[order], data[order, t]
                some, n = np.unique(part, return_counts=True)
                group = (t * BANDS + band << upper) + some
                yield pa.RecordBatch.from_arrays([pa.array(group, pa.int64()), _binary(sent.view(np.uint8), np.cumsum(n) * record.itemsize)], names=["group", "sent"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            held.append((nodes, np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(nodes), tables, -(-bits // 8))))
            n += len(nodes)
            if n >= DEALT:
                yield from dealt(*map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
        if n:
            yield from dealt(*map(np.concatenate, zip(*held, strict=True)))

    return run


def _find(bits: int, upper: int):
    bands = _bands(bits)
    record = np.dtype([("node", "<i8"), ("code", np.uint8, (-(-bits // 8),))])
    every = U64((1 << bits) - 1)

    def turned(codes: np.ndarray, left: int) -> np.ndarray:
        return codes if left in (0, bits) else (codes << U64(left) | codes >> U64(bits - left)) & every

    def found(table: pa.Table) -> pa.Table:
        t, band = divmod(table.column("group")[0].as_py() >> upper, BANDS)
        low, width = bands[band]
        got = np.frombuffer(b"".join(table.column("sent").to_pylist()), record)
        nodes, codes = got["node"], _unpacked(got["code"])
        index = simhash._Index(np.unique(turned(codes, bits - low - width)))
        label = np.arange(len(index.codes))
        own = turned(index.codes, low + width)

        def joined(ends: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
            i, j = (np.concatenate(x) for x in zip(*ends, strict=True))
            return stars(len(label), np.concatenate([i, np.arange(len(label))]), np.concatenate([j, label]))

        ends = []
        for i, j in index.search(index, MOST_BITS, U64((1 << width) - 1 << bits - width)):
            ends.append((i[i < j], j[i < j]))
            if sum(len(x) for x, _ in ends) > PAIRS:
                label, ends = joined(ends), []
        if ends:
            label = joined(ends)
        least = np.full(len(label), every)
        np.minimum.at(least, label, own)
        order = np.argsort(own)
        at = order[np.searchsorted(own[order], codes)]
        near = np.flatnonzero(np.bincount(label[at], minlength=len(label))[label[at]] > 1)
        word = U64(_code_word(t) << bits)
        return pa.table({"node": nodes[near], "code": (codes[near] | word).view(np.int64), "root": (least[label[at[near]]] | word).view(np.int64)})

    return found


def indexed(coded: DataFrame, documents: int, bits: int, tables: int) -> DataFrame:
    """Members (node, code, root) of the groups of the Gray-order index over coded(node, codes): nodes whose codes links chain to one hub, or are equal."""
    upper = _upper_bits(documents, bits)
    dealt = coded.mapInArrow(_deal(bits, tables, upper), "group bigint, sent binary")
    return keep(dealt.groupBy("group").applyInArrow(_find(bits, upper), "node bigint, code bigint, root bigint").distinct())


def pivoted(grouped: DataFrame) -> DataFrame:
    """Candidate pairs (a, b): each member of a group with the group's pivot."""
    least = F.min(F.struct(F.xxhash64("node"), F.col("node")))
    pivots = grouped.groupBy("root").agg(least["node"].alias("pivot"), F.count("*").alias("n")).where("n > 1").select("root", "pivot")
    pairs = grouped.join(pivots, "root").where("node <> pivot")
    return pairs.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()


def unmet(grouped: DataFrame, parts: DataFrame) -> DataFrame:
    """Members (root, i, j, node, code, part, left, right) in blocks that bring together all nodes of a group that are of different parts(node, root), so not known to be of one.

    What a group's largest part doesn't hold, the left ones, meets all of the group, the right ones, in blocks of MEMBERS by MEMBERS; a member that is both in one block is one row.
    """
    named = grouped.join(parts.withColumnRenamed("root", "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))
    each = named.groupBy("root", "part").agg(F.count("*").alias("n"))
    mixed = each.groupBy("root").agg(F.sum("n").alias("all"), F.max_by("part", F.struct("n", "part")).alias("main"), F.max("n").alias("most")).where("all > most and all > 2")
    members = keep(named.join(mixed, "root").withColumn("other", F.col("all") - F.col("most")))
    blocks = lambda n: F.ceil(F.col(n) / F.lit(MEMBERS))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), blocks(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("node"), blocks(n))
    at = ["root", "i", "j", "node", "code", "part"]
    left = members.where("part <> main").withColumn("i", own("other")).withColumn("j", every("all")).select(*at, F.lit(True).alias("left"), F.lit(False).alias("right"))
    right = members.withColumn("i", every("other")).withColumn("j", own("all")).select(*at, F.lit(False).alias("left"), F.lit(True).alias("right"))
    return keep(left.unionByName(right).groupBy(*at).agg(F.max("left").alias("left"), F.max("right").alias("right")))


def _near(table: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Of each left row, where the right rows of its block stand that have a near code and are of another part."""
    root, i, j, code, part, left, right = (table.column(k).to_numpy() for k in ("root", "i", "j", "code", "part", "left", "right"))
    order = np.lexsort((j, i, root))
    new = np.flatnonzero(np.concatenate([[True], np.any([x[order][1:] != x[order][:-1] for x in (root, i, j)], axis=0)]))
    for block in np.split(order, new[1:]):
        one, two = block[left[block]], block[right[block]]
        for x in one if len(two) else one[:0]:
            y = two[(np.bitwise_count(code[x] ^ code[two]) <= MOST_BITS) & (part[two] != part[x])]
            for at in range(0, len(y), MEMBERS):
                yield x, y[at : at + MEMBERS]


def _hopeful(most: float):
    def some(table: pa.Table) -> pa.Table:
        codes, hit = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.uint8).reshape(table.num_rows, -1), np.zeros(table.num_rows, bool)
        for x, y in _near(table):
            y = y[np.bitwise_count(codes[x] ^ codes[y]).sum(axis=1, dtype=np.int64) <= most]
            hit[y] = True
            hit[x] |= len(y) > 0
        return table.filter(pa.array(hit)).drop_columns(["codes", "bucket"])

    return some


def _met(table: pa.Table) -> pa.Table:
    """Links (a, b) that join what near codes and whole sets join in each block of unmet."""
    node, part = (table.column(k).to_numpy() for k in ("node", "part"))
    lists = pa.concat_arrays(table.column("members").chunks)
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    known, values = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    known = np.zeros(len(known), bool)
    a, b = [], []
    for x, y in _near(table):
        y = y[ends[y + 1] > ends[y]]
        if len(y):
            sizes = ends[y + 1] - ends[y]
            place = np.repeat(ends[y] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            known[values[ends[x] : ends[x + 1]]] = True
            same = np.add.reduceat(known[values[place]], np.cumsum(sizes) - sizes, dtype=np.int64)
            known[values[ends[x] : ends[x + 1]]] = False
            y = y[same * sum(LEAST) >= (sizes + ends[x + 1] - ends[x]) * LEAST[0]]
            a.append(np.full(len(y), x))
            b.append(y)
    a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b))
    # nodes of a part are known to be one: a link for each part that isn't its star's middle is enough
    _, first, own = np.unique(part, return_index=True, return_inverse=True)
    label = stars(len(first), own[a], own[b])
    out = np.flatnonzero(label != np.arange(len(first)))
    return pa.table({"a": node[first[out]], "b": node[first[label[out]]]})


def _by_blocks(blocks: DataFrame, beside: DataFrame):
    """blocks with beside by node, grouped so that a task gets whole blocks, of some MET_BYTES together."""
    bucket = F.pmod(F.xxhash64("root", "i", "j"), F.lit(shares(blocks.count() * MEMBER_BYTES, MET_BYTES)))
    return blocks.join(beside, "node").select(*blocks.columns, beside.columns[-1], bucket.alias("bucket")).groupBy("bucket")


def met(blocks: DataFrame, coded: DataFrame, bits: int, documents: DataFrame, rows: DataFrame) -> DataFrame:
    """Links (a, b) between members of the blocks of unmet that have near codes and whole sets that are alike; pairs are rows of no plan."""

    def check() -> DataFrame:
        some = keep(_by_blocks(blocks, coded).applyInArrow(_hopeful(_most_apart(bits)), blocks.schema))
        return _by_blocks(some, _members(documents, rows, some.select("node").distinct())).applyInArrow(_met, "a bigint, b bigint")

    return settle(documents.sparkSession, check)


def links(documents: DataFrame, rows: DataFrame, number: int, bits: int, tables: int) -> DataFrame:
    """Links (a, b) between nodes that the index finds and whole sets confirm: enough to join all that such links join."""
    coded = keep(rows.groupBy("node").agg(F.first("codes").alias("codes")))
    grouped = indexed(coded, number, bits, tables)
    found = _checked(likely(pivoted(grouped), coded, bits * tables), documents, rows)
    rest = unmet(grouped, components(found))
    return found.unionByName(met(rest, coded, bits * tables, documents, rows)) if rest.limit(1).count() else found


def _hashable(column: T.StructField) -> F.Column:
    """A column as it can be hashed: maps can't, as they are."""
    name = F.col("`" + column.name.replace("`", "``") + "`")
    return F.to_json(F.struct(name)) if "map<" in column.dataType.simpleString() else name


def one_of_each(documents: DataFrame) -> DataFrame:
    """The documents without all but one, that of the smallest doc_id, of each group."""
    number = documents.count()
    bits, tables = size(number)
    rows = keep(_rows(documents, bits, tables))
    named = rows.drop("codes").join(components(links(documents, rows, number, bits, tables)), "node", "left").select("doc_id", "k1", "k2", F.coalesce("root", "node").alias("root"))
    keys = named.groupBy("k1", "k2").agg(F.first("root").alias("root"), F.first("doc_id").alias("doc_id"), F.count("*").alias("n"))
    first = keys.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "k1", "k2")).alias("first"))
    # rows that stay as they are needn't be shuffled: only those of these keys are looked up
    other = keep(keys.join(first, "root").select("k1", "k2", ((F.col("first.k1") != F.col("k1")) | (F.col("first.k2") != F.col("k2"))).alias("goes"), "n").where("goes or n > 1"))
    clear, rest, (k1, k2) = sieve(documents, other.select("k1", "k2"))
    gone = other.where("goes").select(F.col("k1").alias(k1), F.col("k2").alias(k2))
    # of rows with equal doc_id and text the one of the least hash of all columns stays, so reruns agree
    tie, least = fresh([*documents.columns, k1, k2], "tie", "least")
    hashed = rest.join(gone, [k1, k2], "left_anti").select("*", F.xxhash64(*map(_hashable, documents.schema)).alias(tie))
    best = hashed.groupBy(k1, k2).agg(F.min(tie).alias(least))
    one = hashed.join(best, [k1, k2]).where(F.col(tie) == F.col(least)).dropDuplicates([k1, k2])
    return clear.unionByName(one.drop(k1, k2, tie, least))
