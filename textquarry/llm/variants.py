"""Operator 13, spelling variants: words one edit apart, found by two-dimensional range reporting.

Two words are near if one insertion, deletion or replacement of a code point leads from one to the other. For a position of
the edit, the words that agree before it are an interval of the words in order, those that agree
after it an interval of the words in the order of their reversals. A wavelet tree over the one order's ranks in the other
reports the words that lie in both intervals; deletions are insertions seen from the longer word.

Spark deals the words out so that no task needs them all: an edit lies in one half of the longer word, so the other half is equal
in both, and (length, half) is a key under which they meet. A key with more than MOST_GROUP words is
split: the half that holds the edit is halved again, its other part joins the key. At the end of that a key
leaves one position open, so that it has no more words than there are letters. Each task builds its orders and trees over the keys
dealt to it. Of the several positions that can explain one insertion only the last one counts, so each pair is reported once.

Counting words shuffles a row for each task and word. The form of a word that has none near and far more frequent is null; roots follow
from forms by doubling: each round halves what is left of every chain, and counts at least double along a chain.

Defined results: a null text has no words, a null doc_id is the empty string under the hash; rows that repeat a doc_id are documents of
their own; upper-case letters beyond A-Z stay, and count as letters of their own; a run of any length is one word; no words,
or an empty table, give an empty result; only doc_id and text are read, so further columns can't clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import drop, keep, keep_at, shares
from .words import LOWER, SPACE, find, mix, slices, utf8

LEAST_LETTERS = 5
LEAST_COUNT = 3
RATIO = 2  # how many times as frequent a word's form must be
MISSPELT = 97
MOST_GROUP = 20_000
EACH = 100_000  # rows a task
AT_A_TIME = 1 << 16  # rectangles
LONG = 64

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_LEAD = 0xC3  # the first UTF-8 byte of U+00C0 to U+00FF, and of nothing else
U64 = np.uint64


# ---- words and their counts ---------------------------------------------------------------------------------


def _shift_table() -> np.ndarray:
    """What a CRC-32 state's low byte turns into as a zero byte is appended."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, np.uint32(0xEDB88320) ^ (t >> 1), t >> 1)
    return t


_SHIFT = _shift_table()


def _runs(texts: pa.Array):
    """Maximal runs of letters, A-Z lower-cased."""
    data, offsets = utf8(texts)
    letter = _LETTER[data]
    lead = np.flatnonzero(data == _LEAD)
    letter[lead] = letter[lead + 1] = True
    plain = np.where(letter, LOWER[data], np.uint8(0x20))
    return find(pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(plain)), SPACE)


def _counted(ids: list, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Words and their counts in some texts, with the deletions that the hash of document and run asks for."""
    runs = _runs(texts)
    coded = runs.coded()
    code, known = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
    row, sizes = runs.row, runs.ends - runs.starts
    own = np.array([zlib.crc32(w.encode()) for w in known], np.uint32)
    state = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    begun, h = state.tolist(), np.zeros(len(code), np.uint32)
    # the CRC of two joined strings: that of the first, shifted by as many zero bytes as the second has, xor that of the second
    order = np.argsort(sizes, kind="stable")
    bounds = np.searchsorted(sizes[order], np.arange(LONG + 2))
    for size in range(1, LONG + 1):
        state = _SHIFT[state & np.uint32(255)] ^ (state >> np.uint32(8))
        some = order[bounds[size] : bounds[size + 1]]
        h[some] = state[row[some]] ^ own[code[some]]
    for at in order[bounds[LONG + 1] :].tolist():
        h[at] = zlib.crc32(known[code[at]].encode(), begun[row[at]])
    letters = np.array([len(w) for w in known], np.int64)
    hit = h % np.uint32(MISSPELT) == 0
    n = np.bincount(code[~hit], minlength=len(known))
    n[letters < LEAST_LETTERS] = 0
    some = np.flatnonzero(n)
    words, counts = [known[k] for k in some.tolist()], n[some].tolist()
    hit = np.flatnonzero(hit & (letters[code] > LEAST_LETTERS))
    where, times = np.unique(np.stack([code[hit].astype(np.int64), h[hit].astype(np.int64) % letters[code[hit]]]), axis=1, return_counts=True)
    for c, at, k in zip(*where.tolist(), times.tolist(), strict=True):
        words.append(known[c][:at] + known[c][at + 1 :])
        counts.append(k)
    return words, counts


def word_counts(documents: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of at least LEAST_LETTERS code points that occur at least so often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in slices(batch.column(1), 1 << 22):
                words, counts = _counted(batch.column(0)[at:to].to_pylist(), batch.column(1)[at:to])
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], names=["word", "n"])

    return documents.select("doc_id", "text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# ---- words that meet ----------------------------------------------------------------------------------------


def _keyed(rows: DataFrame) -> DataFrame:
    """rows(word, n, role, lo, hi) with k, which stands for the length of the longer word and its parts before lo and from hi on.

    role 0: the word itself is the longer one, or as long; 1: it is asked for words with one more code point.
    """
    key = F.concat_ws("\x01", F.expr("length(word) + role"), "lo", "hi", F.expr("substring(word, 1, lo)"), F.expr("substring(word, hi + 1 - role)"))
    return rows.withColumn("k", F.xxhash64(key))


def dealt(words: DataFrame, most: int = MOST_GROUP) -> DataFrame:
    """(word, n, role, lo, hi, k): the keys under which words(word, n) meet, each with at most `most` rows or one open position."""
    half = "(length(word) + {0}) div 2"
    places = F.expr("array(" + ", ".join(f"struct({r} AS role, cast({lo} AS int) AS lo, cast({hi} AS int) AS hi)" for r in (0, 1) for lo, hi in (("0", half.format(r)), (half.format(r), f"length(word) + {r}"))) + ")")
    rows = _keyed(words.select("word", "n", F.explode(places).alias("p")).select("word", "n", "p.*"))
    while True:
        hot, path = keep_at(rows.where("hi - lo > 1").groupBy("k").count().where(F.col("count") > most).select("k", F.lit(True).alias("hot")))
        n = hot.count()
        if not n:
            drop(rows.sparkSession, [path])
            return rows
        halves = F.expr("IF(hot, array(struct(lo, (lo + hi) div 2 AS hi), struct((lo + hi) div 2 AS lo, hi)), array(struct(lo, hi)))")
        split = rows.join(F.broadcast(hot) if n <= 1_000_000 else hot, "k", "left").withColumn("hot", F.expr("coalesce(hot, false) AND hi - lo > 1"))
        split = split.select("word", "n", "role", F.explode(halves).alias("p")).select("word", "n", "role", F.col("p.lo").cast("int").alias("lo"), F.col("p.hi").cast("int").alias("hi"))
        rows = _keyed(split)


class WaveletTree:
    """A permutation of 0..n-1 by the bits of its values, highest first; each level keeps how many zeros stand before every place."""

    def __init__(self, values: np.ndarray):
        self.levels = max(1, int(len(values) - 1).bit_length())
        self.zeros = []
        for level in range(self.levels - 1, -1, -1):
            one = (values >> level) & 1 == 1
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]))
            values = np.concatenate([values[~one], values[one]])

    def report(self, at: np.ndarray, to: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rectangle, value) of all values in low <= value < high at places at <= place < to."""
        which, value = np.arange(len(at)), np.zeros(len(at), np.int64)
        for level, zeros in enumerate(self.zeros):
            rest = self.levels - 1 - level
            a, b = zeros[at], zeros[to]
            at, to = np.concatenate([a, at - a + zeros[-1]]), np.concatenate([b, to - b + zeros[-1]])
            which, value = np.concatenate([which, which]), np.concatenate([value * 2, value * 2 + 1])
            some = np.flatnonzero((at < to) & (value << rest < high[which]) & ((value + 1) << rest > low[which]))
            at, to, which, value = at[some], to[some], which[some], value[some]
        return which, value


def _hashes(k: np.ndarray, points: np.ndarray, first: np.ndarray, sizes: np.ndarray, step: int, least: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For each row, hashes of key and the least, least + 1, ... (count of them) first code points, in the direction of step."""
    to = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(int(to[-1]), U64)
    order = np.argsort(-(least + count), kind="stable")
    last = (least + count)[order]
    h = mix(k.astype(U64) + U64(1))
    for size in range(int(last[0]) if len(last) else 0):  # h is that of `size` code points
        active = order[: int(np.searchsorted(-last, -size, "left"))]  # those with least + count > size
        some = active[least[active] <= size]
        out[to[some] + size - least[some]] = h[some]
        more = active[sizes[active] > size]
        h[more] = mix(h[more] * U64(0x9E3779B97F4A7C15) + points[first[more] + step * size])
    return out


def _intervals(keys: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first, beyond last) of the ranks that each distinct key has."""
    order = np.argsort(keys, kind="stable")
    keys, ranks = keys[order], ranks[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.minimum.reduceat(ranks, at) if len(at) else ranks, (np.maximum.reduceat(ranks, at) if len(at) else ranks) + 1


def near_pairs(k: np.ndarray, role: np.ndarray, lo: np.ndarray, hi: np.ndarray, words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row asked, row found) of near words under one key: equally long ones from both sides, others from the shorter one."""
    text = words.to_pylist()
    sizes = np.array([len(w) for w in text], np.int64)
    points = np.frombuffer("".join(text).encode("utf-32-le"), "<u4").astype(U64)
    first = np.cumsum(sizes) - sizes
    count = hi - lo
    prefixes = _hashes(k, points, first, sizes, 1, lo, count)  # of i code points, lo <= i < hi
    # what follows the open position i of the longer word: its length less 1 + i code points, so the most for i = lo
    suffixes = _hashes(~k, points, first + sizes - 1, sizes, -1, sizes + role - hi, count)
    row = np.repeat(np.arange(len(k)), count)
    begin = np.cumsum(count) - count
    place = np.arange(len(row)) - begin[row]
    suffixes = suffixes[begin[row] + count[row] - 1 - place]
    place += lo[row]

    targets = np.flatnonzero(role == 0)
    if not len(targets):
        return
    rank, by = {}, {}
    for name, column in (("ahead", words), ("back", pc.utf8_reverse(words))):
        table = pa.table({"k": pa.array(k[targets]), "w": column.take(pa.array(targets))})
        order = pc.sort_indices(table, [("k", "ascending"), ("w", "ascending")]).to_numpy()
        rank[name] = np.full(len(k), -1)
        rank[name][targets[order]] = np.arange(len(order))
        by[name] = targets[order]
    tree = WaveletTree(rank["back"][by["ahead"]])
    indexed = role[row] == 0
    ahead = _intervals(prefixes[indexed], rank["ahead"][row[indexed]])
    back = _intervals(suffixes[indexed], rank["back"][row[indexed]])
    for start in range(0, len(row), AT_A_TIME):
        part = np.arange(start, min(start + AT_A_TIME, len(row)))
        sides = []
        for (known, least, most), keys in ((ahead, prefixes), (back, suffixes)):
            at = np.minimum(np.searchsorted(known, keys[part]), len(known) - 1)
            # a row that is itself indexed needs another one beside it
            good = (known[at] == keys[part]) & (most[at] - least[at] > (role[row[part]] == 0))
            part, sides, at = part[good], [s[good] for s in sides], at[good]
            sides += [least[at], most[at]]
        which, value = tree.report(*sides)
        asked, found, where = row[part[which]], by["back"][value], place[part[which]]
        other = asked != found
        asked, found, where = asked[other], found[other], where[other]
        sure = np.array([_one_edit(text[a], text[b], i) for a, b, i in zip(asked.tolist(), found.tolist(), where.tolist(), strict=True)], bool)
        yield asked[sure], found[sure]


def _one_edit(a: str, b: str, i: int) -> bool:
    """Whether b is a with another code point at i, or with one more there, and at no later place."""
    if len(a) == len(b):
        return a[:i] == b[:i] and a[i + 1 :] == b[i + 1 :]
    return len(b) == len(a) + 1 and a[:i] == b[:i] and a[i:] == b[i + 1 :] and a[i : i + 1] != b[i]


def _found(k, role, lo, hi, words: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    """(word, n_near, best): for rows with near words, how many, and that of largest n."""
    place = pc.sort_indices(pa.table({"n": pa.array(n), "w": words}), [("n", "descending"), ("w", "ascending")]).to_numpy()
    rank = np.empty(len(n), np.int64)
    rank[place] = np.arange(len(n))
    near, best = np.zeros(len(n), np.int64), np.full(len(n), len(n))
    for asked, found in near_pairs(k, role, lo, hi, words):
        longer = role[asked] == 1
        for a, b in ((asked, found), (found[longer], asked[longer])):
            near += np.bincount(a, minlength=len(n))
            np.minimum.at(best, a, rank[b])
    some = np.flatnonzero(near)
    other = place[best[some]]
    return pa.RecordBatch.from_arrays([words.take(pa.array(some)), pa.array(near[some]), pa.array(-n[other]), words.take(pa.array(other))], names=["word", "n_near", "less", "form"])


def near_words(words: DataFrame, most: int = MOST_GROUP, each: int = EACH) -> DataFrame:
    """(word, n, n_near, near, near_n) of words(word, n): how many are near, and the one of largest n, ties to the smaller word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if rows is not None and rows.num_rows:
            number = lambda c: rows.column(c).to_numpy().astype(np.int64)
            text = rows.column("word").cast(pa.large_string()).combine_chunks()
            out = _found(*(number(c) for c in ("k", "role", "lo", "hi")), text, number("n"))
            yield out.set_column(0, "word", out.column(0).cast(pa.string())).set_column(3, "form", out.column(3).cast(pa.string()))

    rows = dealt(words, most)
    parts = shares(4 * words.count(), each)
    found = rows.repartition(parts, "k").mapInArrow(run, "word string, n_near bigint, less bigint, form string")
    both = words.select("word", "n", F.lit(0).cast("bigint").alias("n_near"), F.lit(None).cast("struct<less:bigint,form:string>").alias("best"))
    both = both.unionByName(found.select("word", F.lit(None).cast("bigint").alias("n"), "n_near", F.struct("less", "form").alias("best")))
    return both.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best")).select("word", "n", "n_near", F.col("best.form").alias("near"), (-F.col("best.less")).alias("near_n"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root): the end of each word's chain of links(word, form), which have no rings."""
    ends, path = keep_at(links.select("word", F.col("form").alias("root")))
    while True:
        on = ends.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        after, new = keep_at(ends.join(on, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("went")))
        drop(links.sparkSession, [path])
        ends, path = after.select("word", "root"), new
        if after.where("went").isEmpty():
            return ends


def variants(documents: DataFrame, least: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root)."""
    words = keep(word_counts(documents, least))
    common = F.col("near_n") >= ratio * F.col("n")
    rows = keep(near_words(words).select("word", "n", "n_near", F.when(common, F.col("near")).alias("form"), F.when(common, F.col("near_n")).alias("form_n")))
    ends = roots(rows.where("form is not null"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
