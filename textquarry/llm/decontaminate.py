"""Operator 3, benchmark decontamination by a distributed positional inverted index.

`build_index` stores the postings of the training texts: a row for each bounded block of
documents, with the block's terms and, term by term, the ascending word positions at which they
stand (position lists one after another, `ends` telling where each ends). An index is thus dealt
out by document, so building and searching it moves no rows between executors.

`search_index` looks each test window up in each block: its terms are ordered by the length of
their position lists, the rarest list gives the first candidates, and each next list, moved by the
term's offset in the window, is intersected with what is left. What stands after the last list
is an exact phrase match; there is no hashing, so no second check is needed. Windows don't cross
documents: a word position of each document's end is left free.

`proximity` needs all terms of a short item within `span` words, in any order.

The test items are held in blocks of at most MOST_ITEM_BYTES (or one item); each is sent to the executors alone, and
its distinct windows once, however many items have them, so their size is bounded whatever the size of the benchmark. With
more than one block the index is stored, searched for each, and the matches put together by the index row's name
and the document's place in it.

Defined results: a null text has no words; empty items match nothing; repeated rows are judged
alike; an empty table gives an empty result; only doc_id, text, item_id are read, so further
columns can't clash; items of one item_id are one item; items of null item_id hit words, but are left out of `items` and their
number; terms of equally long lists are taken in the window's order, which changes no result. A text of any length is
one row of the index: building and searching it takes about 60 bytes of a task's memory for each of its words.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import keep, row_key, without
from .words import SIGNS, find, slices

WINDOW = 10
BLOCK_BYTES = 4 << 20
MOST_ITEM_BYTES = 8 << 20
#: ends and positions are little-endian 32-bit numbers.
INDEX = "name string, doc_ids array<bigint>, counts array<int>, terms array<string>, ends binary, positions binary"


def _flat(column: pa.Array, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)


def _numbers(column: pa.Array, kind) -> np.ndarray:
    return np.frombuffer(column[0].as_buffer(), np.int32).astype(kind, copy=False)


def _index_block(doc_ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    words = find(texts, SIGNS, lower=True)
    coded = words.coded()
    terms = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(terms, kind="stable").astype(np.int32)
    position = np.arange(len(terms), dtype=np.int32) + words.row.astype(np.int32)  # one is free between documents
    ends = np.cumsum(np.bincount(terms, minlength=len(coded.dictionary))).astype(np.int32)
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    arrays = [
        pa.array([uuid.uuid4().hex]),
        one(doc_ids.cast(pa.int64())),
        one(pa.array(words.counts, pa.int32())),
        one(coded.dictionary.cast(pa.string())),
        pa.array([ends.tobytes()], pa.binary()),
        pa.array([position[order].tobytes()], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(arrays, names=["name", "doc_ids", "counts", "terms", "ends", "positions"])


def build_index(documents: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The positional index of all documents (INDEX gives its columns); it can be stored as it is."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1), block_bytes):
                yield _index_block(batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a))

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(build, INDEX)


class _Block:
    """Position lists of one row of an index."""

    def __init__(self, terms: pa.Array, ends: np.ndarray, positions: np.ndarray):
        self.terms, self.positions = terms, positions
        self.begins = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else np.zeros(0, np.int64)
        self.sizes = ends - self.begins
        self.width = int(positions.max()) + 64 if len(positions) else 64
        self.keys = np.repeat(np.arange(len(ends), dtype=np.int64), self.sizes) * self.width + positions  # ascending

    def numbers(self, words: pa.Array) -> np.ndarray:
        found = pc.index_in(words, value_set=self.terms)
        return pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def lists(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The position lists of some terms, one after another, and which of the terms each is of."""
        sizes = self.sizes[terms]
        owner = np.repeat(np.arange(len(terms)), sizes)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + self.begins[terms][owner]
        return self.positions[at].astype(np.int64), owner

    def has(self, terms: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """Whether each position is in the list of the term beside it."""
        key = terms * self.width + positions
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return (positions >= 0) & (positions < self.width) & (self.keys[at] == key)


def _phrases(block: _Block, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows (rows of term numbers, -1 not in the block, -2 past the end) found, and where."""
    use = np.flatnonzero(~(windows == -1).any(1)) if len(block.keys) else np.zeros(0, np.int64)
    if not len(use):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    w = windows[use]
    sizes = np.where(w == -2, np.iinfo(np.int64).max, block.sizes[np.maximum(w, 0)])
    by_size = np.argsort(sizes, axis=1, kind="stable")
    start, owner = block.lists(w[np.arange(len(w)), by_size[:, 0]])
    start = start - by_size[owner, 0]
    for k in range(1, w.shape[1]):
        offset = by_size[owner, k]
        term = w[owner, offset]
        ok = (term == -2) | block.has(np.maximum(term, 0), start + offset)
        start, owner = start[ok], owner[ok]
    return use[owner], start


def _near(spots: list[np.ndarray], span: int) -> bool:
    """Whether one position of each ascending list lies within some span words."""
    spots = sorted(spots, key=len)
    starts = np.unique(spots[0][:, None] - np.arange(span))  # each span that has the rarest term
    for s in spots[1:]:
        at = np.searchsorted(s, starts)
        starts = starts[(at < len(s)) & (s[np.minimum(at, len(s) - 1)] < starts + span)]
    return len(starts) > 0


class _Items:
    """Distinct windows of some test items, as numbers of their own words, and the items that have each."""

    def __init__(self, ids: list, texts: list, window: int):
        words = find(pa.array(texts, pa.string()), SIGNS, lower=True)
        coded = words.coded()
        self.words = coded.dictionary.cast(pa.string())
        numbers = np.append(coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), np.int32(-2))
        self.names = sorted({i for i in ids if i is not None})
        name = {x: k for k, x in enumerate(self.names)}
        self.name = np.array([name.get(i, -1) for i in ids], np.int64)  # of each item
        self.first, self.numbers = words.first, numbers
        size = np.minimum(words.counts, window)
        n = np.where(words.counts > 0, words.counts - size + 1, 0)
        item = np.repeat(np.arange(len(n)), n)
        start = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n) + words.first[:-1][item]
        at = start[:, None] + np.arange(window)
        rows = numbers[np.where(np.arange(window) < size[item][:, None], at, len(numbers) - 1)].reshape(-1, window)
        self.windows, which = np.unique(rows, axis=0, return_inverse=True) if len(rows) else (rows, np.zeros(0, np.int64))
        self.lengths = (self.windows >= 0).sum(1)
        pairs = np.unique(which.reshape(-1) * (len(self.names) + 1) + self.name[item] + 1) if len(rows) else np.zeros(0, np.int64)
        pairs = pairs[pairs % (len(self.names) + 1) > 0]
        self.having = pairs % (len(self.names) + 1) - 1  # names, window by window
        self.begins = np.searchsorted(pairs // (len(self.names) + 1), np.arange(len(self.windows) + 1))

    def of(self, block: _Block) -> np.ndarray:
        numbers = np.concatenate([block.numbers(self.words), [-2]])
        return numbers[np.where(self.windows < 0, len(numbers) - 1, self.windows)]

    def named(self, windows: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, name) of the items of the windows found in rows, distinct and in order."""
        n = len(self.windows) + 1
        pairs = np.unique(rows * n + windows)
        row, window = pairs // n, pairs % n
        size = self.begins[window + 1] - self.begins[window]
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.begins[window], size)
        pairs = np.unique(np.repeat(row, size) * (len(self.names) + 1) + self.having[at])
        return pairs // (len(self.names) + 1), pairs % (len(self.names) + 1)


def _item_blocks(items: DataFrame) -> Iterator[tuple[list, list]]:
    """Items in a fixed order, in blocks of at most MOST_ITEM_BYTES (or one item)."""
    ids, texts, size = [], [], 0
    # a repeated row adds no window
    for row in items.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).where("t is not null").distinct().orderBy("i", "t").toLocalIterator():
        n = len(row.t.encode())
        if ids and size + n > MOST_ITEM_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row.i)
        texts.append(row.t)
        size += n
    yield ids, texts


#: place: of the document in its row of the index; hits: numbers of the words hit, from 0.
MATCHES = "name string, place int, doc_id bigint, n_words int, hits array<int>, items array<string>"


def _lists(row: np.ndarray, values: pa.Array, n: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32()), values)


def _search(tests: _Items, row: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one row of an index: words of each document; (document, word) of all hits; (document, name) of all items."""
    counts = _flat(row.column("counts"), np.int64)
    block = _Block(row.column("terms").flatten(), _numbers(row.column("ends"), np.int64), _numbers(row.column("positions"), np.int32))
    which, start = _phrases(block, tests.of(block))
    begin = np.cumsum(counts) - counts + np.arange(len(counts))  # of each document, as positions count
    of, names = tests.named(which, np.searchsorted(begin, start, side="right") - 1)
    hits = [np.zeros(0, np.int64)]
    for at in range(0, len(start), 1 << 18):
        n = tests.lengths[which[at : at + (1 << 18)]]
        hits.append(np.unique(np.repeat(start[at : at + (1 << 18)], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)))
    hit = np.unique(np.concatenate(hits))
    doc = np.searchsorted(begin, hit, side="right") - 1
    return counts, doc, hit - begin[doc], of, names


def _searcher(tests: _Items, all_rows: bool = True):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = pa.array(tests.names, pa.string())
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                counts, doc, word, of, names = _search(tests, row)
                n = len(counts)
                name = pa.array([row.column("name")[0].as_py()] * n, pa.string())
                out = [name, pa.array(np.arange(n), pa.int32()), row.column("doc_ids").flatten(), pa.array(counts, pa.int32()), _lists(doc, pa.array(word, pa.int32()), n), _lists(of, strings.take(pa.array(names)), n)]
                found = pa.RecordBatch.from_arrays(out, names=["name", "place", "doc_id", "n_words", "hits", "items"])
                yield found if all_rows else found.filter(pc.greater(pc.list_value_length(found.column("hits")), 0))

    return search


def search_index(index: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row of MATCHES for each document of the index."""
    blocks = _item_blocks(items)
    tests, more = _Items(*next(blocks), window), next(blocks, None)
    if more is None:
        return index.mapInArrow(_searcher(tests), MATCHES)
    index = keep(index)
    found = keep(index.mapInArrow(_searcher(tests), MATCHES))
    while more is not None:
        found = found.unionByName(keep(index.mapInArrow(_searcher(_Items(*more, window), False), MATCHES)))
        more = next(blocks, None)
    all_of = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)  # noqa: E731 - of one document
    return found.groupBy("name", "place").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), all_of("hits"), all_of("items"))


def proximity(index: DataFrame, items: DataFrame, span: int = 20) -> DataFrame:
    """(doc_id, item_id): items whose terms all stand within `span` words of a document, in any order; a row for each document and item."""
    out = None
    for ids, texts in _item_blocks(items):
        tests = _Items(ids, texts, 1)
        wanted = [(tests.names[tests.name[i]] if tests.name[i] >= 0 else None, np.unique(tests.numbers[a:b])) for i, (a, b) in enumerate(zip(tests.first[:-1], tests.first[1:], strict=True)) if b > a]

        def search(batches: Iterator[pa.RecordBatch], words: pa.Array = tests.words, wanted: list = wanted) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    row = batch.slice(k, 1)
                    doc_ids, counts = row.column("doc_ids").flatten(), _flat(row.column("counts"), np.int64)
                    block = _Block(row.column("terms").flatten(), _numbers(row.column("ends"), np.int64), _numbers(row.column("positions"), np.int32))
                    number, begin = block.numbers(words), np.cumsum(counts) - counts + np.arange(len(counts))
                    docs, names = [], []
                    for item, own in wanted:
                        terms = number[own]
                        if (terms < 0).any():
                            continue
                        spots = [block.positions[block.begins[t] : block.begins[t] + block.sizes[t]].astype(np.int64) for t in terms]
                        of = [np.searchsorted(begin, s, side="right") - 1 for s in spots]
                        both = functools.reduce(np.intersect1d, of[1:], np.unique(of[0]))  # documents that have all terms
                        cut = [(np.searchsorted(o, both), np.searchsorted(o, both, side="right")) for o in of]
                        for j, d in enumerate(both.tolist()):
                            if _near([s[a[j] : b[j]] for s, (a, b) in zip(spots, cut, strict=True)], span):
                                docs.append(d)
                                names.append(item)
                    yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(docs, pa.int64())), pa.array(names, pa.string())], names=["doc_id", "item_id"])

        part = index.mapInArrow(search, "doc_id bigint, item_id string")
        out = part if out is None else out.unionByName(part)
    return out


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return search_index(build_index(documents), benchmark, window).select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def clean(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that no window of the benchmark stands in, with all columns.

    With one block of items, each block of documents is indexed, searched and left; with more, the stored index tells
    the rows that go, by 64 bits of each (the chance that a clean one goes as well is the hit rows times all rows over 2**64).
    """
    blocks = _item_blocks(benchmark)
    tests, more = _Items(*next(blocks), window), next(blocks, None)
    if more is not None:
        k1, k2 = row_key(documents)
        hit = search_index(build_index(documents.select(k1.alias("doc_id"), "text")), benchmark, window).where("size(hits) > 0").select(F.col("doc_id").alias("k1")).distinct()
        keys = documents.select(k1.alias("k1"), k2.alias("k2")).join(hit, "k1", "left_semi")
        return without(documents, keep(keys.distinct()))
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = pc.cast(batch.column(at), pa.string())
            for a, b in slices(column, BLOCK_BYTES):
                counts, doc, *_ = _search(tests, _index_block(pa.array(np.arange(a, b)), column.slice(a, b - a)))
                yield batch.slice(a, b - a).filter(pa.array(np.bincount(doc, minlength=len(counts)) == 0))

    return documents.mapInArrow(run, documents.schema)
