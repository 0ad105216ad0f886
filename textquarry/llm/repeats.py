"""Operator 10, substring dedup by repeated-phrase automata.

A window (13 consecutive words of one document) that an earlier document, one of smaller doc_id,
also has is removed from the later one. Documents are dealt out once into bounded blocks by a hash;
all later steps find them there, and exchange with each other only packed fingerprints:

1. Anchors. Of each window, the least hash of the 6-word grams in it; equal windows have equal
   anchors, and neighbours mostly share one, so a block has few. Buckets of anchors, ranges of
   hash values, tell each block which of its anchors another block has too.
2. Passages. Windows with such an anchor (or one that two documents of the block have) may recur. Their
   128-bit fingerprints, each once per block with the smallest doc_id there, go to buckets again,
   which confirm those that recur and answer with the smallest doc_id of all.
3. Automata. A block compiles the passages confirmed for its own documents into Aho-Corasick automata
   over words, one for each shard of SHARD_WORDS words of text,
   streams every document through its shard's and removes what an earlier document owns.

A phrase in a third of all documents costs one fingerprint for each block that has it, not one for
each document, so no bucket has a hot key; no pairs are formed. A block sends rows to those buckets only of which it
holds a hash. What the bucket says isn't sent again: of an anchor 32 bits go (more that look alike only make more
candidates), of a window 96, of its owner as many bytes as the ids of a row differ in. Words are known by 128 bits, so are
windows in a block; between blocks the chance that two of n different ones are taken for one is about n * m / 2**97 with m of them in a
bucket, whose size is fixed: under 10**-9 for the 10**13 windows of 100 TB.

Defined results: a null text has no words, and its kept text is null; a null doc_id neither
owns nor loses anything; repeated rows (same doc_id) don't remove each other's words, as neither is
smaller; where several documents tie for the smallest doc_id of a window, none of them loses it; an empty table gives an
empty result; other columns aren't read, or kept whatever their names (`without_repeats`). A text of any length is one
row of one block: it takes about 100 bytes of a task's memory for each of its words.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import keep, shares
from .words import SPACE, U64, find, grams, mix, slices, within

WINDOW = 13
GRAM = 6
BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20
SHARD_WORDS = 1 << 17
ROW_BYTES = 64  # of a row beside its text


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n consecutive numbers."""
    width = 1
    while width * 2 <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (n - width)], x[n - width :]) if n > width else x


class _Block:
    """The words of a block's documents as hashes, and its windows."""

    def __init__(self, table: pa.Table, window: int):
        table = table.combine_chunks()
        self.ids, self.texts, self.window = _whole(table.column("doc_id")), _whole(table.column("text")), window
        counts, one, two = [np.zeros(0, np.int64)], [np.zeros(0, U64)], [np.zeros(0, U64)]
        for a, b in slices(self.texts):
            words = find(self.texts.slice(a, b - a), SPACE)
            for out, x in zip((counts, one, two), (words.counts, *words.hashes128()), strict=True):
                out.append(x)
        self.counts, self.hash, self.other = np.concatenate(counts), np.concatenate(one), np.concatenate(two)
        self.known = ~np.asarray(self.ids.is_null())
        self.doc = self.ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.row = np.repeat(np.arange(len(self.counts), dtype=np.int32), self.counts)
        ok = within(self.counts, window)
        self.at = np.flatnonzero(ok & self.known[self.row[: len(ok)]])  # first words of windows
        gram = min(GRAM, window)
        self.anchors = mix(_least(grams(self.hash, gram), window - gram + 1)[self.at]) if len(self.at) else np.zeros(0, U64)

    def anchor_set(self) -> tuple[np.ndarray, np.ndarray]:
        """Ascending distinct anchors, and whether more than one document of the block has each."""
        row = self.row[self.at]
        run = np.flatnonzero(np.concatenate([[True], (self.anchors[1:] != self.anchors[:-1]) | (row[1:] != row[:-1])])) if len(row) else self.at
        order = run[np.argsort(self.anchors[run], kind="stable")]
        x, row = self.anchors[order], row[order]
        begin = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else order
        last = np.append(begin[1:], len(x))[: len(begin)] - 1
        return x[begin], row[begin] != row[last]

    def candidates(self, answers: pa.Table, buckets: int) -> None:
        """Sets the windows that may recur, and their distinct fingerprints in ascending order."""
        distinct, again = self.anchor_set()
        runs = _Runs(distinct, buckets)
        for bucket, bits in _rows(answers, False, "bucket", "bits"):
            a, b = runs.of(bucket)
            again[a:b] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
        use = again[np.searchsorted(distinct, self.anchors)] if len(distinct) else np.zeros(0, bool)
        self.start = self.at[use]
        self.of = self.row[self.start]
        one, two = grams(self.hash, self.window)[self.start], grams(self.other, self.window)[self.start]
        order = np.lexsort((self.doc[self.of], two, one))
        one, two = one[order], two[order]
        new = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])]) if len(order) else np.zeros(0, bool)
        self.group = np.empty(len(order), np.int64)  # of each candidate, its distinct fingerprint
        self.group[order] = np.cumsum(new) - 1
        self.one, self.two = one[new], two[new]
        self.sample = self.start[order[new]]  # a place of each
        self.least = self.doc[self.of[order[new]]]


def _whole(column: pa.ChunkedArray) -> pa.Array:
    column = column.combine_chunks()
    return (pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)) if isinstance(column, pa.ChunkedArray) else column


class _Runs:
    """The buckets, ranges of hash values, that ascending hashes fall into: only those that hold any."""

    def __init__(self, ascending: np.ndarray, buckets: int):
        bucket = ((ascending >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
        self.begins = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
        self.buckets = bucket[self.begins]
        self.cuts = np.append(self.begins, len(bucket))

    def of(self, bucket: int) -> tuple[int, int]:
        k = int(np.searchsorted(self.buckets, bucket))
        return int(self.cuts[k]), int(self.cuts[k + 1])

    def packed(self, values: np.ndarray) -> pa.Array:
        """The values of each run as bytes."""
        values = np.ascontiguousarray(values)
        return pa.BinaryArray.from_buffers(pa.binary(), len(self.begins), [None, pa.py_buffer((self.cuts * values.itemsize).astype(np.int32)), pa.py_buffer(values)])

    def narrow(self, ids: np.ndarray) -> pa.Array:
        return pa.array([_narrow(ids[a:b]) for a, b in zip(self.cuts[:-1].tolist(), self.cuts[1:].tolist(), strict=True)] if len(ids) else [], pa.binary())


def _narrow(ids: np.ndarray) -> bytes:
    """Some whole numbers in as many bytes each as they differ in, behind the least of them and that width."""
    least = int(ids.min())
    beyond = ids.view(U64) - U64(least % 2**64)
    width = max(1, -(-int(beyond.max()).bit_length() // 8))
    return least.to_bytes(8, "little", signed=True) + bytes([width]) + beyond.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _wide(packed: bytes) -> np.ndarray:
    body = np.frombuffer(packed, np.uint8, offset=9).reshape(-1, packed[8])
    beyond = np.zeros((len(body), 8), np.uint8)
    beyond[:, : packed[8]] = body
    return (beyond.view("<u8").reshape(-1) + U64(int.from_bytes(packed[:8], "little", signed=True) % 2**64)).view(np.int64)


def _table(rows: list[dict], schema: dict) -> pa.Table:
    return pa.table({k: pa.array([r[k] for r in rows], kind) for k, kind in schema.items()})


ANCHORS = {"bucket": pa.int32(), "block": pa.int32(), "one": pa.binary()}
ANSWERS = {"bucket": pa.int32(), "block": pa.int32(), "bits": pa.binary(), "owners": pa.binary()}
PASSAGES = {"bucket": pa.int32(), "block": pa.int32(), "one": pa.binary(), "two": pa.binary(), "owners": pa.binary()}
KEPT = "n_words bigint, n_removed bigint, kept string"


def _ddl(schema: dict) -> str:
    names = {pa.int32(): "int", pa.int64(): "bigint", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"{k} {names[v]}" for k, v in schema.items())


def _number(table: pa.Table, name: str) -> int:
    return table.column(name)[0].as_py()


def _sent(block: int, runs: _Runs, columns: dict[str, pa.Array]) -> pa.Table:
    n = len(runs.buckets)
    return pa.table({"bucket": pa.array(runs.buckets, pa.int32()), "block": pa.array(np.full(n, block), pa.int32())} | columns)


def _low(hashes: np.ndarray) -> np.ndarray:
    """The lower half of each; the bucket is told by the upper one."""
    return hashes.astype(np.uint32)


def _send_anchors(window: int, buckets: int):
    def send(table: pa.Table) -> pa.Table:
        distinct, _ = _Block(table, window).anchor_set()
        runs = _Runs(distinct, buckets)
        return _sent(_number(table, "block"), runs, {"one": runs.packed(_low(distinct))})

    return send


def _joined(table: pa.Table, name: str, kind) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.frombuffer(x.as_buffer(), kind) for x in table.column(name)]
    return np.concatenate(parts), np.cumsum([len(x) for x in parts])[:-1]


def _answer_anchors(table: pa.Table) -> pa.Table:
    one, ends = _joined(table, "one", np.uint32)
    x = np.sort(one)
    twice = np.unique(x[1:][x[1:] == x[:-1]])  # a block sends each once, but for those that only look alike
    at = np.minimum(np.searchsorted(twice, one), max(0, len(twice) - 1))
    shared = twice[at] == one if len(twice) else np.zeros(len(one), bool)
    rows = zip(table.column("bucket").to_pylist(), table.column("block").to_pylist(), np.split(shared, ends), strict=True)
    return _table([{"bucket": b, "block": k, "bits": np.packbits(s).tobytes(), "owners": None} for b, k, s in rows if s.any()], ANSWERS)


def _rows(answers: pa.Table, owners: bool, *names: str) -> list[tuple]:
    """The answers about owners, or those about anchors."""
    rows = answers.filter(pc.is_valid(answers.column("owners")) if owners else pc.is_null(answers.column("owners")))
    return list(zip(*(rows.column(k).to_pylist() for k in names), strict=True))


def _send_passages(window: int, buckets: int):
    def send(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _table([], PASSAGES)
        block = _Block(docs, window)
        block.candidates(answers, buckets)
        runs = _Runs(block.one, buckets)
        return _sent(_number(docs, "block"), runs, {"one": runs.packed(_low(block.one)), "two": runs.packed(block.two), "owners": runs.narrow(block.least)})

    return send


def _answer_passages(table: pa.Table) -> pa.Table:
    one, ends = _joined(table, "one", np.uint32)
    two, least = _joined(table, "two", U64)[0], np.concatenate([_wide(x.as_py()) for x in table.column("owners")])
    order = np.lexsort((least, two, one))
    a, b = one[order], two[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    owner = np.empty(len(order), np.int64)
    owner[order] = least[order[new]][np.cumsum(new) - 1]
    rows = zip(table.column("bucket").to_pylist(), table.column("block").to_pylist(), np.split(owner, ends), np.split(owner < least, ends), strict=True)
    return _table([{"bucket": n, "block": k, "bits": np.packbits(s).tobytes(), "owners": _narrow(o[s])} for n, k, o, s in rows if s.any()], ANSWERS)


def _spelled(codes: np.ndarray, base: int) -> str:
    """Word numbers as two letters each, high and low, of alphabets that don't meet.

    The automata's nodes find their children one by one, so a letter for each word would be slow.
    """
    return np.stack([0x100 + codes // base, 0x2000 + codes % base], axis=-1).astype("<u4").tobytes().decode("utf-32-le")


def _removed(block: _Block, owner: np.ndarray) -> np.ndarray:
    """Of each word of the block, whether an automaton found it in a passage owned by an earlier document."""
    later = owner[block.group] < block.doc[block.of]  # of each candidate, whether its passage matters here
    first = np.concatenate([[0], np.cumsum(block.counts)])
    edge = np.zeros(first[-1] + 1, np.int64)
    rows, n = np.arange(len(block.counts)), block.window
    shard = first[:-1] // SHARD_WORDS
    for s in np.unique(shard):
        own = rows[shard == s]
        a, b = np.searchsorted(block.of, [own[0], own[-1] + 1])  # candidates are in order of place
        passages = np.unique(block.group[a:b][later[a:b]])
        if not len(passages):
            continue
        words = block.hash[block.sample[passages][:, None] + np.arange(n)]
        known, words = np.unique(words, return_inverse=True)
        base = int(len(known) ** 0.5) + 1
        spelled = _spelled(words.reshape(-1), base)
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, p in enumerate(passages.tolist()):
            automaton.add_word(spelled[2 * n * k : 2 * n * (k + 1)], p)
        automaton.make_automaton()
        text = block.hash[first[own[0]] : first[own[-1] + 1]]
        at = np.minimum(np.searchsorted(known, text), len(known) - 1)
        text = _spelled(np.where(known[at] == text, at, len(known)), base)
        for r in own.tolist():
            if block.counts[r] < n or not block.known[r]:
                continue
            found = list(automaton.iter(text[2 * (first[r] - first[own[0]]) : 2 * (first[r + 1] - first[own[0]])]))
            if found:
                ends, which = np.array(found, np.int64).T
                ends = ends[owner[which] < block.doc[r]] // 2 + first[r]
                np.add.at(edge, ends - n + 1, 1)
                np.add.at(edge, ends + 1, -1)
    return np.cumsum(edge)[:-1] > 0


def _strip(window: int, buckets: int, rest: bool, untouched: bool):
    def strip(docs: pa.Table, answers: pa.Table) -> pa.Table:
        block = _Block(docs, window)
        block.candidates(answers, buckets)
        owner, runs = block.least.copy(), _Runs(block.one, buckets)
        for bucket, owners, bits in _rows(answers, True, "bucket", "owners", "bits"):
            a, b = runs.of(bucket)
            owner[a:b][np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)] = _wide(owners)
        gone = _removed(block, owner)
        first = np.concatenate([[0], np.cumsum(block.counts)])
        removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[first])
        kept = []
        for a, b in slices(block.texts):
            if untouched and not removed[a:b].any():
                kept.append(block.texts.slice(a, b - a).cast(pa.string()))
                continue
            words = find(block.texts.slice(a, b - a), SPACE)
            stay = ~gone[first[a] : first[b]]
            sizes = words.ends - words.starts + 1
            data = words.data[np.repeat(stay, sizes)].tobytes()
            total = np.concatenate([[0], np.cumsum(sizes * stay)])[words.first]
            part = [data[x : max(x, y - 1)].decode() for x, y in zip(total[:-1], total[1:], strict=True)]
            if untouched:
                part = [t if r else x.as_py() for t, r, x in zip(part, removed[a:b].tolist(), block.texts.slice(a, b - a), strict=True)]
            kept.append(pa.array(part, pa.string(), mask=np.asarray(block.texts.slice(a, b - a).is_null())))
        own = {"doc_id": block.ids, "n_words": pa.array(block.counts), "n_removed": pa.array(removed.astype(np.int64)), "kept": pa.chunked_array(kept, pa.string())}
        return pa.table(({"rest": docs.column("rest")} if rest else {}) | own)

    return strip


def _dealt(docs: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """docs with `block`, by a hash of the row, and their bytes.

    Rows that repeat beyond a block's bytes are written out first and dealt by their numbers, so that no block holds them all.
    """
    sizes = docs.groupBy(F.xxhash64("doc_id", "text")).agg(F.sum(F.octet_length("text")).alias("n"), F.count("*").alias("rows"))
    size, hot = sizes.agg(F.sum("n"), F.max(F.when(F.col("rows") > 1, F.greatest("n", F.col("rows") * ROW_BYTES)))).first()
    blocks = shares(size or 0, block_bytes)
    key = [F.col("doc_id"), F.col("text")]
    if (hot or 0) > block_bytes:
        docs = keep(docs)
        key.append(F.monotonically_increasing_id())
    return docs.withColumn("block", F.pmod(F.xxhash64(*key), F.lit(blocks)).cast("int")), size or 0


def remove_repeats(documents: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, rest: bool = False, untouched: bool = False) -> DataFrame:
    """Per row of documents: doc_id, n_words, n_removed, kept; before them, with `rest`, a struct of all columns but text.

    kept has the kept words joined by one space; with `untouched`, texts that lose nothing stay as they are.
    """
    own = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    docs, size = _dealt(documents.select(*own, *([F.struct(*(c for c in documents.columns if c != "text")).alias("rest")] if rest else [])), block_bytes)
    buckets = shares(size, BUCKET_BYTES)
    dealt = docs.groupBy("block")
    anchors = dealt.applyInArrow(_send_anchors(window, buckets), _ddl(ANCHORS))
    shared = anchors.groupBy("bucket").applyInArrow(_answer_anchors, _ddl(ANSWERS))
    passages = dealt.cogroup(shared.groupBy("block")).applyInArrow(_send_passages(window, buckets), _ddl(PASSAGES))
    owners = passages.groupBy("bucket").applyInArrow(_answer_passages, _ddl(ANSWERS))
    schema = T.StructType([*([docs.schema["rest"]] if rest else []), docs.schema["doc_id"], *T.StructType.fromDDL(KEPT)])
    return dealt.cogroup(shared.unionByName(owners).groupBy("block")).applyInArrow(_strip(window, buckets, rest, untouched), schema)


def without_repeats(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with what an earlier one has removed from text, and n_chars, if there is one, set anew; all columns stay."""
    out = remove_repeats(documents, window, rest=True, untouched=True)
    own = {"text": F.col("kept").cast(documents.schema["text"].dataType)}
    if "n_chars" in documents.columns:
        own["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("rest.n_chars")).cast(documents.schema["n_chars"].dataType)
    return out.select(*((own[c] if c in own else F.col("rest")[c]).alias(c) for c in documents.columns))


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))
