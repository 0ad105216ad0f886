"""Operator 1, edit-aware token counts by segment trees over pre-tokens.

A byte-pair tokenizer cuts a text into pre-tokens by a pattern and encodes each alone, so a text's
count is a sum. `build` keeps, for each document, leaves of LEAF pre-tokens each and segment trees of their
characters and tokens. `apply_edits` takes a document's edits in turn: it finds the first leaf by descending
the tree of characters, encodes again from that leaf's start until a boundary of the new text meets a
later leaf's, and updates the sums above the leaves that changed; where more leaves are needed than there were, the new ones are
put between the others and the trees' sums are added up anew. Nothing else is encoded again, however long the edit.

Why that is exact: the pattern looks at nothing before a pre-token and at most CONTEXT characters behind
it, so pre-tokens that end that far before the edit stand, and after a boundary common to old and new
text beyond the edit all others do.

Counts of pre-tokens are remembered in each worker, KNOWN of them at most; the tokenizer's ranks, read once on
the driver from `ranks_path`, are sent to the executors (their size is that of the vocabulary).

Defined results: a null text counts as empty and stays null unless it is edited; edits beyond the text's
end are cut to it, and one whose start is after its end or null is left out; a null replacement deletes;
rows are independent, so repeated rows, null ids, ties and clashing names change nothing; an empty
table gives an empty result; a text of any length is one row, whose pre-tokens (about 60 bytes each) a task holds one text at a time.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern that belongs to the rank files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTEXT = 2
LEAF = 32
KNOWN = 300_000
STATE = "chars array<int>, pieces array<int>, tokens array<int>"
EDITS = "array<struct<start: int, end: int, replacement: string>>"


@cache
def _pattern() -> regex.Pattern:
    return regex.compile(PATTERN)


class Counter(dict):
    """Tokens of each pre-token, encoded on first use."""

    def __init__(self, ranks: bytes):
        super().__init__()
        import tiktoken

        pairs = (line.split() for line in ranks.splitlines() if line)
        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})._core_bpe.encode_single_piece

    def __missing__(self, piece: str) -> int:
        n = len(self.encode(piece.encode("utf-8", "replace")))
        if len(self) >= KNOWN:
            self.clear()
        self[piece] = n
        return n


@cache
def _counter(ranks: bytes) -> Counter:
    return Counter(ranks)


class Tree:
    """Sums over leaves, as a heap: node k has children 2k and 2k + 1."""

    def __init__(self, leaves: list[int]):
        self.width = 1 << max(0, len(leaves) - 1).bit_length()
        self.sums = [0] * self.width + leaves + [0] * (self.width - len(leaves))
        for k in range(self.width - 1, 0, -1):
            self.sums[k] = self.sums[2 * k] + self.sums[2 * k + 1]

    def total(self) -> int:
        return self.sums[1]

    def set(self, leaf: int, value: int) -> None:
        k = leaf + self.width
        change = value - self.sums[k]
        while k:
            self.sums[k] += change
            k >>= 1

    def find(self, position: int) -> tuple[int, int]:
        """The leaf that holds a position, and where it begins."""
        k, at = 1, 0
        while k < self.width:
            k *= 2
            if at + self.sums[k] <= position:
                at += self.sums[k]
                k += 1
        return k - self.width, at


def leaves(text: str, count: Counter, start: int = 0, size: int = LEAF) -> tuple[list[int], list[int], list[int]]:
    """Characters, pre-tokens and tokens of each leaf of the text."""
    pieces = _pattern().findall(text, start)
    return _leaves(list(map(len, pieces)), list(map(count.__getitem__, pieces)), size)


def _leaves(chars: list[int], tokens: list[int], size: int = LEAF) -> tuple[list[int], list[int], list[int]]:
    parts = range(0, len(chars), size)
    return [sum(chars[k : k + size]) for k in parts], [len(chars[k : k + size]) for k in parts], [sum(tokens[k : k + size]) for k in parts]


class Document:
    def __init__(self, text: str | None, chars: list[int], pieces: list[int], tokens: list[int]):
        self.text, self.pieces = text, list(pieces)
        self.chars, self.tokens, self.encoded = Tree(list(chars)), Tree(list(tokens)), 0

    def edit(self, start: int | None, end: int | None, new: str | None, count: Counter) -> None:
        if start is None or end is None or start > end or start < 0:
            return
        old = self.text or ""
        start, end = min(start, len(old)), min(end, len(old))
        self.text = text = old[:start] + (new or "") + old[end:]
        moved = len(text) - len(old)
        if not self.chars.total():
            self._rebuild(count)
            return
        first, at = self.chars.find(min(max(0, start - CONTEXT), max(0, len(old) - 1)))
        last, bound = first, at + self.chars.sums[self.chars.width + first]
        while bound < end and last + 1 < len(self.pieces):
            last += 1
            bound += self.chars.sums[self.chars.width + last]
        to, sizes, tokens = at, [], []
        for match in _pattern().finditer(text, at):
            to = match.end()
            sizes.append(to - match.start())
            tokens.append(count[match[0]])
            while to > bound + moved and last + 1 < len(self.pieces):
                last += 1
                bound += self.chars.sums[self.chars.width + last]
            if to == bound + moved and bound >= end:
                break
        self.encoded += len(sizes)
        self._replace(first, last + 1, _leaves(sizes, tokens))

    def _replace(self, first: int, end: int, new: tuple[list[int], list[int], list[int]]) -> None:
        """Puts new leaves in the place of those from first to end: sums alone change, nothing is encoded."""
        more = end - first - len(new[0])
        if more >= 0:  # leaves that are no longer needed stay, empty
            for k, (n, pieces, tokens) in enumerate(zip(*(x + [0] * more for x in new), strict=True), first):
                self.chars.set(k, n)
                self.tokens.set(k, tokens)
                self.pieces[k] = pieces
        else:
            n = len(self.pieces)
            chars, tokens = (tree.sums[tree.width :][:n] for tree in (self.chars, self.tokens))
            self.chars, self.tokens = Tree([*chars[:first], *new[0], *chars[end:]]), Tree([*tokens[:first], *new[2], *tokens[end:]])
            self.pieces[first:end] = new[1]

    def _rebuild(self, count: Counter) -> None:
        chars, self.pieces, tokens = leaves(self.text or "", count)
        self.chars, self.tokens = Tree(chars), Tree(tokens)
        self.encoded += sum(self.pieces)

    def state(self) -> tuple[list[int], list[int], list[int]]:
        n = len(self.pieces)
        return self.chars.sums[self.chars.width :][:n], self.pieces, self.tokens.sums[self.tokens.width :][:n]


def _ranks(ranks_path: str) -> bytes:
    return Path(ranks_path).read_bytes()


def _lists(rows: list[list[int]]) -> pa.Array:
    return pa.array(rows, pa.list_(pa.int32()))


def build(documents: DataFrame, ranks_path: str = RANKS) -> DataFrame:
    """All columns of documents, then the leaves of each text (STATE)."""
    sent = documents.sparkSession.sparkContext.broadcast(_ranks(ranks_path))
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(sent.value)
        for batch in batches:
            found = [leaves(t.as_py() or "", count) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(_lists([f[k] for f in found]) for k in range(3))], names=[*batch.schema.names, "chars", "pieces", "tokens"])

    return documents.mapInArrow(run, T.StructType([*documents.schema, *T.StructType.fromDDL(STATE)]))


def apply_edits(state: DataFrame, ranks_path: str = RANKS) -> DataFrame:
    """state with a column `edits` (EDITS): text and leaves as edited, and how many pre-tokens were encoded again."""
    sent = state.sparkSession.sparkContext.broadcast(_ranks(ranks_path))
    own = ("text", "chars", "pieces", "tokens", "edits")
    others = [c for c in state.columns if c not in own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(sent.value)
        for batch in batches:
            done, encoded = [], []
            for text, chars, pieces, tokens, edits in zip(*(batch.column(c) for c in own), strict=True):
                doc = Document(text.as_py(), chars.as_py(), pieces.as_py(), tokens.as_py())
                for e in edits.as_py() or ():
                    if e:
                        doc.edit(e["start"], e["end"], e["replacement"], count)
                done.append((doc.text, *doc.state()))
                encoded.append(doc.encoded)
            text = pa.array([d[0] for d in done], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), text, *(_lists([d[k] for d in done]) for k in (1, 2, 3)), pa.array(encoded, pa.int64())], names=[*others, *own[:4], "encoded"])

    schema = T.StructType([*(state.schema[c] for c in others), *T.StructType.fromDDL(f"text string, {STATE}, encoded bigint")])
    return state.select(*others, *own).mapInArrow(run, schema)


def sample_edits() -> F.Column:
    """A few edits that follow from the text: one in its middle, one near its start, one at its end."""
    n = F.length("text")
    e = lambda a, b, c: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), F.lit(c).alias("replacement"))
    return F.when(F.col("text").isNotNull(), F.array(e(n / 2, n / 2 + 7, " edited §12 here"), e(n / 5, n / 5 + 3, ""), e(n + 16, n + 16, "  The end.")))


def _sum(name: str) -> F.Column:
    return F.aggregate(name, F.lit(0).cast("long"), lambda a, x: a + x)


def counts(documents: DataFrame, ranks_path: str = RANKS) -> DataFrame:
    """doc_id, n_pretokens, n_tokens as the text is, n_tokens_edited after sample_edits, n_encoded again for that."""
    state = build(documents.select("doc_id", F.col("text").cast("string").alias("text")), ranks_path)
    state = state.select("*", _sum("pieces").alias("n_pretokens"), _sum("tokens").alias("n_tokens"), sample_edits().alias("edits"))
    return apply_edits(state, ranks_path).select("doc_id", "n_pretokens", "n_tokens", _sum("tokens").alias("n_tokens_edited"), F.col("encoded").alias("n_encoded"))
