"""Words of whole Arrow text columns, found with numpy over their UTF-8 bytes.

Every separator class used here is a set of ASCII bytes, so a byte-wise search finds exactly the
words that a code-point-wise pattern would (bytes of longer UTF-8 sequences are all over 0x7F).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
#: Separators of `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
SIGNS = np.zeros(256, bool)
SIGNS[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_STEP = U64(0xD6E8FEB86659FD93)
_TAIL = np.array([0, *(2 ** (8 * k) - 1 for k in range(1, 9))], U64)  # the first k of eight bytes
LONG = 64


@dataclass
class Words:
    """Words of some texts: `data` holds them lower-cased if asked, each followed by one space."""

    data: np.ndarray  # uint8
    starts: np.ndarray  # int64, into data
    ends: np.ndarray
    counts: np.ndarray  # words of each text

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def row(self) -> np.ndarray:
        """Of each word, the number of its text."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    @property
    def first(self) -> np.ndarray:
        """Number of each text's first word, and of all words at the end."""
        return np.concatenate([[0], np.cumsum(self.counts)])

    def strings(self) -> pa.Array:
        lengths = self.ends - self.starts
        keep = np.ones(len(self.data), bool)
        keep[self.ends] = False
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(self.data[keep]))

    def coded(self) -> pa.DictionaryArray:
        """Of each word the number of its distinct word, and these."""
        return self.strings().dictionary_encode()

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return self.hashes128()[0]

    def hashes128(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each word's bytes: chains over groups of eight, each step a bijection (XXH3 beyond LONG bytes)."""
        sizes = self.ends - self.starts
        one, two = mix(sizes.astype(U64)), mix(sizes.astype(U64) ^ _STEP)
        whole = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(whole) - 7, "<u8", whole, strides=(1,))
        some = np.flatnonzero(sizes <= LONG)
        for k in range(0, LONG, 8):
            some = some[sizes[some] > k]
            if not len(some):
                break
            part = eight[self.starts[some] + k] & _TAIL[np.minimum(sizes[some] - k, 8)]
            one[some], two[some] = mix(one[some] ^ part), mix((two[some] + part) * _STEP)
        for i in np.flatnonzero(sizes > LONG).tolist():
            x = xxhash.xxh3_128_intdigest(self.data[self.starts[i] : self.ends[i]].tobytes())
            one[i], two[i] = x & 2**64 - 1, x >> 64
        return one, two


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 (fixed values), a bijection of 64-bit numbers."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls count as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def find(column: pa.Array | pa.ChunkedArray, separators: np.ndarray, lower: bool = False) -> Words:
    data, offsets = utf8(column)
    n = len(offsets) - 1
    data = np.insert(data, offsets[1:], 0x0A)  # so that each text ends with a separator
    if lower:
        data = LOWER[data]
    apart = separators[data]
    edge = np.diff(apart.view(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    bounds = np.searchsorted(starts, offsets + np.arange(n + 1))
    keep = ~apart
    keep[ends] = True
    data[ends] = 0x20
    lengths = ends - starts
    after = np.cumsum(lengths + 1)
    return Words(data[keep], after - lengths - 1, after - 1, np.diff(bounds))


def grams(x: np.ndarray, n: int) -> np.ndarray:
    """Of a sequence of 64-bit numbers, a hash of each n consecutive ones; n <= 16."""
    if len(x) < n:
        return np.zeros(0, U64)
    parts, width, at, out = {1: x}, 1, 0, None
    while width * 2 <= n:
        x = parts[width]
        parts[width * 2] = x[: len(x) - width] * _power(width) + x[width:]
        width *= 2
    for size in sorted(parts, reverse=True):
        if n - at >= size:
            piece = parts[size][at:]
            out = piece if out is None else out[: len(piece)] * _power(size) + piece
            at += size
    return mix(out[: len(parts[1]) - n + 1].copy())


def _power(n: int) -> np.uint64:
    return U64(pow(int(_STEP), n, 2**64))


def within(counts: np.ndarray, n: int) -> np.ndarray:
    """For each of the positions 0..total-n, whether n words from there lie in one text."""
    total = int(counts.sum())
    if total < n:
        return np.zeros(0, bool)
    row = np.repeat(np.arange(len(counts)), counts)
    return row[: total - n + 1] == row[n - 1 :]


def slices(column: pa.Array, limit: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most `limit` bytes of text together, or one row."""
    _, offsets = utf8(column)
    at, n = 0, len(column)
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, min(to, n)
        at = to
