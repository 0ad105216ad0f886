"""Operator 4, language identification by rank-order profiles of character n-grams.

A text is lower-cased, each run of letters is a word with one space on either side, and its 1-,
2- and 3-grams (without those of spaces alone) are counted. A language's profile is the ranks of
its PROFILE most frequent n-grams over all of its training texts, a document's that of its DOCUMENT
most frequent. The out-of-place distance adds up how far each of the document's n-grams stands from its
place in the profile, PROFILE for one that is missing; the nearest language is predicted. Ties
fall to the smaller n-gram, and the first language by code point.

Training counts are sums over all training texts, combined in each task before the shuffle; the
profiles, PROFILE n-grams of 8 bytes a language, are the only thing that goes to the driver and back. Long texts are counted in pieces
cut at white space, so a task's memory holds a text, its distinct n-grams, and one piece's.

The score is how much nearer the best profile is than the mean of the others: 1 - best / mean,
between 0 and 1 (1 if there is one language only).

`with_language` rejects what is in none of the learned languages: texts whose distance, as a share of the largest
possible, is beyond a limit. The limit is the largest share among the held-out labelled rows of at least
as many different n-grams (by powers of two, as short texts stand farther off), moved by MARGIN of the way to 1;
texts shorter than all of those have no limit.

Defined results: a text that is null or has no letter is `und` with score 0, as is every text if
nothing was learned (`with_language` then keeps all texts with a letter); only the text is an input of a prediction; rows of null lang teach nothing;
repeated rows count as often as they stand in training; an empty table gives an empty result; other columns aren't
read, or kept whatever their names (`with_language`).
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import slices

PROFILE = 400
DOCUMENT = 400
SLICE = 1 << 18  # bytes of texts looked at together
PIECE = 1 << 18  # characters of a long one
MARGIN = 0.25
_BITS = 21  # of a code point
_SPACE = re.compile(r"\s")
_letter: list[np.ndarray] = []
_number: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letter:
        _letter.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letter[0]


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The letters of some texts, words apart by one 32, as code points; and the text of each."""
    joined = "\0".join(x.replace("\0", " ") if x else "" for x in texts.to_pylist()) + "\0"
    code = np.frombuffer(joined.lower().encode("utf-32-le", "replace"), np.uint32)
    end = code == 0
    text = np.cumsum(end, dtype=np.int32) - end
    letter = _letters()[code]
    # every letter stays, and of a run of others the first; a text that begins with a letter gets one before it
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1] | end[:-1]
    lead = np.concatenate([[0], np.flatnonzero(end)[:-1] + 1])
    lead = lead[letter[lead]]
    at = np.cumsum(keep)[lead] - 1
    code, text = np.where(letter, code, 32)[keep], text[keep]
    return np.insert(code, at, 32), np.insert(text, at, text[at])


def _pieces(text: str) -> Iterator[str]:
    """A long text cut at white space, which no n-gram spans but by its own edges."""
    at = 0
    while at < len(text):
        space = _SPACE.search(text, at + PIECE)
        to = space.start() if space else len(text)
        yield text[at:to]
        at = to


def counted(texts: pa.Array, of: np.ndarray | None = None, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, n-gram, its count) of the n-grams of some texts.

    The owner is the text's number, or of[number]; each distinct n-gram of a text comes once, in order of owner and n-gram,
    but where `of` is given and a text is long. With `most`, the most frequent of each text, in order, and in place of counts their ranks.
    """
    long = np.flatnonzero(pc.fill_null(pc.greater(pc.binary_length(texts), 4 * PIECE), False).to_numpy(zero_copy_only=False)).tolist()
    if not long:
        return _counted(texts, of, most)
    own = np.arange(len(texts)) if of is None else of
    parts, at = [], 0
    for i in [*long, len(texts)]:
        if i > at:
            who, gram, n = _counted(texts.slice(at, i - at), None if of is None else of[at:i], most)
            parts.append((who + at if of is None else who, gram, n))
        if i < len(texts):
            gram, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            for piece in _pieces(texts[i].as_py()):
                _, more, count = _counted(pa.array([piece]), None, None)
                gram, at_ = np.unique(np.concatenate([gram, more]), return_inverse=True)
                n = np.bincount(at_, np.concatenate([n, count]), len(gram)).astype(np.int64)
            if most is not None:
                best = np.lexsort((gram, -n))[:most]
                gram, n = gram[best], np.arange(len(best))
            parts.append((np.full(len(gram), own[i]), gram, n))
        at = i + 1
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _counted(texts: pa.Array, of: np.ndarray | None, most: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As counted, of texts that are looked at together.

    An n-gram is a number of its code points in base 2**21.
    """
    code, text = _words(texts)
    owner = text if of is None else of[text]
    if not _number:
        _number.append(np.zeros(sys.maxunicode + 1, np.uint64))
    number = _number[0]  # all zero between calls
    number[code] = 1
    alphabet = np.flatnonzero(number)
    number[alphabet] = np.arange(1, len(alphabet) + 1)
    small, space = number[code], code == 32
    number[alphabet] = 0
    bits = int(len(alphabet)).bit_length()
    high = int(owner.max(initial=0)).bit_length() + int(3 * len(code)).bit_length()
    if 3 * bits + high > 63 and len(texts) > 1 and of is None:  # many small texts of a large alphabet
        mid = len(texts) // 2
        one, two = _counted(texts.slice(0, mid), None, most), _counted(texts.slice(mid), None, most)
        return np.concatenate([one[0], two[0] + mid]), np.concatenate([one[1], two[1]]), np.concatenate([one[2], two[2]])
    width = np.uint64(3 * bits)
    base = owner.astype(np.uint64) << width
    keys = [(base | small)[~space]]
    pair = (text[:-1] == text[1:]) & ~(space[:-1] & space[1:])
    two = (small[:-1] << np.uint64(bits)) | small[1:]
    keys.append((base[1:] | two)[pair])
    three = (two[:-1] << np.uint64(bits)) | small[2:]
    keys.append((base[2:] | three)[pair[:-1] & pair[1:] & ~space[1:-1]])
    key = np.sort(np.concatenate(keys))
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count, key = np.diff(begin, append=len(key)), key[begin]
    gram, who = key & ((np.uint64(1) << width) - np.uint64(1)), key >> width
    if most is not None and len(key):
        top = int(count.max())
        less = (top - count).astype(np.uint64)
        if 3 * bits + top.bit_length() + int(who.max()).bit_length() <= 64:
            key = np.sort((((who << np.uint64(top.bit_length())) | less) << width) | gram)
            gram, who = key & ((np.uint64(1) << width) - np.uint64(1)), key >> np.uint64(3 * bits + top.bit_length())
        else:
            order = np.lexsort((gram, less, who))
            gram, who = gram[order], who[order]
        first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
        count = np.arange(len(who)) - np.repeat(first, np.diff(first, append=len(who)))
        keep = count < most
        gram, who, count = gram[keep], who[keep], count[keep]
    points = np.concatenate([[0], alphabet]).astype(np.uint64)
    mask, wide = np.uint64((1 << bits) - 1), np.zeros(len(gram), np.uint64)
    for k in (2, 1, 0):
        wide = (wide << np.uint64(_BITS)) | points[(gram >> np.uint64(k * bits)) & mask]
    return who.astype(np.int64), wide, count


def train(documents: DataFrame, size: int = PROFILE) -> list[tuple[str, np.ndarray]]:
    """The profile of each language of documents(text, lang): its most frequent n-grams, in order."""
    rows = documents.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            code, names = langs.indices.to_numpy(zero_copy_only=False), langs.dictionary
            sums = [counted(batch.column(1).slice(a, b - a), code[a:b]) for a, b in slices(batch.column(1), SLICE)]
            if sums:
                lang, gram, n = (np.concatenate(x) for x in zip(*sums, strict=True))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(lang)), pa.array(gram.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    sums = rows.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = sums.withColumn("place", place).where(F.col("place") <= size)
    found = best.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "gram"))), lambda x: x["gram"]).alias("grams")).collect()
    return sorted((r.lang, np.array(r.grams, np.int64).view(np.uint64)) for r in found)


class _Profiles:
    def __init__(self, profiles: list[tuple[str, np.ndarray]], size: int):
        self.langs, self.size = [x for x, _ in profiles], size
        self.grams = np.unique(np.concatenate([np.zeros(0, np.uint64), *(g for _, g in profiles)]))
        self.ranks = np.full((len(self.grams) + 1, len(profiles)), -1, np.int64)
        for k, (_, g) in enumerate(profiles):
            self.ranks[np.searchsorted(self.grams, g), k] = np.arange(len(g))

    def _distances(self, texts: pa.Array, most: int) -> tuple[np.ndarray, np.ndarray]:
        """How many n-grams each text has, and its distance from each language."""
        of, gram, rank = counted(texts, None, most)
        n = len(texts)
        sizes = np.bincount(of, minlength=n)
        if not self.langs:
            return sizes, np.zeros((n, 0))
        at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        place = self.ranks[np.where(self.grams[at] == gram, at, len(self.grams))]
        off = np.where(place < 0, self.size, np.abs(place - rank[:, None]))
        return sizes, np.stack([np.bincount(of, off[:, k], n) for k in range(len(self.langs))], 1)

    def share(self, texts: pa.Array, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each text, the binary logarithm of its number of n-grams (-1 if none), and its least distance as a share of the largest possible."""
        sizes, total = self._distances(texts, most)
        least = total.min(1) if self.langs else np.zeros(len(sizes))
        return np.frexp(sizes)[1] - 1, least / np.maximum(1, sizes * self.size)

    def predict(self, texts: pa.Array, most: int) -> tuple[list[str], np.ndarray]:
        sizes, total = self._distances(texts, most)
        n = len(texts)
        if not self.langs:
            return ["und"] * n, np.zeros(n)
        best = total.argmin(1)
        least = total[np.arange(n), best]
        some = sizes > 0
        rest = (total.sum(1) - least) / max(1, len(self.langs) - 1)
        score = np.where(rest > 0, 1 - least / np.maximum(rest, 1e-300), 0.0) if len(self.langs) > 1 else np.ones(n)
        return [self.langs[b] if s else "und" for b, s in zip(best.tolist(), some.tolist(), strict=True)], np.where(some, np.clip(score, 0, 1), 0.0)


def predict(documents: DataFrame, profiles: list[tuple[str, np.ndarray]], size: int = PROFILE, most: int = DOCUMENT, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of documents, then the predicted language and its score."""
    model = _Profiles(profiles, size)
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], [np.zeros(0)]
            texts = pc.cast(batch.column(at), pa.string())
            for a, b in slices(texts, SLICE):
                lang, score = model.predict(texts.slice(a, b - a), most)
                langs += lang
                scores.append(score)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(np.concatenate(scores))], names=[*batch.schema.names, *names])

    schema = T.StructType([*documents.schema, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return documents.mapInArrow(run, schema)


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def identify(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows that aren't held out (null doc_id: taught from)."""
    docs = documents.select("doc_id", "text", "lang")
    profiles = train(docs.where(~F.coalesce(held_out(), F.lit(False))))
    return predict(docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text"), profiles).select("doc_id", "held_out", "lang_pred", "score")


def _limits(documents: DataFrame, model: _Profiles, most: int) -> np.ndarray:
    """The largest share that a text may have, by the binary logarithm of its number of n-grams; from documents(text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(0), SLICE):
                size, share = model.share(batch.column(0).slice(a, b - a), most)
                yield pa.RecordBatch.from_arrays([pa.array(size, pa.int32()), pa.array(share)], names=["size", "share"])

    rows = documents.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "size int, share double")
    found = {r["size"]: r["share"] for r in rows.where("size >= 0").groupBy("size").agg(F.max("share").alias("share")).collect()}
    out, largest = np.full(int(most).bit_length() + 1, np.inf), 0.0
    for size in sorted(found, reverse=True):
        largest = max(largest, found[size])
        out[size:][out[size:] == np.inf] = largest + MARGIN * (1 - largest)
    return out


def with_language(documents: DataFrame, size: int = PROFILE, most: int = DOCUMENT) -> DataFrame:
    """The documents that are in one of the learned languages; all that have a letter if none was learned."""
    held = F.coalesce(held_out(), F.lit(False))
    docs = documents.select("doc_id", "text", "lang")
    model = _Profiles(train(docs.where(~held), size), size)
    limits = _limits(docs.where(held & F.col("lang").isNotNull()), model, most) if model.langs else np.full(int(most).bit_length() + 1, np.inf)
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.cast(batch.column(at), pa.string())
            for a, b in slices(texts, SLICE):
                n_grams, share = model.share(texts.slice(a, b - a), most)
                yield batch.slice(a, b - a).filter(pa.array((n_grams >= 0) & (share <= limits[n_grams])))

    return documents.mapInArrow(run, documents.schema)
