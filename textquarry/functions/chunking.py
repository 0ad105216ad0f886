"""Chunkers. Packing folds run as expressions; windows whose next start depends on the text run in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What counts as space at either end of a piece.
SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
MARK = r"(?=\s\([a-zA-Z0-9]{1,4}\)\s)"


def ends_cut(x: Column) -> Column:
    """x without SPACE on either side; with one parameter, as F.transform hands places to functions of two."""
    return F.trim(x, F.lit(SPACE))


def packed(pieces: Column, most: int, joint: str = " ") -> Column:
    """Pieces joined in order as long as they fit in `most` characters with one more for the joint; a longer one stays whole."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(state: Column, piece: Column) -> Column:
        fits = F.length(state["open"]) + F.length(piece) + 1 <= most
        joined = F.when(state["open"] == "", ends_cut(piece)).otherwise(ends_cut(F.concat(state["open"], F.lit(joint), piece)))
        closed = F.when(state["open"] == "", state["done"]).otherwise(F.concat(state["done"], F.array(state["open"])))
        return F.struct(F.when(fits, state["done"]).otherwise(closed).alias("done"), F.when(fits, joined).otherwise(piece).alias("open"))

    return F.aggregate(pieces, start, add, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))


def sentence_chunks(text: Column | str, most: int = 2000) -> Column:
    """Sentences packed into chunks."""
    text = F.col(text) if isinstance(text, str) else text
    return packed(F.split(text, r"(?<=[.;])\s+"), most)


def paragraph_chunks(text: Column | str, most: int = 3200) -> Column:
    """Paragraphs packed into chunks; an oversized paragraph stands alone, and nothing is repeated."""
    text = F.col(text) if isinstance(text, str) else text
    return packed(F.filter(F.transform(F.split(text, r"\n\s*\n"), ends_cut), lambda p: p != ""), most, "\n\n")


def structural_chunks(sections: DataFrame, most: int = 2000, least: int = 100) -> DataFrame:
    """All columns of sections(text, ...), then chunk_index, chunk_text, dropped_chars.

    A section is split before its ` (x) ` markers; segments under `least` characters are dropped, those over `most` are
    packed by sentence. One segment, or a text that fits, stays whole. Of what comes out, chunks under `least` are dropped too, so a short
    text gives no row; dropped_chars counts all that went.
    """
    rows = sections.where("text is not null and text <> ''").select("*", F.transform(F.split("text", MARK), ends_cut).alias("_segments"))
    rows = rows.select("*", F.filter("_segments", lambda s: F.length(s) >= least).alias("_kept"))  # columns, so that each is made once
    whole = (F.size("_kept") <= 1) | (F.length("text") <= most)
    parts = F.when(whole, F.array("text")).otherwise(F.col("_kept"))
    chunks = F.flatten(F.transform(parts, lambda s: F.when(F.length(s) <= most, F.array(s)).otherwise(sentence_chunks(s, most))))
    short = lambda xs: F.aggregate(F.filter(xs, lambda s: F.length(s) < least), F.lit(0), lambda a, s: a + F.length(s))
    rows = rows.select("*", F.when(whole, 0).otherwise(short("_segments")).alias("dropped_chars"), chunks.alias("_chunks"))
    rows = rows.select(*sections.columns, (F.col("dropped_chars") + short("_chunks")).alias("dropped_chars"), F.filter("_chunks", lambda s: F.length(s) >= least).alias("_chunks"))
    return rows.select("*", F.posexplode("_chunks").alias("chunk_index", "chunk_text")).drop("_chunks")


def whole_sections(sections: DataFrame) -> DataFrame:
    """All columns of sections(text, ...), then chunk_index 0 and chunk_text, the stripped text; none for an empty one."""
    return sections.withColumn("chunk_index", F.lit(0)).withColumn("chunk_text", F.trim("text")).where("chunk_text <> ''")


def with_totals(chunks: DataFrame, *keys: str) -> DataFrame:
    """chunks with total_chunks, how many there are of the same keys."""
    return chunks.withColumn("total_chunks", F.count("*").over(Window.partitionBy(*keys)).cast("int"))


#: (characters, overlap, marks that end a chunk, how far behind the start a mark must be, how far before the
#: end it is looked for (0: anywhere), characters of the text used, chunks at most); 0 is no limit.
PRESETS = {
    "regulations": (1500, 200, (".",), 750, 0, 0, 0),
    "statutes": (1500, 200, (". ", "\n"), 0, 300, 0, 0),
    "decisions": (1500, 200, (".", "\n"), 500, 0, 0, 0),
    "tokens": (4000, 500, ("\n\n", ". ", "\n"), 2000, 0, 0, 0),
    "pages": (1200, 150, (), 0, 0, 12000, 4),
}


def windows(text: str, preset: str) -> list[str]:
    """Overlapping chunks (C4 to C8). Each next start is behind the one before, and the last chunk ends the text."""
    size, overlap, marks, behind, back, used, most = PRESETS[preset]
    text = text[:used] if used else text
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            least = max(start + behind, end - back if back else 0)
            spots = [(text.rfind(m, start, end), len(m.rstrip()) or 1) for m in marks]
            good = [(at, n) for at, n in spots if at > least]
            if preset == "tokens":
                good = good[:1]  # the kinds of mark are tried in order
            if good:
                at, n = max(good)
                end = at + n
            elif preset == "decisions" and (at := text.rfind(" ", start, end)) > start:
                end = at
        if chunk := text[start:end].strip():
            out.append(chunk)
        if end >= len(text) or most and len(out) >= most:
            break
        start = max(end - overlap, start + 1)
    return out


PIECE = 4_000_000  # bytes of chunks handed on at a time


def sliding_chunks(documents: DataFrame, preset: str, column: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns `keep` (all, if not given) of documents, then chunk_index and chunk_text by a preset of windows.

    Chunks are handed on in pieces of some PIECE bytes, with the columns they repeat; a text that is kept is repeated beside each of its
    chunks, so leave it out where it isn't wanted.
    """
    keep = tuple(documents.columns) if keep is None else keep
    rows = documents.select(*keep, F.col(column).cast("string").alias("_windowed"))
    schema = T.StructType([*(documents.schema[c] for c in keep), T.StructField("chunk_index", T.IntegerType()), T.StructField("chunk_text", T.StringType())])

    def piece(batch: pa.RecordBatch, row: list[int], index: list[int], chunks: list[str]) -> pa.RecordBatch:
        at = pa.array(row, pa.int64())
        return pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(len(keep))), pa.array(index, pa.int32()), pa.array(chunks, pa.string())], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, index, chunks, size = [], [], [], 0
            for i in range(batch.num_rows):
                text = batch.column(len(keep))[i].as_py()
                beside = sum(batch.column(c).slice(i, 1).nbytes for c in range(len(keep)))
                for k, chunk in enumerate(windows(text, preset) if text is not None else []):
                    row.append(i)
                    index.append(k)
                    chunks.append(chunk)
                    size += beside + 4 * len(chunk)
                    if size >= PIECE:
                        yield piece(batch, row, index, chunks)
                        row, index, chunks, size = [], [], [], 0
            if row:
                yield piece(batch, row, index, chunks)

    return rows.mapInArrow(run, schema)
