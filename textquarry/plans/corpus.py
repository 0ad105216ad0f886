"""Building a corpus: sections to tagged, hashed chunks with postings, in a version of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chunking, rules, text
from ..operators import fulltext
from ..sources.kept import kept


def tagged(chunks: DataFrame) -> DataFrame:
    """chunks(section, chunk_text, ...) with citation, structure, tags, risk and hash."""
    rows = chunks.withColumn("citation", text.chunk_citation("section", "chunk_text"))
    both = F.concat_ws(" ", "citation", "chunk_text")
    rows = rows.withColumn("structure", text.structure("section", "citation"))
    names = {"visa_types": rules.VISA_WORDS, "topics": rules.TOPIC_WORDS, "forms": rules.FORM_WORDS, "actions": rules.ACTION_WORDS, "conditions": rules.CONDITION_WORDS}
    return rows.select("*", *(text.tags(both, ws).alias(n) for n, ws in names.items()), text.risk(both).alias("risk_level"), text.content_hash("chunk_text").alias("content_hash"), text.token_estimate("chunk_text").alias("n_tokens"))


def build(sections: DataFrame, version_id: int, most: int = 2000) -> tuple[DataFrame, DataFrame]:
    """(chunks, postings) of sections(section, text): ids follow from content and place, so a rerun gives the same.

    Chunks are inactive until their version is activated. They are written once, to the shared folder: both results read them.
    """
    parts = chunking.structural_chunks(sections.withColumn("text", text.squeezed(text.without_nul("text"))), most)
    rows = tagged(parts.drop("text"))
    rows = kept(rows.select(F.xxhash64("section", "chunk_index", "content_hash").alias("chunk_id"), F.lit(version_id).alias("version_id"), F.lit(False).alias("is_active"), "*"))
    posted = fulltext.postings(rows.withColumn("tags", F.array_join(F.concat("visa_types", "topics", "forms"), " ")), {"A": "chunk_text", "B": "tags", "C": "citation", "D": F.concat_ws(" ", "structure.part", "structure.subsection")}, stem=True)
    return rows, posted
