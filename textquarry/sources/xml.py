"""Sections of XML files of any size, on the JVM side.

A file is split by Spark's text reader at the closing tag of the element asked for, so a large title is read by many tasks, each of which holds one
element at a time. from_xml reads an element's attributes and tells broken ones; what is broken costs that element alone.
Elements of the tag must not stand within one another, nor its tags in comments or CDATA.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def elements(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """(file_path, element) of all elements of a tag, with its prefix if it has one."""
    rows = spark.read.option("lineSep", f"</{tag}>").text(path).select(F.col("_metadata.file_path").alias("file_path"), "value")
    opening = rf"(?s)<{tag}(?=[\s>]).*"
    return rows.where(F.col("value").rlike(opening)).select("file_path", F.concat(F.regexp_extract("value", opening, 0), F.lit(f"</{tag}>")).alias("element"))


def _bare(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"(?s)<!--.*?-->", ""), r"<[^>]*>", "")


def _decoded(x: Column) -> Column:
    """Text without tags, its entities decoded by the XML parser; that of an element which isn't broken, so what has no `&` is as it stands. Null is empty."""
    read = F.from_xml(F.concat(F.lit("<x>|"), x, F.lit("|</x>")), "_VALUE string")["_VALUE"]  # the parser takes off space about a text
    return F.coalesce(F.when(x.contains("&"), F.regexp_replace(read, r"\A\||\|\z", "")).otherwise(x), F.lit(""))


def _squeezed(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"[\s ]+", " "))


def _stripped(x: Column) -> Column:
    """x without signs of space of any kind at its ends; x is asked for more than once, so it should be a column or a variable."""
    return F.when(F.concat(F.left(x, F.lit(1)), F.right(x, F.lit(1))).rlike(r"\p{Zs}"), F.regexp_replace(x, r"\A\p{Zs}+|\p{Zs}(?<!\p{Zs}{2})\p{Zs}*+\z", "")).otherwise(x)


def _inner(x: Column, name: str) -> Column:
    """What the first element of a name holds, whatever its prefix; null without one."""
    pattern = rf"(?s)<(?:[\w.-]+:)?{name}(?=[\s>])[^>]*>(.*?)</(?:[\w.-]+:)?{name}>"
    return F.when(x.rlike(pattern), F.regexp_extract(x, pattern, 1))


def _read(found: DataFrame) -> DataFrame:
    seen = F.from_xml("element", "_N string, _TYPE string, _corrupt_record string", {"ignoreNamespace": "true"})
    # exploded, so that what is asked of it parses no element again
    return found.select("*", F.explode(F.array(seen)).alias("seen")).withColumn("broken", F.col("seen._corrupt_record").isNotNull())


def _long_enough(rows: DataFrame, least: int) -> DataFrame:
    """rows(..., text, broken) with texts of at least so many characters; their columns are made before they are asked for, once."""
    if least <= 0:
        return rows
    whole = rows.select(F.explode(F.array(F.struct(*rows.columns))).alias("x")).select("x.*")
    return whole.where(F.col("broken") | (F.length("text") >= least))


def regulation_sections(spark: SparkSession, path: str, tag: str = "DIV8", least: int = 50) -> DataFrame:
    """(file_path, number, title, text, broken) of each element with TYPE='SECTION' and an N.

    Texts are all of an element's, tags left out, white space squeezed; those of fewer than `least` characters are left out. A broken element is a row without a number, its
    source as text.
    """
    rows = _read(elements(spark, path, tag))
    rows = rows.where("broken OR seen._TYPE = 'SECTION' AND trim(seen._N) <> ''")
    element = F.col("element")
    good = lambda c: F.when(~F.col("broken"), c)
    rows = rows.select("file_path", good(F.trim(F.regexp_replace(F.col("seen._N"), "^\\s*§", ""))).alias("number"), good(_squeezed(_decoded(_bare(_inner(element, "HEAD"))))).alias("title"), F.coalesce(good(_squeezed(_decoded(_bare(element)))), element).alias("text"), "broken")
    return _long_enough(rows, least)


def code_sections(spark: SparkSession, path: str, tag: str = "SECTION", least: int = 0) -> DataFrame:
    """(file_path, number, title, text, broken) of each section of the code: NUM without its sign, HEADING, all PARA joined by blank lines (S3).

    Names may have prefixes; `tag` is given with its own. Without a NUM the number is null, without a HEADING the title is Untitled. A PARA of nothing counts for nothing, one of white space
    for an empty paragraph, as in the source.
    """
    rows = _read(elements(spark, path, tag))
    element = F.col("element")
    good = lambda c: F.when(~F.col("broken"), c)
    paragraphs = F.regexp_extract_all(element, F.lit(r"(?s)<(?:[\w.-]+:)?PARA(?=[\s>])[^>]*>(.*?)</(?:[\w.-]+:)?PARA>"), F.lit(1))
    text = _decoded(F.array_join(F.transform(F.transform(F.filter(F.transform(paragraphs, _bare), lambda p: p != ""), _squeezed), _stripped), "\n\n"))
    number = F.regexp_replace(_squeezed(_decoded(_bare(_inner(element, "NUM")))), r"^[§\s]+|[.\s]+$", "")
    title = F.coalesce(F.nullif(_squeezed(_decoded(_bare(_inner(element, "HEADING")))), F.lit("")), F.lit("Untitled"))
    rows = rows.select("file_path", good(F.nullif(number, F.lit(""))).alias("number"), good(title).alias("title"), F.coalesce(good(text), element).alias("text"), "broken")
    return _long_enough(rows, least)


def escaped(text: Column | str) -> Column:
    """Text as it may stand in XML: signs as entities, characters that XML doesn't allow left out."""
    out = F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    for sign in ("\ufffe", "\uffff"):  # apart from the pattern: a class of low characters alone is searched far faster
        out = F.replace(out, F.lit(sign), F.lit(""))
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out
