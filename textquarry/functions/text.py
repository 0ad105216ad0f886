"""Scalar operations on text, as columns. Each takes and returns columns, so Catalyst sees through them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import intake, rules


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def either(conditions: list[Column]) -> Column:
    """Whether any holds; false for none."""
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def matches(x: Column, pattern: str) -> Column:
    return x.rlike(f"(?i){pattern}")


def has_any(x: Column, words: list[str]) -> Column:
    return either([x.contains(w) for w in words])


def stripped(x: Column | str) -> Column:
    """Without Unicode white space on either side."""
    return F.regexp_replace(F.regexp_replace(col(x), r"(?U)^\s+", ""), r"(?U)\s+$", "")


def squeezed(x: Column | str) -> Column:
    """Each run of white space as one space, none on either side."""
    return F.trim(F.regexp_replace(col(x), r"(?U)\s+", " "))


def without_nul(x: Column | str) -> Column:
    return F.replace(col(x), F.lit("\0"), F.lit(""))


def content_hash(x: Column | str) -> Column:
    return F.sha2(F.coalesce(col(x), F.lit("")), 256)


def query_hash(x: Column | str) -> Column:
    """A question's identity where its text must not be kept (Q11)."""
    return F.sha2(F.lower(stripped(x)), 256)


def token_estimate(x: Column | str) -> Column:
    return F.floor(F.length(col(x)) / 4)


def slug(url: Column | str) -> Column:
    """A file name from a url: no scheme, other characters as one `_`, 120 at most, `page` if nothing is left."""
    x = F.regexp_replace(col(url), r"^https?://", "")
    x = F.regexp_replace(F.regexp_replace(x, r"[^\p{L}\p{N}_]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(F.left(x, F.lit(120)), F.lit("")), F.lit("page"))


def form_in_url(url: Column | str) -> Column:
    """`I-765` from a url that names a form, else null."""
    found = F.regexp_extract(F.lower(col(url)), r"(?:^|[/_-])([in]-?[0-9]{2,4}[a-z]?)(?:[/?#._-]|$)", 1)
    form = F.regexp_replace(F.upper(found), r"^([IN])-?", "$1-")
    return F.nullif(form, F.lit(""))


def citation_parts(x: Column | str) -> Column:
    """volume, page, tribunal, year, name of `NAME, 29 I&N Dec. 628 (BIA 2026)`; nulls where it isn't one."""
    part = lambda k: F.nullif(F.regexp_extract(col(x), r"(\d+)\s+I&N\s+Dec\.\s+(\d+)\s+\(([A-Za-z. ]+?)\s+(\d{4})\)", k), F.lit(""))
    name = F.trim(F.regexp_replace(F.split_part(col(x), F.lit(","), F.lit(1)), r"(?i)^\s*matter of\s+", ""))
    return F.struct(part(1).cast("int").alias("volume"), part(2).cast("int").alias("page"), part(3).alias("tribunal"), part(4).cast("int").alias("year"), name.alias("name"))


def chunk_name(number: Column | str, index: Column | str, prefix: str = "BIA_ID") -> Column:
    return F.format_string(f"{prefix}_%d_chunk_%04d", col(number), col(index))


def first_of_year(year: Column | str) -> Column:
    return F.make_date(col(year), F.lit(1), F.lit(1))


def is_pdf(content: Column | str) -> Column:
    return F.substring(col(content), 1, 4) == F.lit(b"%PDF")


def structure(section: Column | str, citation: Column | str, hierarchical: bool = False) -> Column:
    """part, subsection, paragraph and level of a citation.

    A run such as (f)(10)(i) is one marker; `hierarchical` counts each parenthesis.
    """
    section = col(section)
    one = r"(\([a-zA-Z0-9]+\))" if hierarchical else r"(\([a-zA-Z0-9]+\)(?:\([a-zA-Z0-9]+\))*)"
    marks = F.regexp_extract_all(col(citation), F.lit(one), 1)
    n = F.size(marks)
    part = lambda k: F.when(n >= k, F.concat(section, F.array_join(F.slice(marks, 1, k), ""))).otherwise("")
    level = F.when(n >= 3, "clause").when(n == 2, "paragraph").when(n == 1, "subsection").otherwise("section")
    return F.struct(F.split_part(section, F.lit("."), F.lit(1)).alias("part"), part(1).alias("subsection"), part(2).alias("paragraph"), level.alias("level"))


def chunk_citation(section: Column | str, text: Column | str) -> Column:
    """`8 CFR § N` with the first marker among the text's first 100 characters; some starts have citations of their own (C11)."""
    mark = F.regexp_extract(F.left(col(text), F.lit(100)), r"(\([a-zA-Z0-9]{1,4}\))", 1)
    out = F.concat(F.lit("8 CFR § "), col(section), mark)
    begin = F.regexp_replace(col(text), r"(?U)^\s+", "")
    for number, start, citation in intake.CANONICAL:
        out = F.when((col(section) == number) & begin.startswith(start), citation).otherwise(out)
    return out


def words_held(text: Column, words: dict[str, list[str]]) -> Column:
    """Names of the dictionary with a word in the text as it is, in the dictionary's order; none for null.

    Searched in Python, whose search skips ahead by a word's length; an expression's looks at every byte for every word. A word
    that holds another of its name finds nothing more.
    """
    table = [(name, list(dict.fromkeys(w for w in ws if not any(v != w and v in w for v in ws)))) for name, ws in words.items()]

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[] if t is None else [name for name, ws in table if any(w in t for w in ws)] for t in texts], dtype=object)

    return run(text)


def tags(text: Column, words: dict[str, list[str]], whole_words: bool = False) -> Column:
    """Names of the dictionary with a word in the text, in the dictionary's order.

    The words are raw substrings; `whole_words` asks for no letter or digit on either side.
    """
    low = F.lower(text)
    if not whole_words:
        return words_held(low, words)
    hit = lambda w: low.rlike(r"(?<![\p{L}\p{N}])" + "".join(f"\\{c}" if not c.isalnum() and c != " " else c for c in w) + r"(?![\p{L}\p{N}])")
    return F.filter(F.array(*(F.when(either([hit(w) for w in ws]), F.lit(name)) for name, ws in words.items())), lambda x: x.isNotNull())


def risk(text: Column) -> Column:
    levels = tags(text, rules.RISK_WORDS)
    return F.when(F.array_contains(levels, "HIGH"), "HIGH").when(F.array_contains(levels, "MEDIUM"), "MEDIUM").otherwise("LOW")


# Answers of a fixed form: five headers, each on a line of its own.


def plain_headers(answer: Column | str) -> Column:
    """Header lines in the one spelling of rules.SECTIONS (A1)."""
    x = stripped(answer)
    for header in rules.SECTIONS:
        x = F.regexp_replace(x, rf"(?im)^\s*{header.lower()}\s*:?\s*$", f"{header}:")
    return x


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value made once, however often f names it."""
    return F.get(F.transform(F.array(value), lambda x: f(x)), F.lit(0))


def _pieces(x: Column) -> Column:
    """Of an answer with plain headers: what stands before the first, then header and body in turn, stripped."""
    mark = "\x01"
    for header in rules.SECTIONS:
        x = F.regexp_replace(x, rf"(?m)^{header}:[ \t]*$", f"{mark}{header}{mark}")
    return F.transform(F.split(x, mark), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))


def _pairs(pieces: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), (F.size(pieces) - 1) / 2 - 1).cast("int")), lambda k: F.struct(F.get(pieces, k * 2 + 1).alias("header"), F.coalesce(F.get(pieces, k * 2 + 2), F.lit("")).alias("body")))
    return F.filter(pairs, lambda p: p["header"].isNotNull())


def _first_body(pairs: Column, header: Column) -> Column:
    return F.coalesce(F.get(F.filter(pairs, lambda p: (p["header"] == header) & (p["body"] != "")), F.lit(0))["body"], F.lit(""))


def sections(answer: Column | str) -> Column:
    """Map from header to its first body that isn't empty (A2, A4)."""
    named = lambda pairs: F.create_map(*(v for h in rules.SECTIONS for v in (F.lit(h), _first_body(pairs, F.lit(h)))))
    return once(_pieces(plain_headers(answer)), lambda pieces: once(_pairs(pieces), named))


def deduplicated(answer: Column | str) -> Column:
    """The answer with each header once, in order of their first appearance, over its first body that isn't empty; what stands before the first is kept (A2).

    An answer that repeats no header is only brought to one spelling of them. Null stays null.
    """

    def joined(pieces: Column, pairs: Column) -> Column:
        each = F.transform(F.array_distinct(F.transform(pairs, lambda p: p["header"])), lambda h: F.rtrim(F.concat(h, F.lit(":\n"), _first_body(pairs, h)), F.lit("\n")))
        return F.array_join(F.concat(F.filter(F.slice(pieces, 1, 1), lambda p: p != ""), each), "\n\n")

    def shown(x: Column) -> Column:
        repeats = either([F.regexp_count(F.lower(x), F.lit(f"{h.lower()}:")) > 1 for h in rules.SECTIONS])
        told = once(_pieces(x), lambda pieces: once(_pairs(pieces), lambda pairs: F.when(F.size(pairs) > 1, joined(pieces, pairs)).otherwise(x)))
        return F.when(repeats, told).otherwise(x)

    return once(plain_headers(answer), shown)


def list_items(body: Column) -> Column:
    """Lines without their numbers and bullets, none empty (A4)."""
    lines = F.transform(F.split(body, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:\d{1,2}[.)]|[-*•])\s*", "")))
    return F.filter(lines, lambda x: x != "")


def structured(answer: Column | str, high_risk: Column | bool = False) -> Column:
    """An answer that has all headers, each once: as it is, with a caution added, or wrapped; a null one as an empty one (A3)."""
    risky = F.lit(high_risk) if isinstance(high_risk, bool) else high_risk
    caution = F.concat(F.lit(rules.CAUTION), F.when(risky, rules.RISK_CAUTION).otherwise(""))

    def shown(x: Column) -> Column:
        low = F.lower(x)
        whole = reduce(lambda a, b: a & b, [low.contains(f"{h.lower()}:") for h in rules.SECTIONS])
        added = F.concat(F.regexp_replace(x, r"(?U)\s+$", ""), F.lit("\n\nImportant caution:\n"), caution)
        wrapped = F.concat(F.lit("Short answer:\n"), x, F.lit("".join(f"\n\n{h}:\n{body}" for h, body in rules.WRAP.items()) + "\n\nImportant caution:\n"), caution)
        return F.when(whole, x).when(low.contains("short answer:") & ~low.contains("important caution:"), added).otherwise(wrapped)

    return once(F.coalesce(deduplicated(answer), F.lit("")), shown)


def short_answer(answer: Column | str, most: int = 300) -> Column:
    """The short answer's text, or else the whole, cut (A5)."""
    x = stripped(answer)
    found = F.regexp_extract(x, r"(?is)short answer:\s*(.*?)(?=\n\s*(?:what this means|typical next steps|official sources|important caution)\s*:|$)", 1)
    return F.left(F.when(matches(x, "short answer:"), stripped(found)).otherwise(x), F.lit(most))
