"""Operator 5, URL filters: rules, and a ratio of two character language models for the rest.

The urls that a rule allows or blocks teach two smoothed variable-order Markov models of
characters: n-grams of up to ORDER + 1 characters are counted over all such urls, and an n-gram's
probability after its context is interpolated with that after the shorter context (Witten-Bell
weights), down to an even one over ALPHABET characters. All n-grams are kept, as a table with the totals
of their contexts; the distinct n-grams of the urls are joined to it and their ratios summed by url.

A url's score is the difference of its log-likelihoods, accepted less rejected, divided by its length. The threshold
is calibrated on a fifth of the labelled urls (by a hash of the url) that the models don't learn
from: where the mean of both classes' error rates is least, read from a histogram of scores.

Defined results: a url that is null or has no `://` has an empty host and path, no rule, and is
judged as what it is (null: the empty string); if either class has no url to learn from, everything
without a rule is allowed; repeated rows are judged alike, and count as often as they stand;
digits count as one character, and upper case as lower; scores at the threshold are allowed; an empty table gives an empty result; only
page_id and url are read, so further columns can't clash; a url of any length is taken whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import keep

ORDER = 5
ALPHABET = 256
#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BINS = 200  # of the histogram, for each unit of the score


def split(url: str = "url") -> tuple[F.Column, F.Column]:
    """Host and path."""
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    part = lambda k: F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)([^?#]*)", k)
    return F.translate(part(1), _UPPER, _LOWER), part(2)


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages with host, path, rule, rule_verdict: those of the longest rule that fits, else null."""
    host, path = split()
    pages = pages.withColumn("host", host).withColumn("path", path)
    rule = verdict = F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the longest is asked first
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return pages.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def _plain(url: str | None) -> str:
    text = (url or "").lower()
    return "\x02" * ORDER + "".join("0" if "0" <= c <= "9" else c for c in text) + "\x03"


def _gram_counts(labelled: DataFrame) -> DataFrame:
    """(verdict, gram, n) over all of labelled(url, verdict)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: Counter = Counter()
            for url, verdict in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = _plain(url)
                for n in range(1, ORDER + 2):
                    sums.update((verdict, text[i - n : i]) for i in range(ORDER + 1, len(text) + 1))
            keys = list(sums)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([sums[k] for k in keys], pa.int64())], names=["verdict", "gram", "n"])

    return labelled.select("url", "verdict").mapInArrow(count, "verdict string, gram string, n bigint").groupBy("verdict", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Probabilities of one class: of each known n-gram's last character after the others."""

    def __init__(self, grams: dict[str, int]):
        total, kinds = Counter(), Counter()
        for g, n in grams.items():
            total[g[:-1]] += n
            kinds[g[:-1]] += 1
        self.back = {c: kinds[c] / (total[c] + kinds[c]) for c in total}
        self.own = {g: n / (total[g[:-1]] + kinds[g[:-1]]) for g, n in grams.items()}

    def probability(self, gram: str) -> float:
        p = 1 / ALPHABET
        for k in range(len(gram) - 1, -1, -1):  # from no context to the longest
            context = gram[k:-1]
            if context in self.back:
                p = self.own.get(gram[k:], 0.0) + self.back[context] * p
        return p


class Ratio:
    def __init__(self, accepted: Model, rejected: Model):
        self.accepted, self.rejected, self.known = accepted, rejected, {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def score(self, url: str | None) -> float:
        text, total = _plain(url), 0.0
        for i in range(ORDER + 1, len(text) + 1):
            gram = text[i - ORDER - 1 : i]
            if (x := self.known.get(gram)) is None:
                x = math.log(self.accepted.probability(gram) / self.rejected.probability(gram))
                if len(self.known) < 1 << 20:  # a cache of bounded size
                    self.known[gram] = x
            total += x
        return total / (len(text) - ORDER)


def fit(labelled: DataFrame) -> Ratio | None:
    """The models on the driver, for few urls, from labelled(url, verdict); None if a class is missing. `judge` holds them as tables."""
    counts = _gram_counts(labelled)
    models = {}
    for verdict in ("allow", "block"):
        rows = counts.where(F.col("verdict") == verdict).collect()
        if not rows:
            return None
        models[verdict] = Model({r.gram: r.n for r in rows})
    return Ratio(models["allow"], models["block"])


def _ratios(counts: DataFrame, grams: DataFrame) -> DataFrame:
    """(gram, ratio) of distinct grams(gram), by the n-grams of counts(verdict, gram, n); as Ratio has it."""
    sides = ("allow", "block")
    of = lambda v, x: F.sum(F.when(F.col("verdict") == v, x))
    context = F.expr("left(gram, length(gram) - 1)")
    totals = counts.groupBy(context.alias("context")).agg(*(of(v, F.col("n")).alias(f"total_{v}") for v in sides), *(of(v, F.lit(1)).alias(f"kinds_{v}") for v in sides))
    known = counts.groupBy("gram").agg(*(of(v, F.col("n")).alias(f"n_{v}") for v in sides)).withColumnRenamed("gram", "part")
    parts = grams.select("gram", F.explode(F.sequence(F.lit(1), F.lit(ORDER + 1))).alias("k"))
    parts = parts.withColumn("part", F.expr("right(gram, k)")).withColumn("context", F.expr("left(right(gram, k), k - 1)"))
    # suffixes repeat: each different one meets the tables once
    looked = keep(parts.select("part", "context").distinct().join(known, "part", "left").join(totals, "context", "left"))
    found = parts.drop("context").join(looked, "part").groupBy("gram").agg(F.array_sort(F.collect_list(F.struct("k", *(f"{x}_{v}" for v in sides for x in ("n", "total", "kinds"))))).alias("steps"))

    def probability(v: str) -> F.Column:
        def longer(p: F.Column, s: F.Column) -> F.Column:
            both = s[f"total_{v}"] + s[f"kinds_{v}"]
            return F.when(both.isNull(), p).otherwise(F.coalesce(s[f"n_{v}"], F.lit(0)) / both + s[f"kinds_{v}"] / both * p)

        return F.aggregate("steps", F.lit(1 / ALPHABET), longer)

    return found.select("gram", F.log(probability("allow") / probability("block")).alias("ratio"))


def _url_grams(urls: DataFrame) -> DataFrame:
    """(key, gram, n, size): the longest n-grams of distinct urls(key, url)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = _plain(url)
                found = Counter(text[i - ORDER - 1 : i] for i in range(ORDER + 1, len(text) + 1))
                out += [(key, gram, n, len(text) - ORDER) for gram, n in found.items()]
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "gram", "n", "size"])

    return urls.select("key", "url").mapInArrow(run, "key string, gram string, n bigint, size bigint")


def scored(pages: DataFrame, counts: DataFrame) -> DataFrame:
    """All columns of pages(url, ...), then score, by counts(verdict, gram, n) of what was learned."""
    pages = pages.withColumn("_key", F.coalesce("url", F.lit("")))
    grams = keep(_url_grams(pages.select(F.col("_key").alias("key"), F.col("_key").alias("url")).distinct()))
    ratios = keep(_ratios(counts, grams.select("gram").distinct()))
    sums = grams.join(ratios, "gram").groupBy("key", "size").agg(F.sum(F.col("ratio") * F.col("n")).alias("sum"))
    return pages.join(sums.select(F.col("key").alias("_key"), (F.col("sum") / F.col("size")).alias("score")), "_key").drop("_key")


def calibrate(scores: DataFrame) -> float:
    """The least-error threshold for scores(score, verdict): below it, block."""
    bins = scores.groupBy(F.floor(F.col("score") * BINS).alias("bin"), "verdict").count().collect()
    sums = {v: Counter({r.bin: r["count"] for r in bins if r.verdict == v}) for v in ("allow", "block")}
    if not sums["allow"] or not sums["block"]:
        return 0.0
    edges = sorted({r.bin for r in bins} | {max(r.bin for r in bins) + 1})
    n = {v: sum(c.values()) for v, c in sums.items()}
    wrong = []
    for e in edges:
        missed = sum(c for b, c in sums["allow"].items() if b < e) / n["allow"] + sum(c for b, c in sums["block"].items() if b >= e) / n["block"]
        wrong.append((round(missed, 12), abs(e), e))
    least = min(wrong)[0]
    best = [e for w, _, e in wrong if w == least]
    return float(np.median([best[0], best[-1]])) / BINS


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, score, verdict."""
    rows = ruled(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")), rules)
    labelled = rows.where("rule is not null").select("url", F.col("rule_verdict").alias("verdict"))
    aside = F.pmod(F.xxhash64("url"), F.lit(5)) == 0
    counts = keep(_gram_counts(labelled.where(~aside)))
    if counts.select("verdict").distinct().count() < 2:
        return rows.select("page_id", "host", "path", "rule", F.lit(0.0).alias("score"), F.coalesce("rule_verdict", F.lit("allow")).alias("verdict"))
    rows = keep(scored(rows, counts))
    threshold = calibrate(rows.where("rule is not null").where(aside).select("score", F.col("rule_verdict").alias("verdict")))
    said = F.when(F.col("score") < threshold, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", "score", F.coalesce("rule_verdict", said).alias("verdict"))


def digest(result: DataFrame) -> DataFrame:
    return result.select("page_id", "host", "path", "rule", "verdict")
