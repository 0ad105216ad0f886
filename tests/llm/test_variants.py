"""Spelling variants against a plain version that looks up every deletion of every word."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F
from samples import documents, same

from textquarry.llm import variants


def plain_words(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 3}


def plain(rows):
    n = plain_words(rows)
    near, holes = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            shorter = w[:i] + w[i + 1 :]
            if shorter in n:
                near[w].add(shorter)
                near[shorter].add(w)
            holes[i, shorter].add(w)
    for ws in holes.values():
        for w in ws:
            near[w] |= ws - {w}
    best = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: b for w, b in best.items() if n[b] >= 2 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return out


def awkward(seed=1):
    rng = random.Random(seed)
    base = ["letters", "Étoile", "aaaaaa", "abababa", "naïveté", "x" * 90, "word×sign÷", "miss", "élanÿ"]

    def bent(w):
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
            k = rng.randrange(len(w) + 1)
            c = rng.choice("abeéÿxZ")
            w = rng.choice([w[:k] + c + w[k:], w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :]])
        return w

    rows = [(rng.randrange(40), " ".join(bent(rng.choice(base)) + rng.choice(["", ".", "1", "\n", "ĀБ"]) for _ in range(120))) for _ in range(60)]
    rows += [(None, "letters lettter letters"), (3, None), (4, ""), (5, "q" * 3000 + " " + "q" * 2999 + " " + "q" * 3000), (6, "q" * 3000 + " " + "q" * 2999 + " " + "q" * 2999), rows[0], rows[0]]
    return rows


def result(df):
    return [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]


def test_awkward_texts(spark):
    rows = awkward()
    expected = plain(rows)
    assert sum(f is not None for _, f, *_ in expected) > 30 and max(len(w) for w, *_ in expected) >= 2999
    assert same(result(variants.variants(documents(spark, rows).repartition(4))), expected)
    assert same(result(variants.variants(documents(spark, rows).repartition(1))), expected)
    assert variants.variants(documents(spark, rows).limit(0)).count() == 0
    assert variants.variants(documents(spark, [(1, "none here twice"), (2, None)])).count() == 0


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert same(result(variants.variants(docs)), plain([tuple(r) for r in docs.select("doc_id", "text").collect()]))


def test_hot_keys_are_split_to_one_open_position(spark):
    words = variants.keep(spark.createDataFrame([(f"hotstart{a}{b}end", n) for n, (a, b) in enumerate(((a, b) for a in "abcdefghij" for b in "klmnopqrst"), 3)], "word string, n long"))
    once = variants.near_words(words)
    assert same([tuple(r) for r in variants.near_words(words, most=4, each=50).collect()], [tuple(r) for r in once.collect()])
    assert {r.n_near for r in once.collect()} == {18}
    sizes = variants.dealt(words, 4).groupBy("k").agg(F.count("*").alias("n"), F.max(F.expr("hi - lo")).alias("open"))
    assert sizes.where("n > 4 AND open > 1").count() == 0


def test_wavelet_tree_reports_rectangles():
    rng = np.random.default_rng(2)
    for n in (1, 2, 37, 500):
        values = rng.permutation(n)
        tree = variants.WaveletTree(values)
        at, low = rng.integers(0, n, 50), rng.integers(0, n, 50)
        to, high = np.minimum(n, at + rng.integers(0, n + 1, 50)), np.minimum(n, low + rng.integers(0, n + 1, 50))
        which, value = tree.report(at, to, low, high)
        expected = [(r, v) for r in range(50) for v in values[at[r] : to[r]].tolist() if low[r] <= v < high[r]]
        assert sorted(zip(which.tolist(), value.tolist(), strict=True)) == sorted(expected)


def test_roots_of_long_chains(spark):
    links = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(21)], "word string, form string")
    assert {r.root for r in variants.roots(links).collect()} == {"w21"}
    assert variants.roots(links.limit(0)).count() == 0
