"""Operators over documents against plain versions of their definitions."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from samples import documents, same, texts

from textquarry.llm import decontaminate, langid, licences, mixing, repeats, simhash, tokens
from textquarry.llm.queries import QUERIES

SPACED = re.compile("[^\x20\x09-\x0d]+")
PLAIN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- 1: token counts ----------------------------------------------------------------------------------------


def test_tokens_as_by_encoding_anew(spark):
    import tiktoken

    ranks = {}
    import base64

    for line in open(tokens.RANKS, "rb").read().splitlines():
        a, b = line.split()
        ranks[base64.b64decode(a)] = int(b)
    whole = tiktoken.Encoding("whole", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    rows = []
    for i, (_, t) in enumerate(texts()):
        n = len(t or "")
        edits = [(rng.randrange(0, n + 3), 0, rng.choice(["", "x", " a  b\n", "  ", "12345 don't", None])) for _ in range(rng.randrange(0, 6))]
        rows.append((i, t, [(s, s + rng.randrange(0, 40), r) for s, _, r in edits] + [(5, 2, "no"), (None, 3, "no")]))
    docs = spark.createDataFrame(rows, f"doc_id long, text string, edits {tokens.EDITS}")
    built = tokens.build(docs.select("doc_id", "text", "edits"))
    count = lambda t: len(whole.encode_ordinary(t or ""))
    assert {r.doc_id: sum(r.tokens) for r in built.collect()} == {i: count(t) for i, t, _ in rows}
    for r in tokens.apply_edits(built).collect():
        text = rows[r.doc_id][1]
        for s, e, new in rows[r.doc_id][2]:
            if s is not None and e is not None and s <= e:
                text = (text or "")[:s] + (new or "") + (text or "")[e:]
        assert r.text == text
        assert sum(r.tokens) == count(text), r.doc_id
        assert sum(r.chars) == len(text or "")
    counted = {r.doc_id: r for r in tokens.counts(docs).collect()}
    for i, text, _ in rows:  # the query's own edits, by encoding anew
        if text is not None:
            n = len(text)
            edited = text
            for start, end, new in ((n // 2, n // 2 + 7, " edited §12 here"), (n // 5, n // 5 + 3, ""), (n + 16, n + 16, "  The end.")):
                edited = edited[:start] + new + edited[end:]
            assert (counted[i].n_tokens, counted[i].n_tokens_edited) == (count(text), count(edited)), i
    text = "word and other, " * 25_000
    more = spark.createDataFrame([(1, text, [(7, 7, "more 12 words " * 100), (200_000, 300_000, ""), (9, 9, "x")])], f"doc_id long, text string, edits {tokens.EDITS}")
    once = tokens.apply_edits(tokens.build(more)).first()
    assert sum(once.tokens) == count(once.text) and 300 <= once.encoded < 900
    long = max(counted.values(), key=lambda r: r.n_pretokens)
    assert long.n_encoded < long.n_pretokens / 10  # only what the edits touch
    assert tokens.counts(docs.limit(0)).count() == 0


# ---- 2: mixing ----------------------------------------------------------------------------------------------


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    stopped, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in stopped]
        left = total - sum(stopped.values())
        out = stopped | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s: 3 * sizes[s] for s in free if out[s] > 3 * sizes[s]}
        if not over:
            return out
        stopped |= over


def test_mixing(spark):
    docs = documents(spark)
    sizes, rows = Counter(), docs.select("doc_id", "text", "source").collect()
    for r in rows:
        sizes[r.source] += len(SPACED.findall(r.text or ""))
    found = mixing.mix(docs).collect()
    assert same([(r.doc_id, r.source, r["size"]) for r in found], [(r.doc_id, r.source, len(SPACED.findall(r.text or ""))) for r in rows])
    expected, taken = plain_targets(sizes), Counter()
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(expected[r.source])
        assert 0 <= r.taken <= 3 * r["size"] and r.taken == r["size"] * r.copies
        taken[r.source] += r.taken
    longest = max(r["size"] for r in found)
    for s, target in expected.items():  # the long text of 30,000 words is one that can only be taken whole
        assert abs(taken[s] - target) <= (longest if any(r["size"] == longest and r.source == s for r in found) else 60), s
    assert same(mixing.digest(mixing.mix(docs.repartition(3))).collect(), mixing.digest(mixing.mix(docs)).collect())
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_comes_near_on_the_tables(spark, sf):
    for r in mixing.mix(spark.read.parquet(f"{sf}/documents.parquet")).groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken"), F.max("size").alias("most")).collect():
        assert abs(r.taken - r.target) <= max(0.03 * r.target, r.most), r


def test_rates_are_tilted_exponentially(spark):
    import math

    rows = [(i, "w " * (1 + i % 50), None, "ab"[i % 2], 0) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    by = {}
    for r in mixing.mix(docs).collect():
        if r.rate < 2.999:
            by.setdefault(r.source, []).append(math.log(r.rate) / r["size"])
    assert all(max(x) - min(x) < 1e-6 for x in by.values())


# ---- 3: decontamination -------------------------------------------------------------------------------------


def plain_hits(docs, items, n=10):
    out = []
    windows = {}
    for item_id, text in items:
        w = PLAIN.findall(lower(text))
        for k in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(item_id)
    sizes = {len(w) for w in windows}
    for doc_id, text in docs:
        words = PLAIN.findall(lower(text))
        hit, ids = set(), set()
        for size in sizes:
            for k in range(len(words) - size + 1):
                if found := windows.get(tuple(words[k : k + size])):
                    hit |= set(range(k, k + size))
                    ids |= found
        ids = sorted(map(str, ids))
        out.append((doc_id, len(words), len(hit), len(ids), sha(",".join(ids)), bool(hit)))
    return out


def test_contamination(spark, monkeypatch):
    rows = texts()
    long = [t for _, t in rows if t and len(t) > 300]
    items = [(1, long[0][50:200]), (2, long[1][:150].upper()), (3, "nu XI pi"), (4, ""), (5, None), (6, "!!"), (10, long[2][20:160]), (10, long[2][20:160]), (11, "never seen words here")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    expected = plain_hits(rows, [i for i in items if i[1]])
    found = decontaminate.contamination(documents(spark), benchmark)
    assert same(found.collect(), expected)
    assert {r.doc_id for r in decontaminate.clean(documents(spark), benchmark).collect()} == {r[0] for r in expected if not r[5]}
    assert decontaminate.clean(documents(spark), benchmark).columns == documents(spark).columns
    monkeypatch.setattr(decontaminate, "MOST_ITEM_BYTES", 200)  # several blocks of items
    assert same(decontaminate.contamination(documents(spark), benchmark).collect(), expected)
    assert decontaminate.contamination(documents(spark).limit(0), benchmark).count() == 0
    none = decontaminate.contamination(documents(spark), benchmark.limit(0)).collect()
    assert len(none) == len(rows) and not any(r.contaminated for r in none)


@pytest.mark.parametrize("most", [decontaminate.MOST_ITEM_BYTES, 30])
def test_contamination_of_rows_with_equal_ids_and_sizes(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "MOST_ITEM_BYTES", most)
    a, b, c = (" ".join(f"{x}{k}" for k in range(10)) for x in "abc")
    rows = [(None, a), (None, b), (7, a), (7, c), (8, f"{b} {a}"), (9, None), (7, a)]
    items = [(1, a), (2, b), (3, a), (None, b)]
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert same(decontaminate.contamination(docs, benchmark).collect(), plain_hits(rows, [i for i in items if i[0]]))
    assert sorted((r.doc_id, r.text) for r in decontaminate.clean(docs, benchmark).where("text is not null").collect()) == [(7, c)]
    assert decontaminate.clean(docs, benchmark).count() == 2


def test_contamination_of_one_term(spark):
    docs, benchmark = spark.createDataFrame([(1, "alpha alpha"), (2, "alpha " * 30_000)], "doc_id long, text string"), spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    assert same(decontaminate.contamination(docs, benchmark).collect(), [(1, 2, 2, 1, sha("1"), True), (2, 30_000, 30_000, 1, sha("1"), True)])
    assert decontaminate.clean(docs, benchmark).count() == 0


def test_contamination_by_many_equal_items(spark):
    items = [(i, "alpha " * 12) for i in range(10_000)] + [(-1, "beta")]
    rows = [(1, "alpha " * 50_000), (2, "beta gamma"), (3, "alpha")]
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert same(decontaminate.contamination(docs, benchmark).collect(), plain_hits(rows, items))


def test_proximity(spark):
    rows = [(1, "red x x blue"), (2, "red " + "x " * 30 + "blue"), (3, "blue"), (4, None), *texts()[:30]]
    items = [(9, "blue red"), (10, "nu XI pi nu"), (11, "nu"), (12, ""), (13, "absent nu")]
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    expected = []
    for doc_id, text in rows:
        words = PLAIN.findall(lower(text))
        for item_id, item in items:
            wanted = set(PLAIN.findall(lower(item)))
            if wanted and any(wanted <= set(words[k : k + 10]) for k in range(max(1, len(words) - 9))):
                expected.append((doc_id, str(item_id)))
    found = decontaminate.proximity(decontaminate.build_index(docs), benchmark, 10)
    assert same(found.collect(), expected)


# ---- 4: language identification -----------------------------------------------------------------------------


def plain_profile(counted, most):
    return {g: k for k, (g, _) in enumerate(sorted(counted.items(), key=lambda x: (-x[1], number(x[0])))[:most])}


def number(gram):
    x = 0
    for c in gram:
        x = (x << 21) + ord(c)
    return x


def plain_grams(text):
    out = Counter()
    for word in re.split(r"[\W\d_]+", (text or "").lower()):
        if word:
            for n in (1, 2, 3):
                padded = f" {word} "
                out.update(g for g in (padded[k : k + n] for k in range(len(padded) - n + 1)) if g.strip())
    return out


def test_language_by_hand(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60 and length(text) < 4000")
    rows = docs.collect()
    import zlib

    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    learned = {}
    for r in rows:
        if not held(r.doc_id) and r.lang is not None and r.text is not None:
            learned.setdefault(r.lang, Counter()).update(plain_grams(r.text))
    profiles = {lang: plain_profile(c, langid.PROFILE) for lang, c in learned.items()}
    expected = []
    for r in rows:
        own = plain_profile(plain_grams(r.text), langid.DOCUMENT)
        far = {lang: sum(abs(p[g] - k) if g in p else langid.PROFILE for g, k in own.items()) for lang, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        expected.append((r.doc_id, held(r.doc_id), best if own else "und"))
    assert same([r[:3] for r in langid.identify(docs).collect()], expected)


def test_language_held_out(spark, sf):
    found = QUERIES["op4_langid"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text"), "doc_id")
    right = found.where("held_out and lang is not null and length(text) > 30").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.95
    assert found.where("score < 0 or score > 1 or score is null").count() == 0


def test_language_edges(spark):
    docs = documents(spark)
    found = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert found[1].lang_pred == found[2].lang_pred == found[6].lang_pred == "und" and found[1].score == 0
    assert found[4].lang_pred in ("en", "fr")
    assert len(langid.identify(docs).collect()) == docs.count()
    assert langid.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# ---- 8: SimHash ---------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = SPACED.findall(lower(text))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, near):
    root = {n: n for n in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if near(a, b):
                root[top(a)] = top(b)
    return {n: top(n) for n in nodes}


def plain_simhash(rows):
    codes = [plain_fingerprint(t) for _, t in rows]
    root = plain_components(set(codes), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for (i, _), c in zip(rows, codes, strict=True):
        if i is not None:
            least[root[c]] = min(i, least.get(root[c], i))
    return [(i, f"{c:016x}", least.get(root[c])) for (i, _), c in zip(rows, codes, strict=True)]


def test_simhash(spark):
    rows = texts()
    docs = documents(spark)
    assert same(simhash.digest(simhash.groups(docs)).collect(), plain_simhash(rows))
    assert simhash.groups(docs.limit(0)).count() == 0


@pytest.mark.parametrize("group", [7, 60])
def test_gray_index_loses_no_link(spark, group):
    rng = random.Random(5)
    codes = [rng.getrandbits(64) for _ in range(150)]
    for c in list(codes):
        codes += [c ^ 1 << rng.randrange(64), c ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64), c ^ 0b111 << rng.randrange(61)]
    codes += [0, 1 << 63, 2**64 - 1]
    codes = sorted(set(codes))
    signed = [c - 2**64 if c >> 63 else c for c in codes]
    found = simhash.components(simhash.links(spark.createDataFrame([(c,) for c in signed], "code long"), 2, group)).collect()
    own = {r.node: r.root for r in found}
    expected = plain_components(signed, lambda a, b: ((a ^ b) & 2**64 - 1).bit_count() <= 2)
    parts = lambda of: sorted(sorted(c for c in signed if of(c) == r) for r in {of(c) for c in signed})
    assert parts(lambda c: own.get(c, c)) == parts(expected.get)


# ---- 9: licences --------------------------------------------------------------------------------------------


#: Notices worded as none of the templates.
WORDED = [
    ("This package is available under the terms of the MIT licence", "mit"), ("Released under the terms of the Apache licence v2", "apache-2.0"), ("The software is provided as is, without warranty of any kind, express or implied, including the warranties of merchantability and noninfringement", "mit"),
    ("Redistributions of source code must retain the above copyright notice and this list of conditions", "bsd"), ("This module may be used under the GPL version 3", "gpl-3.0"), ("The code here is under the GNU General Public License version 2", "gpl-2.0"), ("Images are licensed CC BY-SA 4.0 by their authors", "cc-by-sa"),
    ("Text is available under the Creative Commons Attribution-ShareAlike License", "cc-by-sa"), ("Data is provided under CC-BY 4.0", "cc-by"), ("for non-commercial use under CC BY-NC 4.0", "cc-by-nc"), ("Dedicated to the public domain under CC0", "cc0"), ("This source is governed by a BSD-style license that can be found in the LICENSE file", "bsd"),
    ("Mozilla Public License Version 2.0 applies to this file", "mpl-2.0"), ("Distributed with the GNU Lesser General Public License, LGPL v3", "lgpl"), ("See the GNU Affero General Public License version 3", "agpl-3.0"), ("(c) 2011 Example Press. All rights reserved worldwide.", "all-rights-reserved"), ("Made available by us under the Apache License 2.0, a copy of which is in the repository", "apache-2.0"),
    ("permission notice shall be included in all copies of the software", "mit"), ("in compliance with the License; you may obtain a copy at apache.org", "apache-2.0"), ("SPDX-License-Identifier: Apache-2.0", "apache-2.0"),
]
OF_NO_FAMILY = ["Licensed under the Microsoft Public License", "Released under the terms of the Academic Free License", "Distributed under the SIL font license", "This code is available under the PostgreSQL Licence", "Licensed under the Beerware license", "Published under the Open Government Licence v3.0"]
ORDINARY = ["The weather was fine and the harvest good this year.", "Permission to enter the building is given at the gate.", "His driving licence was taken away after the accident.", "The rights of the people shall be upheld.", "The Apache helicopter flew over the valley.", "She works at MIT in Boston and likes it.", "All reserved seats were taken by noon."]


def plain_scan(model, text):
    """Each line alone, features and probabilities by plain sums."""
    out = []
    for k, line in enumerate(text.split("\n")):
        p = model.probabilities(__import__("pyarrow").array([line]))[0]
        best = max((x for x in zip(p, model.names, strict=True) if x[1] != "none"), key=lambda x: x[0])
        if model.names[int(p.argmax())] == "none":
            continue
        like = licences.TEMPLATES.similarity(line, best[1])
        sure = best[0] >= model.least and like >= model.confirm and best[1] != "unknown"
        if sure or 1 - p[model.names.index("none")] > model.mass or licences.TEMPLATES.similarity(line, "unknown") >= licences.UNKNOWN:
            out.append((k, best[1] if sure else "unknown"))
    return out


def test_licences_worded_otherwise(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = licences.fit(docs)
    rows = [(k, f"Some plain line.\n{t}\n") for k, t in enumerate([t for t, _ in WORDED] + OF_NO_FAMILY + ORDINARY)]
    rows += [(900, None), (901, ""), (902, "\n\n"), (904, "x " * 50_000), (904, "x " * 50_000), (None, WORDED[0][0])]
    found = {}
    for r in licences.scan(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, found string"), model).collect():
        found.setdefault(r.doc_id, []).append(r)
    families = {k: {x.family for x in r[0].found} for k, r in found.items()}
    assert sum(families[k] == {f} for k, (_, f) in enumerate(WORDED)) >= 19
    assert sum(families[len(WORDED) + k] == {"unknown"} for k in range(len(OF_NO_FAMILY))) >= 5
    assert not any(families[len(WORDED) + len(OF_NO_FAMILY) + k] for k in range(len(ORDINARY)))
    assert [found[k][0].n_paragraphs for k in (900, 901, 902)] == [0, 1, 3] and len(found[904]) == 2
    assert families[None] == {"mit"} and not any(families[k] for k in (900, 901, 902, 904))
    for k, text in rows:
        assert [(x.paragraph, x.family) for x in found[k][0].found] == (plain_scan(model, text) if text is not None else [])


def test_licences_of_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lines = {"Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "All rights reserved.": "all-rights-reserved", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0"}
    expected = {r.doc_id: ",".join(sorted({f for line in (r.text or "").split("\n") for x, f in lines.items() if x in line})) for r in docs.collect()}
    assert {r.doc_id: r.licences for r in licences.licences(docs).collect()} == expected
    assert licences.licences(docs.limit(0)).count() == 0


# ---- 10: repeats --------------------------------------------------------------------------------------------


def plain_repeats(rows, n=13):
    first = {}
    for i, t in rows:
        words = SPACED.findall(t or "")
        if i is not None:
            for k in range(len(words) - n + 1):
                w = tuple(words[k : k + n])
                first[w] = min(i, first.get(w, i))
    out = []
    for i, t in rows:
        words = SPACED.findall(t or "")
        gone = set()
        if i is not None:
            for k in range(len(words) - n + 1):
                if first[tuple(words[k : k + n])] < i:
                    gone |= set(range(k, k + n))
        out.append((i, len(words), len(gone), sha(" ".join(w for k, w in enumerate(words) if k not in gone))))
    return out


@pytest.mark.parametrize("block", [repeats.BLOCK_BYTES, 2000])
def test_repeats(spark, block, monkeypatch):
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 4 * block)
    rows = texts()
    found = repeats.digest(repeats.remove_repeats(documents(spark), block_bytes=block))
    assert same(found.collect(), plain_repeats(rows))
    assert repeats.remove_repeats(documents(spark).limit(0)).count() == 0


def test_without_repeats_keeps_columns(spark):
    docs = documents(spark).withColumns({c: F.lit(c) for c in ("n_words", "n_removed", "kept", "rest")})
    out = repeats.without_repeats(docs)
    assert out.columns == docs.columns
    expected = {i: removed for i, _, removed, _ in plain_repeats(texts())}
    before = {r.doc_id: r.text for r in docs.collect()}
    for r in out.where("doc_id is not null").collect():
        assert (r.text == before[r.doc_id]) == (expected[r.doc_id] == 0)


@pytest.mark.parametrize("block", [repeats.BLOCK_BYTES, 500])
def test_repeats_know_words_by_all_their_letters(spark, block):
    t = "a"
    while len(t) < 4096:
        t = t + t.translate(str.maketrans("ab", "ba"))
    u, more = t.translate(str.maketrans("ab", "ba")), " ".join(f"w{k}" for k in range(12))
    rows = [(1, f"{t} {more}"), (2, f"{u} {more}"), (3, f"{u} {more}")]
    assert same(repeats.digest(repeats.remove_repeats(documents(spark, rows), block_bytes=block)).collect(), plain_repeats(rows))


def test_repeated_rows_are_spread(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(5, text)] * 300 + [(1, text[:100]), (9, "none of these")]
    docs, size = repeats._dealt(documents(spark, rows).select("doc_id", "text"), 2000)
    assert max(r["count"] for r in docs.groupBy("block").count().collect()) < 60
    assert same(repeats.digest(repeats.remove_repeats(documents(spark, rows), block_bytes=2000)).collect(), plain_repeats(rows))


def test_repeats_of_few_words(spark):
    rng = random.Random(8)
    for _ in range(3):
        rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(0, 40)))) for i in range(40)]
        assert same(repeats.digest(repeats.remove_repeats(documents(spark, rows))).collect(), plain_repeats(rows))


@pytest.mark.parametrize("ids", [[7], [-(2**63), 2**63 - 1, 0], [5, 5, 260], [2**40, 2**40 + 70_000, -1]])
def test_ids_in_few_bytes(ids):
    packed = repeats._narrow(np.array(ids, np.int64))
    assert repeats._wide(packed).tolist() == ids
    assert len(packed) == 9 + len(ids) * max(1, -(-(max(ids) - min(ids)).bit_length() // 8))


def test_repeats_of_far_ids(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(2**63 - 1, text), (-(2**63), text[:150]), (0, f"x {text[40:]}"), (-5, text[90:]), (2**40, "none of these")]
    assert same(repeats.digest(repeats.remove_repeats(documents(spark, rows), block_bytes=100)).collect(), plain_repeats(rows))
