"""Operators over pages and embeddings, and what they share."""

import base64
import gzip
import hashlib
import json
import math
import os
import random

import numpy as np
from pyspark.sql import functions as F
from samples import same
from test_documents import plain_components

from textquarry.llm import embeddings, graph, urls, warc

# ---- 5: urls ------------------------------------------------------------------------------------------------

URLS = [
    None, "", "no scheme", "http://", "https://example.net/en/a", "https://Sub.Example.NET/en/x?y#z", "https://example.net/fr/", "https://badexample.com/de/", "http://a.example.com/de/q", "http://a.example.com/DE/q",
    "ftp://x.org/fr/1", "https://x.org/en/1", "https://net/", "https://x.net", "https://x.net?en=/en/", "https://org/fr/", "a://b://c/d", "https://ÄÖ.net/x", "http://x.org/fr/" + "y" * 20_000, "https://example.com\n.net/x",
]


def plain_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = lambda s, marks: min([s.index(m) for m in marks if m in s], default=len(s))
        n = cut(rest, "/?#")
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n])
        path = rest[n:][: cut(rest[n:], "?#")]
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_rules_and_verdicts(spark):
    rng = random.Random(2)
    more = [f"https://{rng.choice(['shop', 'news'])}.{rng.choice(['example.net/en', 'x.org/fr', 'y.net', 'example.com/de', 'z.com/en', 'w.com/fr'])}/{rng.choice(['a', 'bb', 'ccc'])}{rng.randrange(99)}" for _ in range(400)]
    rows = [(i, u, "h", 1.0) for i, u in enumerate(URLS + more)] + [(None, "https://x.org/fr/", "h", 1.0), (4, "https://example.net/en/a", "h", 1.0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, score double")
    found = urls.judge(pages).collect()
    assert same([(r.page_id, r.host, r.path, r.rule) for r in found], [(i, *plain_rule(u)[:3]) for i, u, _, _ in rows])
    by_rule = {i: plain_rule(u)[3] for i, u, _, _ in rows}
    assert all(r.verdict in ("allow", "block") and (by_rule[r.page_id] or r.verdict) == r.verdict for r in found)
    assert urls.judge(pages.limit(0)).count() == 0
    assert {r.verdict for r in urls.judge(pages.where("url like '%org/fr/%' or url = ''")).where("rule is null").collect()} <= {"allow"}


def test_models_are_probabilities_and_tell_held_out_urls_apart(spark):
    def url(rng, good):
        return "https://h.com/" + ("".join(rng.choice("abc") for _ in range(12)) if good else "".join(rng.choice("xyz") for _ in range(12)))

    rng = random.Random(4)
    ratio = urls.fit(spark.createDataFrame([(url(rng, k % 2), ("block", "allow")[k % 2]) for k in range(300)], "url string, verdict string"))
    assert sum(ratio.score(url(rng, k % 2)) > 0 if k % 2 else ratio.score(url(rng, 0)) < 0 for k in range(100)) >= 98
    model = ratio.accepted
    for context in ("", "a", "zzz", "//h.c"):
        seen = {g[-1] for g in model.own} | {chr(c) for c in range(1, 200)}
        assert sum(model.probability(context + c) for c in list(seen)[: urls.ALPHABET]) <= 1 + 1e-9
    assert math.isfinite(ratio.score(None))


# ---- 6: embeddings ------------------------------------------------------------------------------------------


def plain_near(rows, cosine=0.9):
    good = {}
    for k, (_, v) in enumerate(rows):
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float64)
            x = x / np.abs(x).max()
            good[k] = x / np.sqrt((x * x).sum())
    near = lambda a, b: a in good and b in good and len(good[a]) == len(good[b]) and float(good[a] @ good[b]) >= cosine
    root = plain_components(range(len(rows)), near)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root[k]] = min(i, least.get(root[k], i))
    n = [sum(near(a, b) for b in range(len(rows)) if a != b) for a in range(len(rows))]
    return [(i, n[k], least.get(root[k]), i == least.get(root[k])) for k, (i, _) in enumerate(rows)]


def vectors():
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(12, 8))
    rows = [(i, [float(x) for x in np.float32(centers[i % 12] + rng.normal(size=8) * (0.05 + i % 5 * 0.12))]) for i in range(250)]
    rows += [(300 + i, rows[i][1]) for i in range(20)]  # copies
    rows += [(400, None), (401, [0.0] * 8), (402, [float("nan")] + [1.0] * 7), (403, [float("inf")] + [1.0] * 7), (404, []), (405, [1.0, 2.0]), (406, [None] + [1.0] * 7), (407, [2 * x for x in rows[0][1]]), (408, [-0.0] + [1e-30] * 7), (409, [0.0] + [1e-30] * 7), (None, rows[1][1]), (None, None)]
    rows += [(500 + i, [float(x) for x in np.float32(rng.normal(size=3))]) for i in range(30)] + [(600, [1.0, 2.0]), (601, [2.0, 4.0]), (602, [5.0]), (603, [-1.0])]
    return rows


def test_near_vectors(spark):
    rows = vectors()
    table = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], "vec_id long, embedding array<float>, label int, node string, task int")
    expected = plain_near(rows)
    for tile in (embeddings.TILE, 40):
        assert same(embeddings.near_duplicates(table, tile=tile).collect(), expected)
    assert embeddings.near_duplicates(table.limit(0)).count() == 0
    assert embeddings.near_duplicates(table.where("vec_id in (400, 401)")).count() == 2


def test_cells_keep_clusters_apart(spark):
    """Tasks per tile on vectors in clusters stay few as tiles grow in number; on random ones all pairs of tiles remain."""
    rng = np.random.default_rng(7)
    centers = rng.normal(size=(32, 64))
    for clustered in (True, False):
        for tiles in (32, 128):
            x = centers[np.arange(3200) % 32] + rng.normal(size=(3200, 64)) * 0.1 if clustered else rng.normal(size=(3200, 64))
            nodes = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "node long, vector array<double>").repartition(4).cache()
            placed, tasks = embeddings._tiles(nodes, 3200, embeddings.Turn(embeddings._moments(nodes, 64), 4, 0.9), 3200 // tiles)
            assert placed.groupBy("part").count().agg(F.max("count")).first()[0] <= 2 * 3200 // tiles
            n = tasks.select("task").distinct().count()
            assert n <= 10 * tiles if clustered else n == tiles * (tiles + 1) // 2


def test_a_hot_cluster_of_different_vectors(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1, 16)) + rng.normal(size=(900, 16)) * 0.01
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(np.concatenate([x, rng.normal(size=(100, 16))]))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {r.vec_id: r for r in embeddings.near_duplicates(table, tile=128).collect()}
    assert all(found[i].n_links >= 899 and found[i].component_id == 0 for i in range(900)) and len(found) == 1000


# ---- 7: WARC ------------------------------------------------------------------------------------------------


def plain_warc(rows):
    last = {}
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(i, last.get(h or "", i))
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        to = last.get(h or "")
        revisit = to is not None and i != to
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", to if revisit else None))
    return out


PAGES = [(1, "http://a/", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://b/\r\nX: y", None), (4, "u", ""), (5, "u", "é" * 1000), (6, "u", "WARC/1.1\r\n\r\n"), (7, "u", "z" * 3_000_000), (8, "ünï", "\r\n\r\n"), (None, "u", "<p>x</p>"), (None, "u", "alone"), (9, "u", "twice"), (9, "u", "twice")]


def test_round_trip(spark):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, refers_to string")
    assert same(warc.round_trip(pages).collect(), plain_warc(PAGES))
    assert warc.round_trip(pages.limit(0)).count() == 0
    assert {r.record_type for r in warc.round_trip(pages, least=10**9).collect()} == {"response"}


def test_archives_are_one_member_a_record(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)
    written = warc.write(pages, f"file://{tmp_path}", archive_bytes=2000)
    assert written.agg(F.sum("n")).first()[0] == len(PAGES)
    for r in warc.normalise(written).collect():
        path = r.path.removeprefix("file://")
        data, index = open(path, "rb").read(), open(path + ".idx").read().splitlines()
        assert len(index) == r.n and r.bytes == len(data) == os.path.getsize(path)
        at = 0
        for line in index:
            offset, length = json.loads(line)[:2]
            assert offset == at
            assert gzip.decompress(data[at : at + length]).startswith(b"WARC/1.1\r\n")
            at += length


# ---- shared -------------------------------------------------------------------------------------------------


def test_components_of_chains_and_stars(spark):
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(5, 5), (1, 2), (2, 1)]
    found = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    joined = {frozenset(x) for x in links}
    plain = plain_components(sorted(nodes), lambda a, b: frozenset((a, b)) in joined)
    least = {}
    for n, r in plain.items():
        least[r] = min(n, least.get(r, n))
    assert found == {n: least[r] for n, r in plain.items()}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
