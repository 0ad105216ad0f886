"""Centroid clustering against SQL and a plain version, with ties, awkward rows and the annulus itself."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from samples import same

from textquarry.llm import centroids

VECTORS = "vec_id long, embedding array<float>, cluster string, distance double"


def plain(rows, k=centroids.CENTROIDS, rounds=centroids.ROUNDS, width=centroids.WIDTH):
    kept = []
    for i, e in rows:
        if e is not None and len(e) == width and all(x is not None and np.isfinite(np.float32(x)) for x in e):
            v = [int(np.floor(float(np.float32(x)) * 64)) for x in e]
            if max(map(abs, v)) < centroids.LARGEST:
                kept.append((i, v))
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    now = [v for _, v in first]
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min(range(len(now)), key=lambda c: (d(v, now[c]), c))
    for _ in range(rounds):
        at = [nearest(v) for _, v in kept]
        for c in range(len(now)):
            own = [v for (_, v), a in zip(kept, at, strict=True) if a == c]
            if own:
                now[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [(i, nearest(v), v) for i, v in kept]
    far = [d(v, now[c]) for _, c, v in found]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return [(i, c, x, sum(y for (_, o, _), y in zip(found, far, strict=True) if o == c), sum(far), sha[c]) for (i, c, _), x in zip(found, far, strict=True)]


def result(vectors):
    return [tuple(r) for r in centroids.digest(*centroids.cluster(vectors)).collect()]


def test_awkward_rows_ties_and_repeats(spark):
    rng = random.Random(3)
    near = [[rng.choice([0.0, 0.015625, -0.02]) for _ in range(64)] for _ in range(20)]  # many equal distances
    rows = [(i, near[i % 20]) for i in range(60)] + [(100 + i, [rng.gauss(0, 0.3) for _ in range(64)]) for i in range(80)]
    rows += [(1, None), (2, [0.5] * 63), (3, [0.5] * 65), (4, [0.5] * 63 + [None]), (5, [float("nan")] + [0.5] * 63), (6, [float("-inf")] * 64), (7, [3e38] * 64), (8, []), (None, [0.25] * 64), (100, [0.0] * 64), (9, [-1e5] * 64), rows[3], rows[3]]
    vectors = spark.createDataFrame([(*r, "x", 1.0) for r in rows], VECTORS)
    assert same(result(vectors.repartition(5)), plain(rows))
    assert same(result(vectors.repartition(1)), plain(rows))


@pytest.mark.parametrize("n", [0, 1, 7])
def test_fewer_vectors_than_centroids(spark, n):
    rows = [(i, [i / 7.0] * 64) for i in range(n)]
    assert same(result(spark.createDataFrame([(*r, "x", 1.0) for r in rows], VECTORS)), plain(rows))


def test_annulus_leaves_out_and_loses_none():
    rng = np.random.default_rng(5)
    for scale in (3, 1000, centroids.LARGEST - 1):
        c = rng.integers(-scale, scale, (40, 8)) * rng.integers(0, 2, (40, 1)) // rng.integers(1, 9, (40, 1))
        x = np.concatenate([rng.integers(-scale, scale, (3000, 8)) // rng.integers(1, 9, (3000, 1)), c, np.zeros((1, 8), np.int64)])
        find = centroids.Annulus(c)
        number, distance = find.nearest(x)
        every = ((x[:, None] - c[None]) ** 2).sum(2)
        assert (number == every.argmin(1)).all() and (distance == every.min(1)).all()
        low, high = find.bounds(x)
        assert (high - low).mean() < 40
    low, high = find.bounds(c)
    assert ((low < high) & (high - low < 40)).all()  # a centroid's own annulus is all but empty


def test_same_as_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    found = centroids.digest(*centroids.cluster(spark.read.parquet(f"{sf}/embeddings.parquet")))
    assert same([tuple(r) for r in found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()], con.execute(centroids.ORACLE_SQL).fetchall())
