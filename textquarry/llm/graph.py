"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import drop, keep_at


def stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each of n nodes, the least node that links (a[i], b[i]) lead to; for links held by one task."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for ends in (a, b, label[a], label[b]):
            np.minimum.at(new, ends, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    while (label[label] != label).any():
        label = label[label]
    return label


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of links(a, b): root is the least node of its component, by number.

    Each round joins all neighbours of a node, then the smaller ones, to the least of them
    (large star, small star). Neighbours are never gathered: minima are aggregates, which combine before
    the shuffle, and a hub's links meet its minimum in a join that adaptive execution can split.
    Rounds, logarithmic in the component's size, end when the links don't change.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links, path, before = _kept(links)
    while before[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links, new, after = _kept(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        drop(links.sparkSession, [path])
        path = new
        if after == before:
            break
        before = after
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _kept(links: DataFrame) -> tuple[DataFrame, str, tuple]:
    links, path = keep_at(links)
    seen = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return links, path, (seen[0], seen[1])
