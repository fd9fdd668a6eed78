"""Connected components of a link table too large for one machine, and of the links inside one task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlens.llm.common import stored


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node reachable from each of ``n`` nodes over the links ``a[i] - b[i]``."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        if np.array_equal(ra, rb):
            return root
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(root, up := root[root]):
            root = up


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node it reaches, of every node in ``edges`` (``a``, ``b``,
    longs; either order, repeats and loops allowed; rows with a null are no links).

    Large-star and small-star steps alternate until nothing changes, a number of rounds that grows
    with the logarithm of the nodes. Neighbours are joined to their smallest, never listed, so a hub
    is split like any skewed join. Each round is stored in the shared folder.
    """
    larger, smaller = F.greatest("a", "b"), F.least("a", "b")
    links = stored(edges.filter("a <> b").select(larger.alias("a"), smaller.alias("b")).distinct(), "links")
    mark = _mark(links)
    while mark[0]:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = stored(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        if mark == (mark := _mark(links)):
            break
    roots = links.select(F.col("b").alias("node")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.withColumn("root", F.col("node")))


def _mark(links: DataFrame) -> tuple:
    """Tells one set of links from another."""
    row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
    return tuple(row)
