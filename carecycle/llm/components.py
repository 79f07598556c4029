"""Connected components of a link table, and union-find inside one task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from carecycle.llm.storage import removed, written


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest reachable index of each of ``n`` nodes linked by (a, b) in one task."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        low = np.minimum(ra, rb)
        before = root.copy()
        np.minimum.at(root, ra, low)
        np.minimum.at(root, rb, low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(root, before):
            break
    return root


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a long, b long).

    The component is its smallest node. Large-star and small-star rounds: every
    node hands its smallest neighbour to the others until only stars are left,
    in a number of rounds that grows with the logarithm of the nodes. Each
    round is written to the shared folder, so lineage stays short and a lost
    executor costs one round; the round before it is deleted. Minima are combined map-side and the joins stand
    directly on their shuffles, so a hub with most of the links can be split.
    Links with a null end and self-links are left out; an empty table has no
    components.
    """
    stars = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    stars = stars.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()
    stars, seen = _round(stars)
    while seen[0]:
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _pass_least(both, "b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = large.filter("a <> b").distinct()
        small = _pass_least(large, "true")
        small = small.select(F.explode(F.array("a", "b")).alias("a"), F.col("least").alias("b"))
        before = stars
        stars, now = _round(small.filter("a <> b").distinct())
        removed(before)
        if now == seen:
            break
        seen = now
    found = stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        stars.select("b", "b").distinct()
    )
    parts = written(found, "components")
    removed(stars)
    return parts


def _pass_least(links: DataFrame, keep: str) -> DataFrame:
    """(a, b, least): each link with the least of its first end and that end's neighbours."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select(F.col("a").alias("k"), F.least("a", "m").alias("least"))
    return links.filter(keep).join(least, F.col("a") == F.col("k")).select("a", "b", "least")


def _round(links: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    seen = Observation()
    links = links.observe(
        seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")
    )
    table = written(links, "links")
    return table, (seen.get["n"], seen.get["x"])
