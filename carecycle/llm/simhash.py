"""SimHash near-duplicates found with BK-trees."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carecycle.llm.components import connected_components, forest
from carecycle.llm.storage import removed, written

TREE_NODES = 2048  # the bound of one shard's tree
QUERY_BLOCK = 256  # queries that walk a tree together
HASH_BLOCK = 1 << 15  # shingle hashes whose bits are unpacked together


def simhash64(text: bytes) -> int:
    """The SimHash of one UTF-8 text: 3-word shingles, XXH64 with seed 42, majority per bit."""
    words = text.lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not words:
        return 0
    shingles = map(b" ".join, zip(words, words[1:], words[2:])) if len(words) > 2 else [b" ".join(words)]
    hashes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(42))), ">u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), HASH_BLOCK):
        block = hashes[i : i + HASH_BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">u8")[0])


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()
) -> DataFrame:
    """(doc_id, fp long) of every row and the columns of ``carry``; a null text counts as empty and gets 0."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([simhash64(t) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found.view(np.int64)), *batch.columns[2:]], ["doc_id", "fp", *carry]
            )

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"),
        *carry,
    )
    kinds = dict(docs.dtypes)
    return rows.mapInArrow(of, ", ".join(["doc_id long, fp long", *(f"{c} {kinds[c]}" for c in carry)]))


class BKTree:
    """A Burkhard-Keller tree over 64-bit fingerprints in flat arrays.

    Each child hangs on its parent by an edge labelled with their Hamming
    distance. Nodes are placed level by level: of the points that reached one
    parent at one distance, the first becomes the child and the others move on
    to it, which gives the tree that inserting them one by one would give.
    """

    def __init__(self, points: np.ndarray):
        self.points = points
        n = len(points)
        edges = []
        left = np.arange(1, n)
        at = np.zeros(len(left), np.int64)
        while len(left):
            key = at * 65 + np.bitwise_count(points[left] ^ points[at])
            order = np.argsort(key, kind="stable")
            left, key = left[order], key[order]
            first = np.r_[True, key[1:] != key[:-1]]
            child = left[first]
            edges.append((key[first], child))
            at = np.repeat(child, np.diff(np.r_[np.flatnonzero(first), len(key)]))
            left, at = left[~first], at[~first]
        keys = np.concatenate([k for k, _ in edges]) if edges else np.zeros(0, np.int64)
        nodes = np.concatenate([c for _, c in edges]) if edges else np.zeros(0, np.int64)
        order = np.argsort(keys)
        self.keys, self.nodes = keys[order], nodes[order]

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) index pairs at most ``radius`` apart; all queries descend together."""
        found_q, found_n = [], []
        q = np.arange(len(queries)) if len(self.points) else np.zeros(0, np.int64)
        node = np.zeros(len(q), np.int64)
        while len(q):
            d = np.bitwise_count(queries[q] ^ self.points[node]).astype(np.int64)
            hit = d <= radius
            found_q.append(q[hit])
            found_n.append(node[hit])
            low = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 0))
            high = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), "right")
            n = high - low
            q = np.repeat(q, n)
            node = self.nodes[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
        if not found_q:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found_q), np.concatenate(found_n)


def _shard_links(radius: int):
    """Links of one shard as a forest: every node that has one, with its smallest reachable node."""

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        fps, first = np.unique(rows["fp"].to_numpy(np.int64), return_index=True)
        own, low, high = (rows[c].to_numpy()[first] for c in ("own", "low", "high"))
        points = fps.view(np.uint64)
        in_tree = np.flatnonzero(own == high)
        asking = np.flatnonzero(own == low)
        tree = BKTree(points[in_tree])
        a, b = [], []
        for i in range(0, len(asking), QUERY_BLOCK):
            block = asking[i : i + QUERY_BLOCK]
            q, node = tree.within(points[block], radius)
            x, y = block[q], in_tree[node]
            a.append(x[x != y])
            b.append(y[x != y])
        root = forest(len(fps), np.concatenate(a or [[]]).astype(int), np.concatenate(b or [[]]).astype(int))
        linked = np.flatnonzero(root != np.arange(len(fps)))
        return pd.DataFrame({"a": fps[linked], "b": fps[root[linked]]})

    return links


def fingerprint_links(fps: DataFrame, radius: int = 2, tree_nodes: int = TREE_NODES) -> DataFrame:
    """Links (a, b) that join all fingerprints (fp) at most ``radius`` bits apart.

    The 64 bits are cut into radius + 2 blocks; two fingerprints within the
    radius agree on two blocks at least, so both are filed under the values of
    every pair of blocks and meet. The values are hashed into shards of about
    ``tree_nodes`` entries; each shard's BK-tree answers that shard's
    fingerprints. Values that hold more than ``tree_nodes`` fingerprints are cut
    into pieces, and the tree of each piece is sent to every piece before it,
    so no tree outgrows its bound and no link is lost. A shard returns a
    spanning forest of its links, never all pairs.
    """
    spark = fps.sparkSession
    distinct = written(fps.select("fp").distinct(), "distinct")
    blocks = radius + 2
    bounds = [64 * i // blocks for i in range(blocks + 1)]
    value = [
        F.shiftrightunsigned("fp", bounds[i]).bitwiseAND((1 << (bounds[i + 1] - bounds[i])) - 1)
        for i in range(blocks)
    ]
    pairs = [(i, j) for i in range(blocks) for j in range(i + 1, blocks)]
    keys = [F.xxhash64(F.lit(i), value[i], F.lit(j), value[j]) for i, j in pairs]
    filed = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    large = filed.groupBy("key").count().filter(F.col("count") > tree_nodes)
    large = large.select("key", F.ceil(F.col("count") / tree_nodes).cast("int").alias("pieces"))
    large = written(large, "large")
    shards = max(1, -(-distinct.count() * len(pairs) // tree_nodes))
    cut = filed.join(large, "key", "left").withColumn("pieces", F.coalesce("pieces", F.lit(0)))
    own = F.when(F.col("pieces") > 0, F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int")).otherwise(0)
    shard = F.when(F.col("pieces") > 0, F.col("key")).otherwise(F.pmod("key", F.lit(shards)))
    cut = cut.select("fp", "pieces", own.alias("own"), shard.alias("shard"))
    other = F.explode(F.sequence(F.lit(0), F.greatest(F.col("pieces") - 1, F.lit(0))))
    cut = cut.withColumn("other", other).select(
        "fp", "own", "shard", F.col("pieces").cast("boolean").alias("is_cut"),
        F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
    )
    found = cut.groupBy("shard", "is_cut", "low", "high").applyInPandas(
        _shard_links(radius), "a long, b long"
    )
    found = written(found, "found")
    removed(distinct, large)
    return found


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2,
    tree_nodes: int = TREE_NODES, carry: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, fingerprint, component_id, component): documents whose SimHashes link within ``radius`` bits.

    component_id is the smallest doc_id reachable by links, the document's own
    included; component names the group itself by one of its fingerprints, which
    differs between groups even where two of them share that doc_id. Equal fingerprints are one tree node, so groups of copies of any
    size cost one entry. Null and empty texts have fingerprint zero and link
    like any other; repeated rows each return a row; a null doc_id stays null
    and is never the smallest of a group that has another. Columns other than
    the two named and those of ``carry``, which follow, are ignored. An empty table gives an empty result.
    """
    fps = written(fingerprints(docs, id_col, text_col, carry), "fingerprints")
    links = fingerprint_links(fps, radius, tree_nodes)
    parts = connected_components(links)
    firsts = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    firsts = firsts.join(parts, firsts.fp == parts.node, "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component")
    )
    firsts = written(firsts, "firsts")
    removed(links, parts)
    least = firsts.groupBy("component").agg(F.min("first").alias("component_id"))
    named = written(firsts.join(least, "component").select("fp", "component_id", "component"), "named")
    removed(firsts)
    return fps.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component", *carry
    )
