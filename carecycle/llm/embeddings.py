"""Near-duplicate vectors found with an inverted multi-index."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carecycle.llm.components import connected_components, forest
from carecycle.llm.storage import removed, written

THRESHOLD = 0.98
SAMPLE = 8192  # vectors that the codebooks are fitted to
CELL_ROWS = 1024  # vectors for each cell of the grid, all labels together
MOST_CODES = 256  # of each half
BLOCK_ROWS = 512  # index rows, and query rows, that meet at a time
SHARD_ROWS = 8192  # entries of one task
ROUNDS = 12  # of k-means


def kmeans(points: np.ndarray, k: int, seed: int = 3) -> np.ndarray:
    """At most ``k`` centres of ``points``."""
    rng = np.random.default_rng(seed)
    centres = points[rng.permutation(len(points))[:k]].copy()
    for _ in range(ROUNDS):
        nearest = _distances(points, centres).argmin(1)
        size = np.bincount(nearest, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, nearest, points)
        centres[size > 0] = total[size > 0] / size[size > 0, None]
    return np.unique(centres, axis=0)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances between rows of a and of b."""
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1), 0)


class Grid:
    """The product grid of two codebooks, one for each half of a vector."""

    def __init__(self, centres: tuple[np.ndarray, np.ndarray]):
        self.centres = centres
        self.apart = [np.sqrt(_distances(c, c)) for c in centres]

    def gaps(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each half, how far each row must move at least to be nearest to each centre.

        That is its distance from the plane half way between its nearest centre
        and the other one; 0 for the nearest.
        """
        cut = units.shape[1] // 2
        out = []
        for part, c, apart in zip((units[:, :cut], units[:, cut:]), self.centres, self.apart):
            d = _distances(part, c)
            near = d.argmin(1)
            between = np.maximum(apart[near], 1e-12)
            gap = np.maximum((d - d[np.arange(len(d)), near][:, None]) / (2 * between), 0)
            gap[np.arange(len(d)), near] = 0
            out.append(gap)
        return out[0], out[1]

    def cells(self, first: np.ndarray, second: np.ndarray, reach: float) -> Iterator[int]:
        """Cells in order of first^2 + second^2 of their gaps, until that exceeds ``reach``^2.

        The multi-sequence walk: both halves' centres are sorted by gap, and
        the next cell is the least of those whose predecessors in both
        sequences have been visited.
        """
        a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
        x, y = first[a] ** 2, second[b] ** 2
        queue = [(x[0] + y[0], 0, 0)]
        while queue:
            cost, i, j = heapq.heappop(queue)
            if cost > reach * reach:
                return
            yield int(a[i]) * len(b) + int(b[j])
            if i == 0 and j + 1 < len(b):  # each cell is entered along its row
                heapq.heappush(queue, (x[0] + y[j + 1], 0, j + 1))
            if i + 1 < len(a):
                heapq.heappush(queue, (x[i + 1] + y[j], i + 1, j))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Vectors in double precision times a power of two that brings the largest component near 1, so no square over- or underflows."""
    x = x.astype(float)
    _, e = np.frexp(np.abs(x).max(-1, keepdims=True, initial=0))
    return np.ldexp(np.ldexp(x, -(e // 2)), -(e - e // 2))


def _valid(kind: str):
    """The bytes of vectors that can link; null for all others."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for label, vector in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                x = None
                if label is not None and vector and None not in vector:
                    x = np.array(vector, kind)
                    x = x if np.isfinite(x).all() and x.any() else None
                found.append(None if x is None else x.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["vec_id", "label", "vec"]
            )

    return rows


def _units(vectors: list[bytes], kind: str) -> np.ndarray:
    x = _scaled(np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1))
    return x / np.sqrt((x * x).sum(1))[:, None]


def _entries(grids: dict[int, Grid], kind: str, reach: float):
    """A row for a vector's own cell, and one for each later cell that it visits."""
    width = np.dtype(kind).itemsize

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(0).to_pylist()
            at, cell, own = [], [], []
            for size in sorted({len(v) for v in vectors}):
                here = [i for i, v in enumerate(vectors) if len(v) == size]
                grid = grids.get(size // width)
                if not grid:
                    at += here
                    cell += [0] * len(here)
                    own += [True] * len(here)
                    continue
                for i, a, b in zip(here, *grid.gaps(_units([vectors[i] for i in here], kind))):
                    walk = grid.cells(a, b, reach)
                    mine = int(a.argmin()) * len(b) + int(b.argmin())
                    for c in walk:
                        if c >= mine:
                            at.append(i)
                            cell.append(c)
                            own.append(c == mine)
            for k in range(0, len(at), 8192):
                part = slice(k, k + 8192)
                taken = batch.take(pa.array(at[part]))
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array(cell[part], pa.int64()), pa.array(own[part])],
                    [*batch.schema.names, "cell", "own"],
                )

    return rows


def _block_links(threshold: float, kind: str):
    """Links between the index rows and the query rows of each block of a shard.

    Own vectors of a cell stand on both sides, so each counts its own links;
    a visitor's links count for both. Returns (node, links, root): the weight
    of what each node was found linked to, and its smallest node in the block.
    """

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, block in rows.groupby(["label", "size", "cell", "piece", "chunk"], sort=True):
            index, query = block[~block["asks"]], block[block["asks"]]
            if index.empty or query.empty:
                continue
            x, y = _units(list(index["vec"]), kind), _units(list(query["vec"]), kind)
            a, b = query["node"].to_numpy(), index["node"].to_numpy()
            cosine = y @ x.T
            for q, i in np.argwhere(np.abs(cosine - threshold) < 1e-9):  # where rounding may decide
                u, v = (_scaled(np.frombuffer(r["vec"].iloc[k], kind)) for r, k in ((query, q), (index, i)))
                cosine[q, i] = (u * v).sum() / (math.sqrt((u * u).sum()) * math.sqrt((v * v).sum()))
            q, i = np.nonzero((cosine >= threshold) & (a[:, None] != b))
            if not len(q):
                continue
            nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
            asks, answers = place[: len(a)], place[len(a) :]
            found = np.zeros(len(nodes), np.int64)
            np.add.at(found, asks[q], index["weight"].to_numpy()[i])
            visits = ~query["own"].to_numpy()[q]
            np.add.at(found, answers[i[visits]], query["weight"].to_numpy()[q[visits]])
            root = forest(len(nodes), asks[q], answers[i])
            seen = np.flatnonzero((found > 0) | (root != np.arange(len(nodes))))
            out.append(pd.DataFrame({"node": nodes[seen], "links": found[seen], "root": nodes[root[seen]]}))
        return pd.concat(out) if out else pd.DataFrame({"node": [], "links": [], "root": []}, dtype="int64")

    return links


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
    threshold: float = THRESHOLD, reach: float = 1.0, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Two vectors of one label link if the cosine of the angle between them, in
    double precision, is ``threshold`` or more. n_links counts the other rows
    linked directly, component_id is the smallest id reachable by links, its
    own included, kept says that it is its own. Rows whose label is null or
    whose vector is null, zero, or has null or non-finite components link with
    nothing; vectors of different lengths neither. Null ids are never a
    smallest id if the component has another. Equal vectors of one label are
    one entry with a weight, so copies cost nothing. Other columns are
    ignored; an empty table gives no rows.

    Each half of the unit vectors has a codebook, fitted to a sample of SAMPLE
    vectors; a vector is filed in the cell of its two nearest centres. Cells
    are visited in the order of the least distance that a vector must move to
    get there, which no link can exceed: vectors of that cosine are at most
    ``sqrt(2 - 2 * threshold)`` apart. With ``reach`` 1 the walk ends at that
    distance, so recall is 1 by construction; a part of it saves visits and
    may lose links. Every pair is met once, in the later of the two cells, and
    verified. Cells of any size are cut into blocks of ``block_rows`` index
    and query rows, and blocks return sums and spanning forests, not pairs.
    """
    spark = vectors.sparkSession
    element = vectors.select(F.col(vector_col).alias("v")).schema["v"].dataType.elementType.simpleString()
    kind = "<f4" if element == "float" else "<f8"
    source = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).alias("v") if element == "float" else F.col(vector_col).cast("array<double>").alias("v"),
    )
    rows = source.mapInArrow(_valid(kind), "vec_id long, label string, vec binary")
    keys = [F.xxhash64("label", "vec").alias("k1"), F.xxhash64("vec", F.lit(0), "label").alias("k2")]
    rows = written(rows.select("vec_id", "label", "vec", *keys), "rows")
    distinct = rows.filter("vec IS NOT NULL").groupBy("k1", "k2").agg(
        F.first("label").alias("label"), F.first("vec").alias("vec"),
        F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("first"),
    )
    distinct = written(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct")

    codes = min(MOST_CODES, max(1, math.ceil(math.sqrt(distinct.count() / CELL_ROWS))))
    sample = [r.vec for r in distinct.select("k1", "k2", "vec").orderBy("k1", "k2").limit(SAMPLE).collect()]
    grids = {}
    for size in {len(v) for v in sample}:
        units = _units([v for v in sample if len(v) == size], kind)
        cut = units.shape[1] // 2
        grids[units.shape[1]] = Grid((kmeans(units[:, :cut], codes), kmeans(units[:, cut:], codes)))

    distance = reach * math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    filed = distinct.select("vec", "node", "weight", "label").mapInArrow(
        _entries(grids, kind, distance), "vec binary, node long, weight long, label string, cell long, own boolean"
    )
    filed = written(filed.withColumn("size", F.length("vec")), "filed")
    where = ["label", "size", "cell"]
    sizes = filed.groupBy(*where).agg(
        F.ceil(F.count_if("own") / block_rows).cast("int").alias("pieces"),
        F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("chunks"),
    )
    sizes = written(sizes.filter("pieces > 0"), "sizes")
    placed = filed.join(sizes, where)
    spread = F.xxhash64("node")
    asking = placed.select(
        *where, "node", "weight", "own", "vec", F.lit(True).alias("asks"),
        F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"),
        F.pmod(spread, F.col("chunks")).cast("int").alias("chunk"),
    )
    asked = placed.filter("own").select(
        *where, "node", "weight", "own", "vec", F.lit(False).alias("asks"),
        F.pmod(spread, F.col("pieces")).cast("int").alias("piece"),
        F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
    )
    shards = max(1, filed.count() // SHARD_ROWS)
    shard = F.pmod(F.xxhash64(*where, "piece", "chunk"), F.lit(shards)).alias("shard")
    found = asking.unionByName(asked).groupBy(shard).applyInPandas(
        _block_links(threshold, kind), "node long, links long, root long"
    )
    found = written(found, "found")
    removed(filed, sizes)
    parts = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    nodes = distinct.select("k1", "k2", "node", "weight", "first").join(counts, "node", "left")
    nodes = nodes.join(parts.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left")
    nodes = nodes.select(
        "k1", "k2", "first", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("component", "node").alias("component"),
    )
    nodes = written(nodes, "nodes")
    removed(distinct, found, parts)
    least = nodes.groupBy("component").agg(F.min("first").alias("component_id"))
    named = written(nodes.join(least, "component").select("k1", "k2", "n_links", "component_id"), "named")
    removed(nodes)
    linking = rows.filter("vec IS NOT NULL").select("vec_id", "k1", "k2").join(named, ["k1", "k2"])
    linking = linking.select("vec_id", "n_links", "component_id")
    alone = rows.filter("vec IS NULL").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linking.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
