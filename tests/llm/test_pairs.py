"""Near-duplicate operators against their definitions, pair by pair."""

import os
import re
import sys

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from carecycle.llm import components, embeddings, queries, simhash

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)

import corpus_pipeline  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def groups(links, n):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 60, (40, 2))] + [(i, i + 1) for i in range(100, 130)]
    links += [(200, i) for i in range(201, 240)]  # a hub
    rows = spark.createDataFrame([*links, (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(rows).collect()}
    want = groups(links, 240)
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {i: want[i] for i in linked}
    assert components.connected_components(rows.filter("false")).count() == 0


def plain_simhash(text):
    text = (text or "").translate({i: i + 32 for i in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


TEXTS = [
    "one two three four", "ONE two  three\tfour", "", None, " \n ", "a", "a b", "É a b É\x1fb c", "x " * 3000,
    "one two three four five six seven eight nine ten", "one two three four five six seven eight nine TEN",
]


def test_fingerprints(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    got = {r.doc_id: int(r.fingerprint, 16) for r in simhash.near_duplicates(df).collect()}
    assert got == {i: plain_simhash(t) for i, t in rows}


@pytest.mark.parametrize("radius, nodes", [(2, 8), (1, 2048), (3, 5)])
def test_links_of_crowded_fingerprints(spark, radius, nodes):
    """Every link survives small trees, cut keys and a ball of near fingerprints."""
    rng = np.random.default_rng(radius)
    centre = int(rng.integers(0, 1 << 62))
    fps = {centre}
    for _ in range(120):
        fp = centre
        for b in rng.integers(0, 64, int(rng.integers(1, 7))):
            fp ^= 1 << int(b)
        fps.add(fp)
    fps |= {int(x) for x in rng.integers(0, 1 << 62, 50)}
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    points = np.array(fps, np.int64).view(np.uint64)
    near = [
        (i, j) for i in range(len(points)) for j in np.flatnonzero(np.bitwise_count(points ^ points[i]) <= radius)
    ]
    want = groups(near, len(fps))
    found = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in fps], "fp long"), radius, nodes)
    place = {x: i for i, x in enumerate(fps)}
    got = groups([(place[r.a], place[r.b]) for r in found.collect()], len(fps))
    assert got == want


def test_tree_finds_what_a_scan_finds():
    rng = np.random.default_rng(3)
    points = np.unique(rng.integers(0, 1 << 12, 300).astype(np.uint64))
    tree = simhash.BKTree(points)
    q, node = tree.within(points, 2)
    want = {(i, j) for i in range(len(points)) for j in np.flatnonzero(np.bitwise_count(points ^ points[i]) <= 2)}
    assert set(zip(q.tolist(), node.tolist())) == want and len(q) == len(want)
    assert len(simhash.BKTree(points[:0]).within(points, 2)[0]) == 0


def test_simhash_groups(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(None, rows[0][1]), (rows[0][0], rows[0][1]), (None, "quite on its own here"), (5000, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    fps = np.array([plain_simhash(t) for _, t in rows], np.uint64)
    near = [(i, j) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 2)]
    part = groups(near, len(rows))
    least = {}
    for (doc, _), p in zip(rows, part):
        if doc is not None:
            least[p] = min(doc, least.get(p, doc))
    want = sorted((str(doc), f"{int(fp):016x}", str(least.get(p))) for (doc, _), fp, p in zip(rows, fps, part))
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(df).collect())
    assert got == want
    assert simhash.near_duplicates(df.filter("false")).count() == 0


def plain_vectors(rows, threshold=0.98):
    links, n_links = [], [0] * len(rows)
    for i, (_, label, a) in enumerate(rows):
        for j, (_, other, b) in enumerate(rows):
            if i == j or label is None or label != other or not a or not b or len(a) != len(b):
                continue
            if None in a or None in b:
                continue
            x, y = np.array(a, np.longdouble), np.array(b, np.longdouble)  # of wider range
            size = np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())
            if np.isfinite(size) and size > 0 and (x * y).sum() / size >= threshold:
                links.append((i, j))
                n_links[i] += 1
    part = groups(links, len(rows))
    least = {}
    for (vec, _, _), p in zip(rows, part):
        if vec is not None:
            least[p] = min(vec, least.get(p, vec))
    return sorted(
        (str(r[0]), n, str(least.get(p)), least.get(p) == r[0]) for r, n, p in zip(rows, n_links, part)
    )


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CELL_ROWS", 8)  # many cells
    rng = np.random.default_rng(0)
    rows = []
    for i in range(250):
        base = rng.standard_normal(8) if i % 3 or not rows else np.array(rows[int(rng.integers(len(rows)))][2])
        rows.append((i, int(rng.integers(0, 3)), [float(x) for x in base + rng.standard_normal(8) * 0.05 * (i % 2)]))
    one = [1.0] * 8
    rows += [(300, None, one), (301, 1, None), (302, 1, [0.0] * 8), (303, 1, [None] + one[1:]), (304, 1, one)]
    rows += [(305, 1, [float("nan")] + one[1:]), (306, 1, [float("inf")] + one[1:]), (304, 1, one), (None, 1, one)]
    rows += [(307, 1, one[1:]), (308, 1, [2.0] * 7), (309, 2, [])]
    for i, x in enumerate((1e200, 1e-200, 5e-324, 1.7e308)):
        rows += [(310 + 3 * i, 2, [x] * 8), (311 + 3 * i, 2, [x] * 8), (312 + 3 * i, 1, [x] + [0.0] * 7)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("cell", F.lit(1))
    want = plain_vectors(rows)
    for block in (7, 512):
        got = embeddings.near_duplicates(df, block_rows=block).collect()
        assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got) == want
    assert embeddings.near_duplicates(df.filter("false")).count() == 0


def test_walk_visits_cells_in_order():
    rng = np.random.default_rng(5)
    grid = embeddings.Grid((rng.standard_normal((5, 4)), rng.standard_normal((7, 4))))
    for a, b in zip(*grid.gaps(rng.standard_normal((20, 8)))):
        cost = (a**2)[:, None] + (b**2)[None, :]
        visited = list(grid.cells(a, b, 0.6))
        assert sorted(visited) == sorted(np.flatnonzero(cost.ravel() <= 0.36).tolist())
        assert (np.diff(cost.ravel()[visited]) >= 0).all()


def test_recall_of_the_walk(spark):
    """With full reach nothing is lost, on any data; a tenth of it loses few links of this table."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = queries.op1_multi_index(spark, "/root/testdata/sf0.1").agg(F.sum("n_links")).first()[0]
    rows = [tuple(r) for r in table.select("vec_id", "label", "embedding").collect()]
    total = 0
    for label in {r[1] for r in rows}:
        x = np.array([r[2] for r in rows if r[1] == label], float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        total += int((x @ x.T >= 0.98).sum()) - len(x)
    assert want == total
    part = embeddings.near_duplicates(table, reach=0.5).agg(F.sum("n_links")).first()[0]
    assert part >= 0.9 * total
