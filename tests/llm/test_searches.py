"""Searches and look-ups against their definitions, row by row."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from carecycle.llm import negatives, queries, variants

FOLDER = "/root/testdata/sf0.001"


def plain_negatives(rows, asks, positives=5, k=5, least=80):
    """Integers of any size, all pairs, sorted."""
    known = []
    for at, (vec_id, label, v) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        known.append((at, vec_id, label, [int(math.floor(256 * x)) for x in v]))
    out = []
    for at, vec_id, label, v in known:
        if vec_id is None or not asks(vec_id):
            continue
        scored = [
            (-sum(x * y for x, y in zip(v, w)), other is None, other or 0, i, kind)
            for i, other, kind, w in known if i != at and len(w) == len(v)
        ]
        scored.sort()
        for s, none, p, _, _ in [x for x in scored if x[4] == label][:positives]:
            inside = [x for x in scored if x[4] != label and -least * s <= -100 * x[0] <= -100 * s][:k]
            for rank, (t, unnamed, q, _, _) in enumerate(inside, 1):
                out.append((vec_id, None if none else p, rank, None if unnamed else q, -s, -t))
    return sorted(out, key=str)


def as_rows(found):
    return sorted(
        [(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in found.collect()],
        key=str,
    )


@pytest.mark.parametrize("shard, block", [(8192, 1024), (37, 5)])
def test_hard_negatives(spark, shard, block):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(300):
        base = rng.standard_normal(6) if i % 3 or not rows else np.array(rows[int(rng.integers(len(rows)))][2])
        rows.append((i, int(rng.integers(0, 4)), [float(x) for x in np.round(base * 2) / 2]))  # many ties
    one = [0.5] * 6
    rows += [(400, None, one), (402, 1, None), (404, 1, [None] + one[1:]), (406, 1, [math.nan] + one[1:])]
    rows += [(408, 1, [math.inf] + one[1:]), (410, 1, one), (410, 1, one), (None, 1, one), (None, 2, one), (412, 2, [])]
    rows += [(414, 1, []), (416, 3, [0.0] * 6), (418, 3, one[1:]), (420, 2, one[1:]), (422, 3, [-1.0, 0.0, 0.0, 0.0, 0.0])]
    rows += [((1 << 60) + 4 * i, i % 2, one) for i in range(6)]  # ids beyond double precision
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("shard", F.lit("clash"))
    got = negatives.mine(df, F.col("vec_id") % 4 == 0, shard_rows=shard, anchor_rows=block)
    want = plain_negatives(rows, lambda i: i % 4 == 0)
    assert len(want) > 200 and as_rows(got) == want
    assert negatives.mine(df.filter("false"), F.lit(True)).count() == 0
    assert negatives.mine(df, F.lit(False)).count() == 0


def test_hard_negatives_of_giant_components(spark):
    """Products beyond double precision stay exact; what no 64 bits can hold does not crash."""
    rows = [(i, i % 2, [float(1 << 20) + i / 256, 3.0 * i]) for i in range(8)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert as_rows(negatives.mine(df, F.lit(True))) == plain_negatives(rows, lambda i: True)
    wild = [(1, 1, [1e200, 1.0]), (2, 1, [1e200, 2.0]), (3, 2, [1e200, -1.0]), (4, 2, [1e-200, 1.0]), (5, 2, [1e308, 0.0])]
    df = spark.createDataFrame(wild, "vec_id long, label int, embedding array<double>")
    got = as_rows(negatives.mine(df, F.lit(True)))
    assert (1, 2, 1, 3, (1 << 63) - 1, (1 << 63) - 1) in got and not any(5 in r[:2] + r[3:4] for r in got)


def test_threshold_stops_early():
    """Few candidates are met where the anchor's list sets the best apart."""
    x = np.zeros((5000, 3))
    x[:, 0] = np.arange(5000)
    lists = negatives.Lists(x)
    found, scores = lists.top(np.array([2.0, 0, 0]), [(-np.inf, np.inf)], 5, np.ones(5000, bool))[0]
    assert 5 <= len(found) <= 2 * negatives.STEP and sorted(scores)[-5:] == [9990, 9992, 9994, 9996, 9998]
    found, _ = lists.top(np.array([-1.0, 0, 0]), [(-10, -8)], 5, np.ones(5000, bool))[0]
    assert sorted(found) == [8, 9, 10]


def test_hard_negatives_query(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in rows]
    assert as_rows(queries.op11_hard_negatives(spark, FOLDER)) == plain_negatives(rows, lambda i: i % 100 == 0)


def plain_words(rows):
    seen = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if h % 199 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            seen[word] += 1
    return {w: n for w, n in seen.items() if len(w) >= 6 and n >= 5}


def plain_groups(words):
    """Near words by comparing the words with one code point left out."""
    holes, bare = collections.defaultdict(set), collections.defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[i, w[:i], w[i + 1 :]].add(w)
            bare[w[:i] + w[i + 1 :]].add(w)
    forms, out = {}, []
    for w, n in words.items():
        near = set().union(*(holes[i, w[:i], w[i + 1 :]] for i in range(len(w)))) | bare[w]
        near |= {w[:i] + w[i + 1 :] for i in range(len(w))} & words.keys()
        near -= {w}
        best = min(near, key=lambda x: (-words[x], x), default=None)
        forms[w] = (best if best and words[best] >= 5 * n else None, len(near))
    for w, n in words.items():
        root = w
        while forms[root][0]:
            root = forms[root][0]
        form, near = forms[w]
        out.append((w, form, root, n, near, words[form] if form else None))
    return sorted(out, key=str)


def as_words(found):
    return sorted([(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in found.collect()], key=str)


def test_variants_of_few_letters(spark):
    """Runs of equal letters, words within words, ties, chains of forms, letters beyond the alphabet."""
    rng = np.random.default_rng(8)
    words = {}
    for _ in range(400):
        word = "".join(rng.choice(list("aabé")) for _ in range(int(rng.integers(1, 14))))
        words[word] = int(rng.choice([5, 5, 7, 25, 130, 700, 4000]))
    for i in range(40):  # long paths, told apart at the end, at the start and inside
        words["x" * 40 + "a" * i] = 6 * i + 5
        words["y" * i + "z" * 300 + "y"] = 5 ** (i % 6)
        words["w" * 20 + chr(0x4E00 + i) + "v" * 20] = i + 1
    df = spark.createDataFrame(list(words.items()), "word string, n long").withColumn("no", F.lit("clash"))
    got, want = as_words(variants.group_variants(df)), plain_groups(words)
    assert got == want
    assert sum(r[4] for r in want) > 1000 and any(r[1] and r[2] != r[1] for r in want)
    assert variants.group_variants(df.filter("false")).count() == 0
    with pytest.raises(ValueError):
        variants.group_variants(df, ratio=1)


def test_words_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(variants, "COUNTER_WORDS", 3)
    rows = [(i, "Couleur ÉTÉS étés× couleur coulleur COULEUR x1abcdefg_hijklmno") for i in range(300)]
    rows += [(None, "couleur"), (1, "couleur"), (1, "couleur"), (2, None), (3, ""), (4, "q" * 5000 + " " + "7" * 50)] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("word", F.lit(1))
    got = variants.count_words(df, drop_one_in=199)
    want = plain_words(rows)
    assert dict(map(tuple, got.collect())) == want and "q" * 5000 in want
    assert as_words(variants.group_variants(got)) == plain_groups(want)
    assert variants.count_words(df.filter("false")).count() == 0


def test_variants_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    want = plain_groups(plain_words(rows))
    assert as_words(queries.op12_spelling_variants(spark, FOLDER)) == want and any(r[1] for r in want)
