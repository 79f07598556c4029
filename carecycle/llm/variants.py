"""Spelling variants found with a dictionary of trie-node pairs."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carecycle.llm.storage import removed, written

LEAST_LETTERS = 6
LEAST_COUNT = 5
RATIO = 5  # a form occurs so many times as often
DROP_ONE_IN = 199

BATCH_ROWS = 1 << 16
COUNTER_WORDS = 1 << 17  # distinct words that a task counts before it hands them on
SHARD_PAIRS = 1 << 18
SHALLOW = 7  # bytes of a path that its node's number holds itself

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {i: i + 32 for i in range(ord("A"), ord("Z") + 1)}
_NONE = np.iinfo(np.int64).max
_PAIR = "p long, s long, no long, kind byte"


def _counts(least: int, drop_one_in: int | None):
    """(word, n) of the words that occur in a task's texts, each maybe several times."""

    def table(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"]
        )

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                name = "" if doc is None else doc
                for run, n in Counter(_RUN.findall(text)).items():
                    word = run.lower() if run.isascii() else run.translate(_LOWER)
                    if drop_one_in:
                        h = zlib.crc32(f"{name}:{word}".encode())
                        if h % drop_one_in == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                    if len(word) >= least:
                        seen[word] += n
                if len(seen) >= COUNTER_WORDS:
                    yield table(seen)
                    seen.clear()
        yield table(seen)

    return of


def count_words(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS,
    least_count: int = LEAST_COUNT, drop_one_in: int | None = None,
) -> DataFrame:
    """(word, n): the runs of Latin letters in all texts, A-Z in lower case, and how often they occur.

    Letters are A-Z, a-z and the code points from U+00C0 to U+00FF. Words of
    fewer than ``least_letters`` code points or ``least_count`` occurrences
    are left out. With ``drop_one_in``, a run whose crc32 of '<id>:<run>' that
    number divides loses one code point first (the crc32 modulo its length),
    as if it were misspelt; a null id counts as an empty one. Null texts have
    no words; repeated rows count each; other columns are ignored.
    """
    source = docs.select(F.col(id_col).cast("string"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    found = source.mapInArrow(_counts(least_letters, drop_one_in), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def trie_path(word: str) -> list[int | bytes]:
    """The nodes from the root along ``word``: a number for shallow ones, a 128-bit digest of the path for deeper ones."""
    path, digest = b"", xxhash.xxh3_128()
    nodes: list[int | bytes] = [1]
    for letter in word:
        step = letter.encode()
        digest.update(step)
        if len(path) <= SHALLOW:
            path += step
        nodes.append(int.from_bytes(b"\1" + path) if len(path) <= SHALLOW else digest.digest())
    return nodes


def _deep_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(no, place, d1, d2): the nodes of a word that have no number yet, forward ones at their depth, reversed ones at minus theirs."""
    names = ["no", "place", "d1", "d2"]

    def table() -> pa.RecordBatch:
        halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (nos, places, *halves.T)], names)

    nos, places, digests = [], [], []
    for batch in batches:
        for no, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for sign, letters in ((1, word), (-1, word[::-1])):
                for depth, node in enumerate(trie_path(letters)):
                    if isinstance(node, bytes):
                        nos.append(no)
                        places.append(sign * depth)
                        digests.append(node)
            if len(nos) >= BATCH_ROWS:
                yield table()
                nos, places, digests = [], [], []
    yield table()


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(p, s, no, kind) of each word: the prefix's and the suffix's node at every cut, and around every letter.

    kind is 0 where the two meet. Where a letter is skipped between them it is
    2 if the letter repeats the one before, so that leaving out either gives
    the same word, and 1 otherwise.
    """
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int8()]

    def table() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip((p, s, nos, kind), kinds)], ["p", "s", "no", "kind"]
        )

    p, s, nos, kind = [], [], [], []
    for batch in batches:
        for no, word, deep in zip(*(c.to_pylist() for c in batch.columns)):
            number = {x["place"]: x["node"] for x in deep or []}
            forward = [x if isinstance(x, int) else number[i] for i, x in enumerate(trie_path(word))]
            back = [x if isinstance(x, int) else number[-i] for i, x in enumerate(trie_path(word[::-1]))][::-1]
            p += forward + forward[:-1]
            s += back + back[1:]
            kind += [0] * len(forward) + [1] + [1 + (a == b) for a, b in zip(word, word[1:])]
            nos += [no] * (2 * len(word) + 1)
            if len(p) >= BATCH_ROWS:
                yield table()
                p, s, nos, kind = [], [], [], []
    yield table()


def _near(rows: pd.DataFrame) -> pd.DataFrame:
    """(no, n_near, best): how many near words each entry of a pair's group has, and the first of them.

    Words that skip a letter between the same nodes differ in that letter
    alone; the word in which these nodes meet is theirs without it.
    """
    p, s, no, kind = (rows[c].to_numpy() for c in ("p", "s", "no", "kind"))
    order = np.lexsort((no, kind == 0, s, p))
    p, s, no, kind = p[order], s[order], no[order], kind[order]
    new = np.r_[True, (p[1:] != p[:-1]) | (s[1:] != s[:-1])]
    group, start = np.cumsum(new) - 1, np.flatnonzero(new)
    cut, once = kind == 0, kind == 1
    skipping, dropping = (np.bincount(group[x], minlength=len(start)) for x in (~cut, once))
    least = no[start]  # of the words that skip, if there are any
    second = np.where(skipping > 1, no[np.minimum(start + 1, len(no) - 1)], _NONE)
    without = np.full(len(start), _NONE)
    without[group[cut]] = no[cut]
    first_with = np.full(len(start), _NONE)
    np.minimum.at(first_with, group[once], no[once])

    shorter = np.where(once, without[group], _NONE)
    replaced = np.where(no == least[group], second[group], least[group])
    near = np.where(cut, dropping[group], skipping[group] - 1 + (shorter < _NONE))
    best = np.where(cut, first_with[group], np.minimum(replaced, shorter))
    has = near > 0
    found = pd.DataFrame({"no": no[has], "n_near": near[has], "best": best[has]})
    return found.groupby("no", as_index=False).agg({"n_near": "sum", "best": "min"})


def near_words(words: DataFrame) -> DataFrame:
    """(no, n_near, best) of each row of ``words`` (no, word) that has near words.

    Two words are near if one inserted, deleted or replaced code point makes
    one of the other. n_near counts a word's near words, best is the least of
    their numbers. Words must be different and ``words`` a written table, as
    it is read more than once; an empty one gives no rows.

    The words' prefixes are the nodes of a trie, their suffixes those of the
    reversed words' trie. Shallow nodes carry their path as number, the others
    are numbered once in a table. Every word is filed under the pairs (prefix
    node, suffix node) at each of its cuts and around each of its letters, and
    near words are those that meet under a pair: at most one word has a pair
    as its cut, at most as many as the alphabet has letters skip one there, so
    no pair is crowded, and a group is counted without making pairs of it.
    """
    deep = written(words.select("no", "word").mapInArrow(_deep_nodes, "no long, place long, d1 long, d2 long"), "paths")
    nodes = deep.select("d1", "d2").distinct().withColumn("node", -1 - F.monotonically_increasing_id())
    nodes = written(nodes, "nodes")
    numbered = deep.join(nodes, ["d1", "d2"]).groupBy("no")
    numbered = numbered.agg(F.collect_list(F.struct("place", "node")).alias("deep"))  # twice the word's length at most
    pairs = words.join(numbered, "no", "left").select("no", "word", "deep").mapInArrow(_pairs, _PAIR)
    total = words.agg(F.coalesce(F.sum(2 * F.length("word") + 1), F.lit(0))).first()[0]
    shard = F.pmod(F.xxhash64("p", "s"), F.lit(max(1, -(-total // SHARD_PAIRS))))
    found = pairs.groupBy(shard.alias("shard")).applyInPandas(_near, "no long, n_near long, best long")
    near = written(found.groupBy("no").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best")), "near")
    removed(deep, nodes)
    return near


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each row of ``words`` (word, n).

    A word's form is its near word that occurs most often (of several the
    first in code-point order), if it occurs at least ``ratio`` times as often
    as the word; root is the last word reached by following forms, the word
    itself if it has none. form and form_n are null without a form; n_near
    counts all near words. Words with a null count or of no letter must not be
    in ``words``, nor a word twice; an empty table gives no rows.

    Words are numbered in descending order of n, then in code-point order, so
    the near word to choose is the one with the least number. Forms multiply n
    by ``ratio``, so the chains are short; they are followed by doubling.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, or forms could run in a circle")
    order = [F.desc("n"), F.asc("word")]
    counted = written(words.select("word", "n"), "words")
    ranked = counted.repartitionByRange(*order).sortWithinPartitions(*order)
    ranked = written(ranked.withColumn("no", F.monotonically_increasing_id()), "ranked")
    removed(counted)
    near = near_words(ranked)

    best = ranked.select(F.col("no").alias("best"), F.col("n").alias("best_n"))
    asked = ranked.select("no", "n").join(near.select("no", "best"), "no").join(best, "best")
    up = written(asked.filter(F.col("best_n") >= ratio * F.col("n")).select("no", F.col("best").alias("form")), "forms")
    roots = up.select("no", F.col("form").alias("root"))
    while True:
        above = roots.select(F.col("no").alias("root"), F.col("root").alias("next"))
        roots = written(roots.join(above, "root", "left").select("no", F.coalesce("next", "root").alias("root"), "next"), "roots")
        if roots.filter("next IS NOT NULL").isEmpty():
            break
        roots = roots.select("no", "root")

    form = ranked.select(F.col("no").alias("form_no"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    root = ranked.select(F.col("no").alias("root_no"), F.col("word").alias("root"))
    linked = up.join(roots.select("no", F.col("root").alias("root_no")), "no").withColumnRenamed("form", "form_no")
    linked = linked.join(form, "form_no").join(root, "root_no").select("no", "form", "form_n", "root")
    found = ranked.join(near.select("no", "n_near"), "no", "left").join(linked, "no", "left")
    return found.select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n",
    )
