"""Removal of long repeated byte strings by blockwise suffix sorting with a difference cover."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carecycle.llm.storage import removed, written

LENGTH = 400
GRAM = 64  # bytes of an anchor
BLOCK = 1 << 17  # window starts of one text that are looked at together
GROUP_ROWS = 256  # contexts that may meet in a task because of one key
SHARD_ROWS = 512  # contexts that are sorted together
BUCKET = 1 << 16  # suffixes that are sorted at a time
CODE = 8  # bytes of a word's hash
TEXTS = 1024  # texts that a task holds as Python objects together

# Fixed values: {0, 1, 3} is a difference cover modulo 7; every difference
# modulo 7 is that of two of its members.
PERIOD = 7
COVER = (0, 1, 3)

_WORD = re.compile(rb"[^\t-\r ]+")
_MULTIPLIER = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n - 1, base, np.uint64)])


class Anchors:
    """Cuts the window starts of a text into intervals whose windows share an anchor.

    The anchor of a window of ``length`` bytes is the ``gram`` bytes in it with
    the least hash, the leftmost of equal ones. It depends on the window's bytes
    alone, so equal windows have equal anchors wherever they stand.
    """

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram = length, gram
        self.up = _powers(_MULTIPLIER, BLOCK + length + 1)
        self.down = _powers(pow(_MULTIPLIER, -1, 1 << 64), BLOCK + length + 1)

    def of(self, text: bytes) -> tuple[np.ndarray, ...]:
        """(first window start, last window start, the anchor's place and hash) of each interval."""
        found = [self._block(text, i) for i in range(0, len(text) - self.length + 1, BLOCK)]
        if not found:
            return (np.zeros(0, np.int64),) * 4
        return tuple(np.concatenate(x) for x in zip(*found))

    def _block(self, text: bytes, start: int):
        raw = np.frombuffer(text, np.uint8, min(BLOCK + self.length - 1, len(text) - start), start)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[: len(raw)], out=total[1:])
        h = (total[self.gram :] - total[: -self.gram]) * self.down[: len(raw) + 1 - self.gram]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        low = np.uint64((1 << 21) - 1)  # BLOCK + length is less
        least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        span, width = 1, self.length - self.gram + 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: len(least) - width + span], least[width - span :])
        first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        last = np.r_[first[1:], len(least)] - 1
        at = (least[first] & low).astype(np.int64)
        return first + start, last + start, at + start, h[at].view(np.int64)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most TEXTS rows, so that what is made of a batch stays small."""
    for batch in batches:
        for i in range(0, batch.num_rows, TEXTS):
            yield batch.slice(i, TEXTS)
        pa.default_memory_pool().release_unused()


def _digests(parts: Iterator[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, parts)), "<i8").reshape(-1, 2)


def word_codes(text: bytes) -> bytes:
    """The hashes of a text's words, cut at ASCII white space, CODE bytes each."""
    return b"".join(map(xxhash.xxh64_digest, text.split()))


def _sparse(text: bytes, lo: np.ndarray, hi: np.ndarray, length: int, words: int) -> tuple[np.ndarray, ...]:
    """(interval's index, first, last) of each run of window starts with at most ``words`` word starts inside.

    The first byte of a window isn't counted, as it depends on the byte before.
    """
    raw = np.frombuffer(text, np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    begins = np.cumsum(np.r_[0, ~space & np.r_[True, space[:-1]]], dtype=np.int64)
    few = begins[length:] - begins[1 : len(begins) - length + 1] <= words
    if few.all():
        return np.arange(len(lo)), lo, hi
    if not few.any():
        return (np.zeros(0, np.int64),) * 3
    cut = np.zeros(len(few), bool)  # intervals follow each other without gaps
    cut[lo] = True
    first = np.flatnonzero(few & (cut | ~np.r_[False, few[:-1]]))
    last = np.flatnonzero(few & np.r_[cut[1:] | ~few[1:], True])
    return np.searchsorted(lo, first, "right") - 1, first, last


def _anchor_rows(length: int, gram: int, code=bytes, words: int | None = None):
    """A row for each interval, with the digest of all bytes of its windows."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length, gram)
        for batch in _parts(batches):
            k1, k2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            out = []
            for i, text in enumerate(batch.column(2).to_pylist()):
                text = code(text)
                lo, hi, at, key = anchors.of(text)
                if words is not None and len(lo):
                    of, lo, hi = _sparse(text, lo, hi, length, words)
                    at, key = at[of], key[of]
                if len(lo):
                    u = _digests(text[a : b + length] for a, b in zip(lo.tolist(), hi.tolist()))
                    n = len(lo)
                    out.append((key, u[:, 0], u[:, 1], np.full(n, k1[i]), np.full(n, k2[i]), lo, hi, at))
            if out:
                columns = [pa.array(np.concatenate(c)) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "u1", "u2", "k1", "k2", "lo", "hi", "at"])

    return rows


_INTERVAL = "key long, u1 long, u2 long, k1 long, k2 long, lo long, hi long, at long"


def _settle(rows: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(intervals that are known to occur elsewhere, intervals to sort, tables that both are read from).

    Of equal intervals two are sorted, for all of them, so that the order of
    suffixes finds their repeat; the others are copies and go with them by a
    count. An interval without a copy is sorted if its key has others. Rows
    that repeat a document's id and text are one to the sort, so where all
    copies are such rows the count decides alone.
    """
    row = F.struct("k1", "k2", "lo")
    per_text = rows.groupBy("key", "u1", "u2").agg(
        F.count(F.lit(1)).alias("copies"), F.min(row).alias("one"), F.max(row).alias("other")
    )
    per_text = written(per_text, "intervals")
    per_key = per_text.groupBy("key").agg(
        F.count(F.lit(1)).alias("different"), F.sum("copies").alias("all")
    )
    per_key = per_key.filter("all > 1").select("key", "different")
    marks = written(per_text.join(per_key, "key"), "marks")
    seen = rows.join(marks, ["key", "u1", "u2"])
    several, apart = F.col("copies") > 1, F.col("one") != F.col("other")
    stands = (F.col("one") == row) | (F.col("other") == row)
    counted = several & ~(stands & apart)
    settled = seen.filter(counted).select("k1", "k2", "lo", "hi")
    to_sort = seen.filter(F.when(several, stands & (apart | (F.col("different") > 1))).otherwise(F.col("different") > 1))
    to_sort = to_sort.withColumn("settled", counted).drop("copies", "one", "other")
    return settled, to_sort, [per_text, marks]


def _contexts(length: int, far: int, code=bytes):
    """Adds the bytes of its windows to each interval of a document's list."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            k1, k2, texts, lists = (c.to_pylist() for c in batch.columns)
            out = [
                (x["key"], a, b, x["lo"], x["hi"], x["at"], 0, far, x["different"], x["settled"],
                 text[x["lo"] : x["hi"] + length])
                for a, b, text, items in zip(k1, k2, map(code, texts), lists)
                for x in items
            ]
            for i in range(0, len(out), 4096):
                part = zip(*out[i : i + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in part], _CONTEXT_NAMES)

    return rows


# Windows of a row start from ``far`` to ``near`` bytes before its anchor at ``at``.
_CONTEXT = (
    "key long, k1 long, k2 long, lo long, hi long, at long, near long, far long, "
    "different long, settled boolean, bytes binary"
)
_CONTEXT_NAMES = ["key", "k1", "k2", "lo", "hi", "at", "near", "far", "different", "settled", "bytes"]
_HALF = _INTERVAL + ", near long, far long, bytes binary"
_HALF_NAMES = ["key", "u1", "u2", "k1", "k2", "lo", "hi", "at", "near", "far", "bytes"]


def _halves(length: int):
    """Cuts each row in two at the middle of its distances from the anchor.

    The new key of a half is the bytes that windows at all its distances share,
    which every window of the half has, so equal windows stay together.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for k1, k2, lo, hi, at, near, far, text in zip(*(c.to_pylist() for c in batch.columns)):
                middle = (near + far) // 2
                for a, b in ((near, middle), (middle + 1, far)):
                    first, last = max(lo, at - b), min(hi, at - a)
                    if first <= last:
                        core = text[at - a - lo : at - b + length - lo]
                        whole = text[first - lo : last + length - lo]
                        parts.append((k1, k2, first, last, at, a, b, whole, core))
            if parts:
                *columns, whole, core = zip(*parts)
                key, u = _digests(iter(core)), _digests(iter(whole))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (key[:, 0], u[:, 0], u[:, 1], *columns)] + [pa.array(whole, pa.binary())],
                    _HALF_NAMES,
                )

    return rows


def cover_ranks(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(ranks, names, span): ranks, by at least ``depth`` bytes, of the suffixes at the cover's positions, 0 elsewhere.

    names are those of an earlier round, equal where ``span`` bytes are, the
    most that leave eight bytes of ``depth``; without such a round span is 0.
    ``text`` ends with at least 2 * depth + 8 bytes of padding. Names of
    PERIOD bytes are doubled: a suffix's next name is PERIOD * 2^k further on,
    where the cover has a position again.
    """
    n = len(text) - 2 * depth - 8
    words = _words(text)
    at = np.flatnonzero(np.isin(np.arange(n + depth) % PERIOD, COVER))
    rank = np.zeros(len(text), np.int64)
    rank[at] = np.unique(words[at] >> np.uint64(8 * (8 - PERIOD)), return_inverse=True)[1]
    step, names, span = PERIOD, rank, 0
    while step < depth:
        if step <= depth - 8:
            names, span = rank.copy(), step
        both = rank[at] * len(text) + rank[np.minimum(at + step, len(text) - 1)]
        rank[at] = np.unique(both, return_inverse=True)[1]
        step *= 2
    return rank, names, span


def _words(text: np.ndarray) -> np.ndarray:
    """The big-endian number that the eight bytes from each position make."""
    return np.lib.stride_tricks.as_strided(text[:8].view(">u8"), (len(text) - 7,), (1,)).astype(np.uint64)


def _shift(r: int, s: int) -> int:
    """The least shift that brings residues r and s both into the cover."""
    return next(d for d in range(PERIOD) if (r + d) % PERIOD in COVER and (s + d) % PERIOD in COVER)


# The shifts of all pairs of residues.
SHIFTS = np.array([[_shift(r, s) for s in range(PERIOD)] for r in range(PERIOD)])


def sort_bucket(suffixes: np.ndarray, words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Suffix positions of one bucket in order: by eight bytes, ties by cover ranks.

    Two suffixes with equal heads are compared at the shift that takes both
    into the cover. Of longer ties, members are counted class by class of their
    positions modulo PERIOD: the rank of a suffix is the number of members
    before it in every class, found by binary search.
    """
    suffixes = suffixes[np.argsort(words[suffixes], kind="stable")]
    head = words[suffixes]
    tie = np.cumsum(np.r_[0, head[1:] != head[:-1]])
    size = np.bincount(tie)
    first = np.flatnonzero(size[tie] == 2)[::2]  # of each pair
    a, b = suffixes[first], suffixes[first + 1]
    d = SHIFTS[a % PERIOD, b % PERIOD]
    swap = first[rank[a + d] > rank[b + d]]
    suffixes[swap], suffixes[swap + 1] = suffixes[swap + 1], suffixes[swap]
    inside = np.flatnonzero(size[tie] > 2)
    if not len(inside):
        return suffixes
    x, t = suffixes[inside], tie[inside]
    scale = len(rank)
    classes = [np.flatnonzero(x % PERIOD == r) for r in range(PERIOD)]
    before = np.zeros(len(x), np.int64)
    for s in range(PERIOD):
        ordered: dict[int, np.ndarray] = {}
        for r in range(PERIOD):
            d = _shift(r, s)
            if d not in ordered:
                ordered[d] = np.sort(t[classes[s]] * scale + rank[x[classes[s]] + d])
            at = classes[r]
            before[at] += np.searchsorted(ordered[d], t[at] * scale + rank[x[at] + d])
    suffixes[inside] = x[np.lexsort((before, t))]
    return suffixes


def repeated_windows(texts: list[bytes], length: int = LENGTH, bucket: int = BUCKET) -> list[np.ndarray]:
    """For each text, whether the window from each of its starts occurs elsewhere in ``texts``.

    The texts stand in one array. Window starts are dealt into buckets by their
    first eight bytes and one bucket is sorted at a time; neighbours in order
    are then compared over the whole length, by the cover's names of long
    stretches, so memory beyond the text and the cover's ranks is that of one
    bucket.
    """
    ends = np.cumsum([len(t) for t in texts])
    text = np.frombuffer(b"".join(texts) + bytes(2 * length + 16), np.uint8)
    rank, names, span = cover_ranks(text, length)
    words = _words(text)
    start = np.zeros(len(text), bool)
    for end, t in zip(ends, texts):
        start[end - len(t) : max(end - length + 1, end - len(t))] = True
    starts = np.flatnonzero(start)
    starts = starts[np.argsort(words[starts], kind="stable")] if len(starts) > bucket else starts
    again = np.zeros(len(text), bool)
    i = 0
    while i < len(starts):
        j = min(i + bucket, len(starts))
        if j < len(starts):  # equal heads stay together
            j = int(np.searchsorted(words[starts], words[starts[j - 1]], "right"))
        order = sort_bucket(starts[i:j], words, rank)
        a, b = order[:-1], order[1:]
        same = (words[a] == words[b]) & (words[a + length - 8] == words[b + length - 8])
        a, b = a[same], b[same]
        if span:  # from the shift on, names that follow each other; the last ends in the last eight bytes
            d = SHIFTS[a % PERIOD, b % PERIOD]
            last = d + (length - span - d) // PERIOD * PERIOD
            for offset in range(0, length, span):
                at = np.minimum(d + offset, last)
                same = names[a + at] == names[b + at]
                a, b, d, last = a[same], b[same], d[same], last[same]
        else:
            for offset in range(8, length - 8, 8):
                same = words[a + offset] == words[b + offset]
                a, b = a[same], b[same]
        again[a] = again[b] = True
        i = j
    return [again[end - len(t) : max(end - length + 1, end - len(t))] for end, t in zip(ends, texts)]


def _shard_spans(length: int):
    def spans(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["k1", "k2", "lo"], ignore_index=True)
        out = []
        for row, again in zip(rows.itertuples(), repeated_windows(list(rows["bytes"]), length)):
            if not row.settled:
                edge = np.flatnonzero(np.diff(np.r_[False, again, False]))
                out += [(row.k1, row.k2, row.lo + a, row.lo + b - 1) for a, b in zip(edge[::2], edge[1::2])]
        return pd.DataFrame(out, columns=["k1", "k2", "lo", "hi"]).astype("int64")

    return spans


def _word_runs(text: bytes, items: list[dict], words: int) -> list[tuple[int, int]]:
    """The bytes from the first to the last word of the windows of ``words`` words that start in intervals of codes."""
    found = [(-(-x["lo"] // CODE), x["hi"] // CODE + words) for x in items]
    if not found:
        return []
    at = [m.span() for m in _WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in found if b - a >= words]


def _keep(length: int, as_text: bool, words: int | None = None):
    """The bytes of a text outside the windows that start in its intervals."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            texts, lists = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            kept, spans = [], []
            for text, items in zip(texts, lists):
                runs, parts, at = [], [], 0
                plain = [(x["lo"], x["hi"] + length) for x in items or [] if not x["coded"]]
                for x in sorted(plain + _word_runs(text, [x for x in items or [] if x["coded"]], words)):
                    if runs and x[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], x[1])
                    else:
                        runs.append([*x])
                for a, b in runs:
                    parts.append(text[at:a])
                    at = b
                parts.append(text[at:])
                left = b"".join(parts)
                kept.append(left.decode("utf-8", "ignore") if as_text else left)
                spans.append([{"start": a, "end": b} for a, b in runs])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(list(map(len, texts)), pa.int64()),
                 pa.array(kept, pa.string() if as_text else pa.binary()), pa.array(spans, span)],
                ["row", "n_bytes", "kept", "spans"],
            )

    return rows


def _repeats(
    source: DataFrame, length: int, gram: int, group_rows: int, shard_rows: int, code=bytes, words: int | None = None
) -> list[DataFrame]:
    """Tables (k1, k2, lo, hi): intervals of starts of windows that occur elsewhere too, in the texts as ``code`` gives them."""
    found = source.select("k1", "k2", "text").mapInArrow(_anchor_rows(length, gram, code, words), _INTERVAL)
    anchors = written(found, "anchors")
    settled, to_sort, read = _settle(anchors)
    spans = [written(settled, "settled")]
    lists = to_sort.groupBy("k1", "k2").agg(
        F.collect_set(F.struct("key", "lo", "hi", "at", "different", "settled")).alias("items")
    )
    lists = written(lists, "lists")
    removed(anchors, *read)
    contexts = source.select("k1", "k2", "text").join(lists, ["k1", "k2"])
    contexts = contexts.mapInArrow(_contexts(length, length - gram, code), _CONTEXT)
    contexts = written(contexts.dropDuplicates(["key", "k1", "k2", "lo"]), "contexts")  # repeated rows
    removed(lists)
    kept, ready = [contexts], []
    while True:
        ready.append(contexts.filter(F.col("different") <= group_rows).select(_CONTEXT_NAMES))
        large = contexts.filter(F.col("different") > group_rows)
        if large.isEmpty():
            break
        cut = large.select("k1", "k2", "lo", "hi", "at", "near", "far", "bytes")
        cut = written(cut.mapInArrow(_halves(length), _HALF), "halves")
        settled, to_sort, read = _settle(cut)
        spans.append(written(settled, "settled"))
        contexts = written(to_sort.select(_CONTEXT_NAMES), "contexts")
        removed(cut, *read)
        kept.append(contexts)
    rows = ready[0]
    for more in ready[1:]:
        rows = rows.union(more)
    shards = max(1, rows.count() // shard_rows)
    sorted_out = rows.groupBy(F.pmod("key", F.lit(shards)).alias("shard")).applyInPandas(
        _shard_spans(length), "k1 long, k2 long, lo long, hi long"
    )
    spans.append(written(sorted_out, "sorted"))
    removed(*kept)
    return spans


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
    gram: int = GRAM, group_rows: int = GROUP_ROWS, shard_rows: int = SHARD_ROWS, as_text: bool = False,
    words: int | None = None,
) -> DataFrame:
    """(row, n_bytes, kept, spans array of start and end) of every document.

    row is a struct of the columns of ``docs`` without the text.

    A byte goes if it lies in a string of ``length`` bytes that starts at
    another place too, in this or another document; spans are the maximal runs
    of such bytes and kept is the rest, both in UTF-8 bytes. A null text counts
    as empty; texts shorter than ``length`` are kept whole; repeated rows are
    documents of their own, so long ones lose all their bytes; other columns,
    null ids among them, are passed on; an empty table gives no rows. kept is
    binary, or with ``as_text`` a string in which the cut characters at the
    edges of spans are left out.

    With ``words``, a passage of that many words that starts at another place
    too goes as well, whatever its length and the white space in it (ASCII
    white space parts words). The texts' words are hashed to CODE bytes each and
    the windows of ``words`` codes go the same way as those of ``length`` bytes;
    of the latter, only those with at most ``words`` word starts inside are looked
    at, since others hold a passage of ``words`` words or are it but for the
    cut words at their ends.

    Every window of ``length`` bytes belongs to the anchor that its content
    selects, and windows of one anchor form an interval. Intervals that share
    an anchor are dealt by it into shards of about ``shard_rows``, whose
    suffixes are sorted bucket by bucket with a difference cover; of equal
    intervals two are sorted and the others, their copies, go with them. Under
    an anchor with more than ``group_rows`` different intervals, these are
    halved and dealt anew by the longer string that the windows of each half
    share, until no such group is left. The text is never sent to a task by a
    key that documents share. Tables in between are deleted as soon as they are
    used up.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    doc_id = F.col(id_col).cast("long")
    source = docs.select(
        row.alias("row"), F.xxhash64(doc_id, text).alias("k1"),
        F.xxhash64(text, F.lit(length), doc_id).alias("k2"), text.alias("text"),
    )
    sizes = group_rows, shard_rows
    plain = _repeats(source, length, gram, *sizes, words=words)
    coded = _repeats(source, CODE * words, gram, *sizes, code=word_codes) if words is not None else []
    parts = [t.withColumn("coded", F.lit(False)) for t in plain] + [t.withColumn("coded", F.lit(True)) for t in coded]
    spans = reduce(DataFrame.union, parts)
    per_doc = spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "hi", "coded")).alias("spans"))
    per_doc = written(per_doc, "spans")
    removed(*plain, *coded)
    whole = source.join(per_doc, ["k1", "k2"], "left")
    kind = source.schema["row"].dataType.simpleString()
    return whole.select("row", "text", "spans").mapInArrow(
        _keep(length, as_text, words),
        f"row {kind}, n_bytes long, kept {'string' if as_text else 'binary'}, "
        "spans array<struct<start: bigint, end: bigint>>",
    )
