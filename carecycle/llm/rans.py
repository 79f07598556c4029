"""Token ids on disk, entropy-coded by a range asymmetric numeral system."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carecycle.llm import tokens
from carecycle.llm.storage import removed, written

BITS = 20  # frequencies add up to 2^BITS
LANES = 256  # states of one block that take turns
BLOCK = 1 << 16  # ids from which a block is closed, and of a document's piece at most
STEPS = 128  # steps from one checkpoint to the next
TOGETHER = 16  # blocks that are coded together
LOW = np.uint64(1 << 31)  # states lie in [LOW, LOW << 32)
END_ID = 2

_32, _BITS = np.uint64(32), np.uint64(BITS)


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Whole frequencies that add up to 2^BITS, at least 1 for every id that occurs."""
    total, scale = int(counts.sum()), 1 << BITS
    if not total:
        return np.zeros(len(counts), np.int64)
    if np.count_nonzero(counts) > scale:
        raise ValueError(f"more than {scale} different ids")
    freq = np.maximum((counts > 0).astype(np.int64), (counts.astype(float) * scale / total).astype(np.int64))
    order = np.argsort(-freq, kind="stable")
    over = int(freq.sum()) - scale
    if over < 0:
        freq[order[0]] -= over
    while over > 0:  # the most frequent give way
        for i in order:
            give = min(over, int(freq[i]) // 2)
            freq[i] -= give
            over -= give
            if not over:
                break
    return freq


class Coder:
    """Encodes and decodes many blocks at once with one shared table.

    Id i of a block belongs to lane i mod LANES and step i div LANES. Lanes
    are coded backwards; a lane whose state would grow too large first sends
    32 bits to the block's words, which are kept in the order in which decoding
    asks for them: by step, then by lane. A checkpoint has all states of a
    block before a step and the place in its words, so a block can be read
    from there alone.
    """

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.first = (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, blocks: list[np.ndarray]) -> list[tuple[bytes, bytes]]:
        """(words, checkpoints) of each block of ids."""
        sizes = np.array([len(b) for b in blocks])
        steps = -(-int(sizes.max()) // LANES)
        ids = np.zeros((len(blocks), steps * LANES), np.uint32)
        for row, block in zip(ids, blocks):
            row[: len(block)] = block
        ids = ids.reshape(len(blocks), steps, LANES)
        state = np.full((len(blocks), LANES), LOW)
        sent = np.zeros((len(blocks), steps, LANES), bool)
        words = np.zeros((len(blocks), steps, LANES), np.uint32)
        marks: dict[int, np.ndarray] = {}
        lane = np.arange(LANES)
        for t in reversed(range(steps)):
            active = (t * LANES + lane) < sizes[:, None]
            now = ids[:, t]
            f, c = self.freq[now], self.first[now]
            full = active & (state >= (f << np.uint64(63 - BITS)))
            sent[:, t] = full
            words[:, t] = state  # the low 32 bits
            x = np.where(full, state >> _32, state)
            q = x // np.maximum(f, np.uint64(1))
            state = np.where(active, (q << _BITS) + (x - q * f) + c, state)
            if t % STEPS == 0:
                marks[t] = state
        out = []
        for i, size in enumerate(sizes):
            used = range(0, max(1, -(-int(size) // LANES)), STEPS)
            per_step = np.r_[0, np.cumsum(sent[i].sum(1))]
            points = [np.r_[np.uint64(per_step[t]), marks[t][i]] for t in used]
            out.append((words[i][sent[i]].astype("<u4").tobytes(), np.concatenate(points).astype("<u8").tobytes()))
        return out

    def decode(self, blocks: list[tuple[int, bytes, bytes]]) -> list[np.ndarray]:
        """The ids of blocks (size, words, checkpoints); all checkpoints are read side by side."""
        states, places, sizes, owner = [], [], [], []
        base = 0
        for i, (size, words, points) in enumerate(blocks):
            points = np.frombuffer(points, "<u8").reshape(-1, 1 + LANES)
            for k, point in enumerate(points):
                states.append(point[1:])
                places.append(base + int(point[0]))
                sizes.append(min(STEPS * LANES, size - k * STEPS * LANES))
                owner.append(i)
            base += len(words) // 4
        words = np.frombuffer(b"".join(w for _, w, _ in blocks) + bytes(4 * LANES), "<u4")
        state, place, count = np.array(states, np.uint64), np.array(places), np.array(sizes)
        steps = -(-int(count.max()) // LANES)
        out = np.zeros((len(state), steps, LANES), np.uint32)
        lane, mask = np.arange(LANES), np.uint64((1 << BITS) - 1)
        for t in range(steps):
            active = (t * LANES + lane) < count[:, None]
            slot = state & mask
            now = self.symbol[slot.astype(np.int64)]
            out[:, t] = now
            x = self.freq[now] * (state >> _BITS) + slot - self.first[now]
            empty = active & (x < LOW)
            ahead = np.cumsum(empty, 1)
            at = np.where(empty, place[:, None] + ahead - 1, 0)
            state = np.where(empty, (x << _32) | words[at], np.where(active, x, state))
            place = place + ahead[:, -1]
        found: list[list[np.ndarray]] = [[] for _ in blocks]
        for i, n, row in zip(owner, sizes, out.reshape(len(out), -1)):
            found[i].append(row[:n])
        return [np.concatenate(x) for x in found]


def _tokenised(vocabulary: str | None, block: int):
    """Ids with the end id, in pieces of at most ``block``, numbered along the partition; at the end the number of each id."""

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 6 + [pa.binary()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], _PIECE_NAMES)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(vocabulary, narrow=True)
        width = encoder.width
        part, seq = TaskContext.get().partitionId(), 0
        counts = np.zeros(0, np.int64)
        end = END_ID.to_bytes(width, "little")
        for batch in batches:
            out, size = [], width * block
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.packed_all(batch.column(1))):
                ids += end
                pieces = -(-len(ids) // size)
                if pieces == 1:
                    out.append((part, seq, doc, 0, 1, width, ids, None))
                else:
                    out += [(part, seq, doc, k, pieces, width, ids[k * size : (k + 1) * size], None) for k in range(pieces)]
                seq += 1
            if out:
                found = np.bincount(np.frombuffer(b"".join(r[6] for r in out), f"<u{width}"))
                counts = np.pad(counts, (0, max(0, len(found) - len(counts))))
                counts[: len(found)] += found
                yield table(out)
        ids = np.flatnonzero(counts)
        yield table([(None,) * 6 + (ids.astype("<u4").tobytes(), counts[ids].astype("<i8").tobytes())])

    return rows


_PIECES = "part long, seq long, doc_id long, piece long, pieces long, width long, ids binary, counts binary"
_PIECE_NAMES = ["part", "seq", "doc_id", "piece", "pieces", "width", "ids", "counts"]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n): the counts of all parts that a task reads, added up."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        for ids, counts in zip(*(c.to_pylist() for c in batch.columns)):
            ids = np.frombuffer(ids, "<u4")
            if len(ids):
                total = np.pad(total, (0, max(0, int(ids[-1]) + 1 - len(total))))
                total[ids] += np.frombuffer(counts, "<i8")
    ids = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["id", "n"])


_BLOCKS = (
    "part long, seq long, piece long, n_tokens long, split boolean, seqs array<bigint>, doc_ids array<bigint>, "
    "pieces array<bigint>, lengths array<bigint>, words binary, checkpoints binary, crc32 long"
)
_BLOCK_NAMES = [
    "part", "seq", "piece", "n_tokens", "split", "seqs", "doc_ids", "pieces", "lengths", "words", "checkpoints", "crc32",
]


def _encoded(freq: np.ndarray, block: int):
    """Blocks of consecutive whole documents, or of pieces of documents longer than a block."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq)
        ready: list[tuple] = []
        held: list[tuple] = []
        n, before = 0, None

        def close():
            nonlocal held, n
            if held:
                part, seqs, docs, pieces, split, ids = zip(*held)
                ready.append((part[0], seqs[0], pieces[0], split[0], seqs, docs, pieces, [len(x) // 4 for x in ids], b"".join(ids)))
            held, n = [], 0

        def out() -> pa.RecordBatch:
            coded = coder.encode([np.frombuffer(r[-1], "<u4") for r in ready])
            columns = zip(*(
                (*r[:3], len(r[-1]) // 4, *r[3:-1], words, points, zlib.crc32(r[-1]))
                for r, (words, points) in zip(ready, coded)
            ))
            ready.clear()
            kinds = [pa.int64()] * 4 + [pa.bool_()] + [pa.list_(pa.int64())] * 4 + [pa.binary()] * 2 + [pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], _BLOCK_NAMES)

        for batch in batches:
            for part, seq, doc, piece, pieces, width, ids in zip(*(c.to_pylist() for c in batch.columns)):
                split = pieces > 1
                follows = (part, seq - (piece == 0))
                if n >= 4 * block or held and (held[-1][4] != split or before != follows):
                    close()
                before = (part, seq)
                ids = ids if width == 4 else np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes()
                held.append((part, seq, doc, piece, split, ids))
                n += len(ids)
                if len(ready) >= TOGETHER:
                    yield out()
        close()
        if ready:
            yield out()

    return rows


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
          vocabulary: str | None = None, block: int = BLOCK) -> None:
    """Writes the ids of all documents in ascending order of doc_id below ``path``.

    ``path``/table has the shared frequencies (id, freq), counted over all ids,
    and ``path``/blocks the blocks (part, seq, piece, n_tokens, split, seqs,
    doc_ids, pieces, lengths, words, checkpoints, crc32) as Parquet rows: parts
    are ranges of doc_id in order, seqs numbers a part's documents, and a block
    closes at ``block`` ids, so each can be decoded alone and anywhere. It
    holds whole documents, or with ``split`` pieces of documents that are
    longer than a block themselves, so no text makes a block large; seq and
    piece are those it begins with. crc32 covers the block's ids as
    little-endian unsigned 32-bit numbers. Every document ends with the end id;
    a null text is empty; null ids come first, equal ids stand in the order of
    their texts' hashes, so an id with many rows is cut into several ranges. An
    empty table writes no blocks.

    The text is shuffled once, by range; ids are counted as they are made, and
    written once in between, as the shared table must be known before the
    first block.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    ordered = source.repartitionByRange(*order).sortWithinPartitions(*order)
    found = written(ordered.mapInArrow(_tokenised(vocabulary, block), _PIECES), "ids", compression="zstd")
    counts = found.filter("counts IS NOT NULL").select("ids", "counts").mapInArrow(_counted, "id long, n long")
    rows = counts.groupBy("id").agg(F.sum("n").alias("n")).collect()  # at most one for each id of the vocabulary
    counts = np.zeros(max([r.id for r in rows], default=0) + 1, np.int64)
    for r in rows:
        counts[r.id] = r.n
    freq = frequencies(counts)
    table = [(i, int(freq[i])) for i in np.flatnonzero(freq).tolist()]
    spark.createDataFrame(table, "id long, freq long").coalesce(1).write.parquet(f"{path}/table")
    pieces = found.filter("counts IS NULL").select(_PIECE_NAMES[:-1])
    pieces.mapInArrow(_encoded(freq, block), _BLOCKS).write.parquet(f"{path}/blocks")
    removed(found)


_READ = "part long, seq long, piece long, at long, doc long, doc_piece long, doc_id long, n_tokens long, ids binary"
_READ_NAMES = ["part", "seq", "piece", "at", "doc", "doc_piece", "doc_id", "n_tokens", "ids"]


def _decoded(freq: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq)
        for batch in batches:
            for i in range(0, len(batch), TOGETHER):
                blocks = batch.slice(i, TOGETHER).to_pylist()
                found = coder.decode([(b["n_tokens"], b["words"], b["checkpoints"]) for b in blocks])
                out = []
                for b, ids in zip(blocks, found):
                    raw = ids.astype("<u4").tobytes()
                    if zlib.crc32(raw) != b["crc32"]:
                        raise ValueError(f"block {b['part']}/{b['seq']}: the checksum does not match")
                    at = np.r_[0, np.cumsum(b["lengths"])].tolist()
                    out += [
                        (b["part"], b["seq"], b["piece"], a, doc, piece, doc_id, e - a, raw[4 * a : 4 * e])
                        for doc, piece, doc_id, a, e in zip(b["seqs"], b["pieces"], b["doc_ids"], at, at[1:])
                    ]
                kinds = [pa.int64()] * 8 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], _READ_NAMES)

    return rows


def read(spark: SparkSession, path: str) -> DataFrame:
    """(part, seq, piece, at, doc_id, n_tokens, ids binary) of every document in the files at ``path``.

    part, seq and piece name the block in which it begins, at is its place
    there. Blocks are decoded independently and their checksums verified;
    pieces of documents longer than a block are put together again.
    """
    table = spark.read.parquet(f"{path}/table").collect()
    freq = np.zeros(max([r.id for r in table], default=0) + 1, np.int64)
    for r in table:
        freq[r.id] = r.freq
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    columns = ["part", "seq", "piece", "at", "doc_id", "n_tokens", "ids"]
    whole = blocks.filter("NOT split").mapInArrow(_decoded(freq), _READ).select(columns)
    pieces = blocks.filter("split").mapInArrow(_decoded(freq), _READ)
    joined = pieces.groupBy("part", "doc", "doc_id").agg(
        F.sort_array(F.collect_list(F.struct("doc_piece", "seq", "piece", "at", "ids"))).alias("p"),
        F.sum("n_tokens").alias("n_tokens"),
    )
    # The ids of one document: joined in hexadecimal, as Spark has no function that joins an array of binaries.
    ids = F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), ""))
    first = F.col("p")[0]
    return whole.union(joined.select("part", first["seq"], first["piece"], first["at"], "doc_id", "n_tokens", ids))


def with_starts(docs: DataFrame, path: str) -> DataFrame:
    """Adds start, the number of ids of all documents before, to rows of ``read``.

    The blocks' sizes are summed along each part, and the parts' sums, a row
    for each range partition, along all.
    """
    block = ["part", "seq", "piece"]
    blocks = docs.sparkSession.read.schema(_BLOCKS).parquet(f"{path}/blocks").select(*block, "n_tokens")
    along = Window.partitionBy("part").orderBy("seq", "piece").rowsBetween(Window.unboundedPreceding, -1)
    inside = blocks.withColumn("inside", F.coalesce(F.sum("n_tokens").over(along), F.lit(0)))
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    over_all = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(over_all), F.lit(0)).alias("before"))
    starts = inside.join(parts, "part").select(*block, (F.col("before") + F.col("inside")).alias("block_start"))
    return docs.join(starts, block).withColumn("start", F.col("block_start") + F.col("at"))
