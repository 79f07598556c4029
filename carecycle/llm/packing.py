"""Sum-of-squares packing of token sequences into training windows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carecycle.llm import tokens

WINDOW = 4096
OPEN_WINDOWS = 1024  # windows that one task keeps partially filled
END_ID = 2
ROWS_OUT = 1024
KEPT = 200_000  # chunks and pre-tokens that a worker's encoder remembers, each


@dataclass
class Piece:
    """A run of one document's ids at its place in a sequence."""

    doc: object
    start: int
    ids: np.ndarray
    doc_tokens: int
    sequence: int = 0
    offset: int = 0


@dataclass
class Packer:
    """Online packing of one stream of documents.

    A document longer than the window gives whole windows first. What is left
    of it is put where it keeps the sum over fill levels h of N(h)^2 smallest,
    N(h) being the number of windows filled up to h: moving a window from h to
    h + s changes that sum by 2 N(h + s) + 1 - (2 N(h) - 1), where full and
    untouched windows don't count; of equal levels the fullest is taken.
    ``levels`` is that array; ``windows`` has the pieces.

    When too many windows are open, and at the end, the open ones are emptied
    and their pieces are cut to fill windows to the brim. The rest that can't
    fill a window is cut at powers of two, at which sequences aren't padded. So
    nothing is padded, and a piece is cut about once per open window.
    """

    window: int = WINDOW
    open_windows: int = OPEN_WINDOWS
    sequences: int = 0
    levels: np.ndarray = field(init=False)
    windows: dict[int, list[list[Piece]]] = field(init=False)
    count: int = 0

    def __post_init__(self):
        self.levels = np.zeros(self.window + 1, np.int64)
        self.windows = {}

    def add(self, doc: object, ids: np.ndarray) -> Iterator[Piece]:
        """Places a document; gives the pieces whose place is now final."""
        n = len(ids)
        whole = n - n % self.window
        for start in range(0, whole, self.window):
            yield from self._close([Piece(doc, start, ids[start : start + self.window], n)])
        if whole < n:
            yield from self._place(Piece(doc, whole, ids[whole:].copy() if whole else ids, n))
        if self.count > self.open_windows:
            yield from self.flush()

    def _place(self, piece: Piece) -> Iterator[Piece]:
        size = len(piece.ids)
        at = self.levels[: self.window - size + 1]
        cost = 2 * (self.levels[size:] - at) + 2
        cost[0] -= 1  # an untouched window leaves no level
        cost[-1] -= 1  # a full one enters none
        allowed = at > 0
        allowed[0] = True
        cost[~allowed] = np.iinfo(np.int64).max
        level = len(cost) - 1 - int(cost[::-1].argmin())
        if level:
            held = self.windows[level].pop()
            self.levels[level] -= 1
            self.count -= 1
        else:
            held = []
        held.append(piece)
        if level + size == self.window:
            yield from self._close(held)
        else:
            self.windows.setdefault(level + size, []).append(held)
            self.levels[level + size] += 1
            self.count += 1

    def _close(self, pieces: list[Piece]) -> Iterator[Piece]:
        at = 0
        for p in pieces:
            p.sequence, p.offset = self.sequences, at
            at += len(p.ids)
            yield p
        self.sequences += 1

    def flush(self) -> Iterator[Piece]:
        """Empties the open windows, fullest first, into sequences without padding."""
        pieces = [p for level in sorted(self.windows, reverse=True) for w in self.windows[level] for p in w]
        self.levels[:] = 0
        self.windows, self.count = {}, 0
        left = sum(len(p.ids) for p in pieces)
        held, room, space = [], 0, 0
        for p in pieces:
            while True:
                if not room:
                    if held:
                        yield from self._close(held)
                    space = self.window if left >= self.window else 1 << (left.bit_length() - 1)
                    held, room = [], space
                take = min(room, len(p.ids))
                held.append(Piece(p.doc, p.start, p.ids[:take], p.doc_tokens))
                room -= take
                left -= take
                if take == len(p.ids):
                    break
                p = Piece(p.doc, p.start + take, p.ids[take:], p.doc_tokens)
        if held:
            yield from self._close(held)


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS, vocabulary: str | None = None,
) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset) of all documents.

    ids is binary, little-endian unsigned 32-bit numbers. Every document's ids end with one end id, so null and empty texts give a
    piece of that id alone. Each id lies in exactly one piece; the pieces of a
    sequence fill it from offset 0 without gaps; every sequence has ``window``
    ids or a power of two below that. Each input partition is packed as one
    stream where it lies, without a shuffle, with at most ``open_windows``
    windows in memory. sequence_id has the partition in its upper 31 bits and
    the place in the partition in the others. Repeated rows and null ids are
    packed like any other row; other columns are ignored; an empty table gives
    no pieces.
    """
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(vocabulary, kept=KEPT)
        packer = Packer(window, open_windows)
        base = TaskContext.get().partitionId() << 33
        rows: list[Piece] = []

        def batch(rows: list[Piece]) -> pa.RecordBatch:
            lengths = [len(p.ids) for p in rows]
            columns = [
                pa.array([p.doc for p in rows], pa.int64()),
                pa.array([p.start for p in rows], pa.int64()),
                pa.array(lengths, pa.int64()),
                pa.array([p.ids.tobytes() for p in rows], pa.binary()),
                pa.array([p.doc_tokens for p in rows], pa.int64()),
                pa.array([base + p.sequence for p in rows], pa.int64()),
                pa.array([p.offset for p in rows], pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(columns, names)

        for part in batches:
            for doc, ids in zip(part.column(0).to_pylist(), encoder.packed_all(part.column(1))):
                rows.extend(packer.add(doc, np.append(np.frombuffer(ids, "<u4"), np.uint32(END_ID))))
                while len(rows) >= ROWS_OUT:
                    yield batch(rows[:ROWS_OUT])
                    del rows[:ROWS_OUT]
        rows.extend(packer.flush())
        for i in range(0, len(rows), ROWS_OUT):
            yield batch(rows[i : i + ROWS_OUT])

    source = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return source.mapInArrow(
        of,
        "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long",
    )
