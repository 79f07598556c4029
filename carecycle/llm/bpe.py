"""Byte-pair encoding and decoding by batched merge rounds in numpy."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carecycle.llm.tokens import byte_symbols, chunks, default_vocabulary, plain_pieces

CHUNKS_KEPT = 200_000
PIECES_KEPT = 100_000
TOGETHER = 1 << 20  # characters whose new words are merged in one batch
NEVER = np.iinfo(np.int64).max


class Vocabulary:
    """Symbols, merges and special tokens of a vocabulary file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text = [""] * self.size
        for token, i in [*vocab.items(), *self.special.items()]:
            self.text[i] = token
        end = model.get("end_of_word_suffix") or ""
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.final = np.array([vocab[s + end] for s in symbols], np.int64)
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        key = left * self.size + right
        order = np.argsort(key, kind="stable")
        first = np.r_[True, np.diff(key[order]) > 0]  # of a pair listed twice, the lower rank
        order = order[first]
        self.keys, self.ranks, self.made = key[order], order, made[order]
        born = np.full(self.size, -1)
        np.maximum.at(born, made, np.arange(len(made)))
        rank = np.arange(len(made))
        #: If no merge uses what a later one makes, all places of a word's lowest pair can be merged at once.
        self.at_once = bool(np.all(born[left] < rank) and np.all(born[right] < rank))
        self.pattern = regex.compile(next(
            p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"
        ))
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")

    def pieces(self, chunk: str) -> list[str]:
        """The pre-tokens of a chunk of text; special tokens stand for themselves."""
        plain = plain_pieces(chunk) if chunk else []
        if plain is not None:
            return plain
        out = []
        for i, part in enumerate(self.specials.split(chunk)):
            if i % 2:
                out.append(part)
            else:
                # Case is changed character by character, without the final form of sigma.
                low = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                out += self.pattern.findall(low)
        return out

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of many words, all merged together.

        The symbols of all words lie in one array. In each round the neighbours
        of every word are looked up among the sorted pair keys, and each word's
        pairs of the lowest rank are merged, from the left where they overlap.
        Words without a pair left leave the array.
        """
        raw = np.frombuffer(b"".join(words), np.uint8)
        size = np.array([len(w) for w in words], np.int64)
        if not len(raw):
            return [np.zeros(0, np.uint32) for _ in words]
        word = np.repeat(np.arange(len(words)), size)
        symbol = self.inner[raw]
        last = np.flatnonzero(np.r_[word[1:] != word[:-1], True])
        symbol[last] = self.final[raw[last]]
        done_word, done_symbol = [], []
        while len(symbol):
            key = symbol[:-1] * self.size + symbol[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = (self.keys[at] == key) & (word[:-1] == word[1:])
            rank = np.append(np.where(known, self.ranks[at], NEVER), NEVER)
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            length = np.diff(np.r_[start, len(word)])
            least = np.minimum.reduceat(rank, start)
            lowest = np.repeat(least, length)
            over = lowest == NEVER
            if over.any():
                done_word.append(word[over])
                done_symbol.append(symbol[over])
            chosen = (rank == lowest) & ~over
            place = np.flatnonzero(chosen)
            if len(place):
                run = np.cumsum(np.r_[True, np.diff(place) > 1])
                head = place[np.r_[True, np.diff(run) > 0]]
                take = (place - head[run - 1]) % 2 == 0  # in a run of overlapping pairs, every other one
                if not self.at_once:
                    take &= np.r_[True, word[place[1:]] != word[place[:-1]]]
                place = place[take]
                symbol = symbol.copy()
                symbol[place] = self.made[at[place]]
            keep = ~over
            keep[place + 1] = False
            symbol, word = symbol[keep], word[keep]
        word, symbol = np.concatenate(done_word), np.concatenate(done_symbol)
        symbol = symbol[np.argsort(word, kind="stable")].astype(np.uint32)
        return np.split(symbol, np.cumsum(np.bincount(word, minlength=len(words)))[:-1])


class Encoder:
    """Encodes texts; a chunk and a word that occur again are merged once."""

    def __init__(self, path: str | None = None):
        self.vocabulary = Vocabulary(path or default_vocabulary())
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Unsigned 32-bit ids of each text; a null text has none."""
        parts = [chunks(t) for t in texts]
        if len(self.known) > CHUNKS_KEPT:
            self.known.clear()
        if len(self.words) > PIECES_KEPT:
            self.words.clear()
        new = set().union(*parts).difference(self.known)
        pieces = {c: self.vocabulary.pieces(c) for c in new}
        words = list(set().union(*pieces.values()).difference(self.words))
        special = self.vocabulary.special
        for word, ids in zip(words, self.vocabulary.merge([w.encode() for w in words])):
            self.words[word] = np.array([special[word]], "<u4").tobytes() if word in special else ids.tobytes()
        for chunk, found in pieces.items():
            self.known[chunk] = b"".join(map(self.words.__getitem__, found))
        known = self.known.__getitem__
        return [np.frombuffer(b"".join(map(known, p)), "<u4") for p in parts]


@lru_cache(2)
def encoder(path: str | None = None) -> Encoder:
    """The encoder of this Python worker, kept from task to task."""
    return Encoder(path)


def _slices(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows that hold about ``most`` together, one row at least."""
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids array) of every document.

    Whole texts are encoded as the tokenizers library does with the vocabulary
    file, without tokens added around them. Null and empty texts have no ids;
    null doc_ids and repeated rows stay; other columns are ignored; an empty
    table gives no rows.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _slices([len(t or "") for t in texts], TOGETHER):
                found = own.encode(texts[a:b])
                edges = pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32))
                ids = pa.array(np.concatenate(found).view(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(edges, ids)], ["doc_id", "ids"]
                )

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string"))
    return source.mapInArrow(rows, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Adds decoded to (doc_id, ids): the tokens joined by spaces, special ones included.

    That is the library's decoding for a vocabulary without a decoder. Null or
    empty ids give an empty text.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = encoder(vocabulary).vocabulary.text.__getitem__
        for batch in batches:
            ids = batch.column(1)
            lengths = [n or 0 for n in ids.value_lengths().to_pylist()]
            for a, b in _slices(lengths, TOGETHER // 4):
                texts = [" ".join(map(token, x.as_py() or ())) for x in ids.slice(a, b - a)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), ids.slice(a, b - a), pa.array(texts, pa.string())],
                    ["doc_id", "ids", "decoded"],
                )

    return encoded.select("doc_id", "ids").mapInArrow(rows, "doc_id long, ids array<int>, decoded string")
