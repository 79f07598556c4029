"""Token ids of whole texts by the tokenizers library, remembered per chunk of text."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNKS_KEPT = 700_000  # in two generations, like the pieces
PIECES_KEPT = 700_000
TOGETHER = 1 << 23  # bytes of texts whose chunks are told apart together

# Characters that need no composition, whose lower case depends on nothing
# around them, and which are letters, digits or neither in every Unicode version.
_PLAIN = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-ÿ]+")
_letters = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
# Other frequent ones: letters, then signs that begin neither a contraction nor a special token.
_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=-@\[-`{-~]*)")
# The first of these kinds, as Arrow knows them.
_SIGNS = ".,;:!?"
_SIMPLE = f"^[A-Za-zÀ-ÖØ-öø-ÿ]+[{_SIGNS}]?$"
# What the vocabulary's own pattern finds in lower-cased plain characters.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def chunks(text: str | None) -> list[str]:
    """The parts of a text between ASCII spaces, tabs and line ends, empty ones included."""
    return (text or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


def plain_pieces(chunk: str) -> list[str] | None:
    """The pre-tokens of a chunk of plain characters; None for any other chunk."""
    sign = chunk[-1]
    if sign in _SIGNS:  # most chunks: letters, or letters and a sign
        if _letters(chunk[:-1]):
            return [chunk[:-1].lower(), sign]
    elif _letters(chunk):
        return [chunk.lower()]
    word = _WORD.fullmatch(chunk)
    if word:
        letters, signs = word.groups()
        return [letters.lower(), signs] if signs else [letters.lower()]
    if _PLAIN.fullmatch(chunk) and "<|" not in chunk:
        return _PIECES.findall(chunk.lower())
    return None


@lru_cache(1)
def byte_symbols() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class ChunkEncoder(dict):
    """Ids as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    The vocabulary's normaliser turns white space into a space that no
    pre-token keeps, and neither composition nor pre-tokens reach across white
    space. So a text's ids are those of its chunks, and a chunk that many texts
    share is encoded once: this dictionary maps chunks to the bytes of their
    ids. Chunks of plain characters are cut into pre-tokens here and encoded by
    the library's model, which saves most of a call; all others go through the
    whole library. Bounded numbers of chunks and pre-tokens are remembered:
    when half as many are, they become the older half, whose members are taken
    over when they are met again, so what is frequent stays. Ids take four
    bytes each, or two with ``narrow`` and a vocabulary of at most 2^16.
    ``kept`` bounds the chunks and the pre-tokens, each, in place of the module's
    bounds.
    """

    def __init__(self, path: str | None = None, narrow: bool = False, kept: int | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        self.chunks_kept, self.pieces_kept = kept or CHUNKS_KEPT, kept or PIECES_KEPT
        self.tokenizer = Tokenizer.from_file(path or default_vocabulary())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenize = self.tokenizer.model.tokenize
        ids = range(self.tokenizer.get_vocab_size())
        self.width = 2 if narrow and len(ids) <= 1 << 16 else 4
        self.packed = [i.to_bytes(self.width, "little") for i in ids]
        self.older: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.older_pieces: dict[str, bytes] = {}
        self.symbols = dict(enumerate(byte_symbols()))

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is not None:
            return found
        if len(self.pieces) >= self.pieces_kept // 2:
            self.older_pieces, self.pieces = self.pieces, {}
        found = self.older_pieces.get(piece)
        if found is None:
            spelt = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.symbols)
            found = b"".join([self.packed[t.id] for t in self.tokenize(spelt)])
        self.pieces[piece] = found
        return found

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.chunks_kept // 2:
            self.older = dict(self)
            self.clear()
        found = self.older.get(chunk)
        if found is not None:
            self[chunk] = found
            return found
        pieces = plain_pieces(chunk) if chunk else []
        if pieces is None:
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
            found = np.array(ids, f"<u{self.width}").tobytes()
        else:
            found = b"".join(map(self._piece, pieces))
        self[chunk] = found
        return found

    def packed_ids(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned numbers of ``width`` bytes; a null text has none."""
        return b"".join(map(self.__getitem__, chunks(text)))

    def _of(self, find, keys: pa.Array) -> pa.Array:
        """What ``find`` gives for each key; it is asked once for equal ones."""
        coded = keys.dictionary_encode()
        found = list(map(find, coded.dictionary.to_numpy(zero_copy_only=False)))
        return pa.array(found, pa.large_binary()).take(coded.indices)

    def _packed_chunks(self, chunks: pa.Array) -> pa.Array:
        """The ids of each chunk; most are letters or letters and a sign, which are looked up by their lower-cased letters."""
        simple = pc.match_substring_regex(chunks, _SIMPLE)
        lower = pc.utf8_lower(chunks.filter(simple))
        letters = pc.utf8_rtrim(lower, _SIGNS)
        bare = pc.equal(pc.binary_length(letters), pc.binary_length(lower))
        signs = pc.if_else(bare, "", pc.utf8_slice_codeunits(lower, -1))
        signs = self._of(lambda sign: self._piece(sign) if sign else b"", signs)
        found = pc.binary_join_element_wise(self._of(self._piece, letters), signs, pa.scalar(b"", pa.large_binary()))
        rest = self._of(self.__getitem__, chunks.filter(pc.invert(simple)))
        simple = simple.to_numpy(zero_copy_only=False)
        at = np.where(simple, np.cumsum(simple), len(found) + np.cumsum(~simple)) - 1
        return pa.concat_arrays([found, rest]).take(pa.array(at, pa.int64()))

    def packed_all(self, texts: pa.Array) -> Iterator[bytes]:
        """``packed_ids`` of each text of an Arrow array, for less work.

        Arrow cuts about TOGETHER bytes of whole texts at ASCII white space and
        tells their chunks apart, so that each different chunk is looked up
        once, and then sets the chunks' ids in the texts' order.
        """
        ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(), dtype=np.int64)
        i = 0
        while i < len(texts):
            before = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, before + TOGETHER, "right")))
            parts = pc.ascii_split_whitespace(texts.slice(i, j - i).fill_null(""))
            coded = parts.flatten().dictionary_encode()
            ids = self._packed_chunks(coded.dictionary).take(coded.indices)
            _, at, raw = ids.buffers()
            bounds = np.frombuffer(at, np.int64)[parts.offsets].tolist()
            raw = memoryview(raw or b"")
            for a, b in zip(bounds, bounds[1:]):
                yield bytes(raw[a:b])
            del parts, coded, ids, at, raw
            pa.default_memory_pool().release_unused()
            i = j

    def encode(self, text: str | None) -> np.ndarray:
        """The same as an array."""
        return np.frombuffer(self.packed_ids(text), f"<u{self.width}")


@lru_cache(1)
def encoder(path: str | None = None, narrow: bool = False, kept: int | None = None) -> ChunkEncoder:
    """The encoder of this Python worker, kept from task to task.

    With ``narrow``, ids take two bytes where the vocabulary allows it.
    """
    return ChunkEncoder(path, narrow, kept)
