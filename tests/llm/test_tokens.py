"""Encoding, packing and token files against the library and exact round trips."""

import collections
import hashlib
import os
import random
import sys
import zlib
from unittest import mock

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.join(ROOT, "checks")]

import corpus_pipeline  # noqa: E402
import parity  # noqa: E402
from carecycle.llm import bpe, chat, language, packing, queries, rans, simhash, suffixes, tokens  # noqa: E402
from carecycle.llm.storage import folder  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
POOL = (
    "aAbBéÉ́̈   \n\t\r'sSs'LLıİΣσς123½ﬁ中文हिन्दी👍🏽<|endoftext|>\x1c\x1f\x85​‍"
    "!?…%$_-가각ᄀªºµ×÷ßŒÿŸ\x00\x7f"
)
ODD = [
    (1, None), (2, ""), (3, "one"), (3, "one"), (None, "no id"), (4, "word " * 20000), (5, "a" * 3000), (6, "<|endoftext|>"),
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def strings(n):
    rng = random.Random(2)
    more = ["<|endoftext|>", "<|startoftext|>", "'s", "  ", "aaaaaaa", "!!!!!!!!!"]
    return [
        "".join(rng.choice(POOL) if rng.random() < 0.9 else rng.choice(more) for _ in range(rng.randint(0, 16)))
        for _ in range(n)
    ]


def test_both_encoders_agree_with_the_library(library, monkeypatch):
    cases = [*strings(6000), "a" * 2000, "!" * 1001, "é" * 999, "lol" * 700]
    monkeypatch.setattr(tokens, "CHUNKS_KEPT", 500)
    monkeypatch.setattr(tokens, "PIECES_KEPT", 300)
    remembered, own = tokens.ChunkEncoder(), bpe.Encoder()
    for text, ids in zip(cases, own.encode(cases)):
        want = library.encode(text, add_special_tokens=False).ids
        assert list(ids) == want and list(remembered.encode(text)) == want


@pytest.mark.parametrize("together", [8, 1 << 22])
def test_texts_of_a_batch_are_encoded_together(library, monkeypatch, together):
    monkeypatch.setattr(tokens, "TOGETHER", together)
    signs = [f"{x}{y}" for x in ("a", "É", "×", "1", "Σ", "ÿß") for y in (".", ",;", "?\u0301", "'s", "!", ".\x1c", "")]
    cases = [None, "", " ", *strings(500), " ".join(signs), *signs, "a\x0bb\x0cc \u0301\x0b\u0301", "é\tÉ\r\né", None]
    remembered = tokens.ChunkEncoder(narrow=True)
    want = [library.encode(t or "", add_special_tokens=False).ids for t in cases]
    for texts in (pa.array(cases), pa.array(["before", *cases, "after"], pa.large_string()).slice(1, len(cases))):
        got = list(remembered.packed_all(texts))
        assert [np.frombuffer(x, f"<u{remembered.width}").tolist() for x in got] == want
    assert list(remembered.packed_all(pa.array([], pa.string()))) == []


def test_a_workers_memory_stays_bounded(library):
    """Packing's encoder keeps few chunks, suffix removal takes a batch in parts, the next run drops the encoder."""
    encoder = tokens.encoder(kept=200)
    texts = [f"Word{i} x{chr(97 + i % 26)}{i}, {'ab' * (i % 50)}" for i in range(1500)]
    for text, ids in zip(texts, encoder.packed_all(pa.array(texts))):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(encoder) + len(encoder.older) <= 200 and len(encoder.pieces) + len(encoder.older_pieces) <= 200
    assert list(language._documents(None, "text")(iter([]))) == [] and not tokens.encoder.cache_info().currsize
    n = 2 * suffixes.TEXTS + 1
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(range(n)), pa.array([b"ab" * 30] * n)], ["k1", "k2", "text"])
    rows = list(suffixes._anchor_rows(40, 12)(iter([batch])))
    assert len(rows) == 3 and {x for r in rows for x in r.column(3).to_pylist()} == set(range(n))


def test_token_files_look_a_chunk_up_once_in_a_batch(monkeypatch):
    asked = collections.Counter()

    class Counted(tokens.ChunkEncoder):
        def __getitem__(self, chunk):
            asked[chunk] += 1
            return super().__getitem__(chunk)

        def _piece(self, piece):
            asked[piece] += 1
            return super()._piece(piece)

    encoder = Counted(narrow=True)
    monkeypatch.setattr(tokens, "encoder", lambda *args, **kwargs: encoder)
    monkeypatch.setattr(rans, "TaskContext", mock.Mock())
    rans.TaskContext.get().partitionId.return_value = 0
    texts = [f"The same words Again, and {i}" for i in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(texts)], ["doc_id", "text"])
    *rows, _ = rans._tokenised(None, rans.BLOCK)(iter([batch]))
    assert sum(map(len, rows)) == 100
    assert sum(asked[x] for x in ("The", "the", "same", "words", "Again,", "again", ",", "and")) == 6


def test_one_merge_at_a_time_gives_the_same():
    v = bpe.Vocabulary(tokens.default_vocabulary())
    words = [w.encode() for w in ("aaaaaaaa", "banana", "lollollol", "x", "thethethe")]
    want = v.merge(words)
    v.at_once = False
    assert [a.tolist() for a in v.merge(words)] == [a.tolist() for a in want]


def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumn("ids", F.lit("clash"))


def test_encode_and_decode(spark, library):
    got = bpe.decode(bpe.encode(odd(spark))).collect()
    want = []
    for doc, text in ODD:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((str(doc), ids, library.decode(ids, skip_special_tokens=False)))
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in got) == sorted(want)
    assert bpe.decode(bpe.encode(odd(spark).filter("false"))).count() == 0


def test_bpe_query(spark, library):
    source = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = queries.op3_bpe(spark, FOLDER).collect()
    assert len(got) == len(source)
    for r in got:
        ids = library.encode(source[r.doc_id] or "", add_special_tokens=False).ids
        digests = [hashlib.sha256(s.encode()).hexdigest() for s in (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
        assert [r.n_tokens, r.ids_sha256, r.decoded_sha256] == [len(ids), *digests]


def check_pieces(rows, ids_of, window):
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for doc, ids in ids_of.items():
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            at += r.length
            assert r.ids == np.array(ids[r.start : at], "<u4").tobytes()
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == window or at < window and at & (at - 1) == 0


def test_packing(spark, library):
    source = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    ids = {k: library.encode(t or "", add_special_tokens=False).ids + [2] for k, t in source.items()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    check_pieces(packing.pack(docs).collect(), ids, 4096)
    few = packing.pack(docs, window=64, open_windows=3).collect()  # open windows are emptied often
    check_pieces(few, ids, 64)
    rows = packing.pack(odd(spark)).collect()
    assert sum(r.length for r in rows) == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in ODD)
    assert packing.pack(odd(spark).filter("false")).count() == 0


def test_placement_has_the_least_sum_of_squares():
    rng = random.Random(4)
    packer = packing.Packer(32, 1000)
    for k in range(300):
        size = rng.randint(1, 31)
        before = packer.levels.copy()
        options = [0, *(h for h in range(1, 33 - size) if before[h])]

        def total(h, before=before, size=size):
            after = before.copy()
            after[h] -= h > 0
            after[h + size] += h + size < 32
            return int((after[1:32] ** 2).sum())

        list(packer.add(k, np.zeros(size, np.uint32)))
        assert int((packer.levels[1:32] ** 2).sum()) == min(map(total, options))


def test_coder_round_trips():
    rng = np.random.default_rng(1)
    for _ in range(12):
        p = rng.dirichlet(np.full(int(rng.integers(1, 3000)), 0.05))
        blocks = [rng.choice(len(p), size=int(n), p=p).astype(np.uint32) for n in [1, 63, 64, 65, *rng.integers(1, 40000, 3)]]
        freq = rans.frequencies(np.bincount(np.concatenate(blocks)))
        assert freq.sum() == 1 << rans.BITS
        coder = rans.Coder(freq)
        coded = coder.encode(blocks)
        found = coder.decode([(len(b), *c) for b, c in zip(blocks, coded)])
        assert all(np.array_equal(a, b) for a, b in zip(blocks, found))


def test_token_files(spark, library):
    path = folder(spark, "odd")
    rans.write(odd(spark), path)
    docs = rans.with_starts(rans.read(spark, path), path).orderBy("start").collect()
    order = sorted(((-1 if i is None else i), t or "") for i, t in ODD)
    ids = [library.encode(t, add_special_tokens=False).ids + [2] for _, t in order]
    starts = np.cumsum([0, *map(len, ids)])
    assert [(r.start, r.n_tokens) for r in docs] == [(s, len(x)) for s, x in zip(starts, ids)]
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in docs] == ids
    empty = folder(spark, "empty")
    rans.write(odd(spark).filter("false"), empty)
    assert rans.with_starts(rans.read(spark, empty), empty).count() == 0


def test_damaged_files_are_noticed(spark):
    path, bad = folder(spark, "good"), folder(spark, "bad")
    rans.write(odd(spark), path)
    spark.read.parquet(f"{path}/table").write.parquet(f"{bad}/table")
    spark.read.parquet(f"{path}/blocks").withColumn("crc32", F.col("crc32") + 1).write.parquet(f"{bad}/blocks")
    with pytest.raises(Exception, match="checksum"):
        rans.read(spark, bad).collect()


def test_a_document_of_many_blocks(spark, library):
    """It is cut and put together again; a damaged block in its middle is noticed and spoils no other."""
    path, bad = folder(spark, "long"), folder(spark, "long-bad")
    rows = [(1, "short"), (5, " ".join(f"word{i} é" for i in range(400))), (5, "same id"), (5, "same id"), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    rans.write(df, path, block=64)
    docs = rans.with_starts(rans.read(spark, path), path).orderBy("start").collect()
    want = sorted((i, library.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in rows)
    assert sorted((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in docs) == want
    assert [r.doc_id for r in docs] == [1, 5, 5, 5, 9]
    assert [r.start for r in docs] == np.cumsum([0, *[r.n_tokens for r in docs]])[:-1].tolist()
    blocks = spark.read.parquet(f"{path}/blocks")
    split = sorted((r.part, r.seq, r.piece) for r in blocks.filter("split").collect())
    assert len(split) >= 10 and blocks.agg(F.max("n_tokens")).first()[0] <= 2 * 64
    at = (F.col("part") == split[5][0]) & (F.col("seq") == split[5][1]) & (F.col("piece") == split[5][2])
    spark.read.parquet(f"{path}/table").write.parquet(f"{bad}/table")
    blocks.withColumn("crc32", F.when(at, F.col("crc32") + 1).otherwise(F.col("crc32"))).write.parquet(f"{bad}/blocks")
    with pytest.raises(Exception, match=f"block {split[5][0]}/{split[5][1]}: the checksum"):
        rans.read(spark, bad).collect()
    freq = np.zeros(1 << 16, np.int64)
    for r in spark.read.parquet(f"{bad}/table").collect():
        freq[r.id] = r.freq
    rest = spark.read.parquet(f"{bad}/blocks").filter(~at).collect()
    assert len(rest) == blocks.count() - 1
    for b in rest:
        ids = rans.Coder(freq).decode([(b.n_tokens, b.words, b.checkpoints)])[0]
        assert zlib.crc32(ids.astype("<u4").tobytes()) == b.crc32


def test_token_file_query(spark, library):
    source = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op7_rans(spark, FOLDER).collect()}
    at = 0
    for doc in sorted(source):
        ids = library.encode(source[doc] or "", add_special_tokens=False).ids + [2]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (got[doc].start, got[doc].n_tokens, got[doc].ids_crc32) == (at, len(ids), crc)
        at += len(ids)


def test_chat_equals_sql(spark):
    assert parity.compare(spark, parity.connect(FOLDER), FOLDER, "op6_chat") is None


def test_chat_of_odd_rows(spark):
    rows = [
        (1, 0, "system", "rules"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "ann", "é"), (1, 3, None, "who"),
        (1, 1, "ann", "hi"), (2, 0, "system", "alone"), (None, None, "eve", "x"), (None, 5, "bob", ""),
    ] + [(3, i, "ab"[i % 2], "t" * (i % 7)) for i in range(500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("name", F.lit("clash"))
    got = chat.rotate(df).collect()
    views = collections.defaultdict(list)
    for r in got:
        views[r.conv_id, r.speaker].append(r)
    assert set(views) == {(1, "ann"), (1, "bob"), (None, "eve"), (None, "bob"), (3, "a"), (3, "b")}
    for (conv, speaker), turns in views.items():
        turns.sort(key=lambda r: r.position)
        assert [r.position for r in turns] == list(range(len(turns)))
        whole, learnt = "".join(r.segment for r in turns), []
        for r in turns:
            assert whole[r.start :].startswith(r.segment)
            if r.role == "assistant":
                learnt.append(whole[r.mask_start : r.mask_end])
            else:
                assert r.mask_start == r.mask_end
        said = sorted((x[1] if x[1] is not None else -1, x[3] or "") for x in rows if (x[0], x[2]) == (conv, speaker))
        assert learnt == [t + "<|im_end|>" for _, t in said]
    first = "".join(r.segment for r in views[1, "bob"])
    assert first == (
        "<|im_start|>system\nrules<|im_end|>\n" + 2 * "<|im_start|>user name=ann\nhi<|im_end|>\n"
        + "<|im_start|>user name=ann\né<|im_end|>\n"
        "<|im_start|>assistant\n<|im_end|>\n<|im_start|>user name=unknown\nwho<|im_end|>\n"
    )
    assert chat.rotate(df.filter("false")).count() == 0
    again = [(7, None, "ann", "yes"), (7, None, "ann", "yes"), (7, None, "bob", "yes")]
    assert chat.rotate(spark.createDataFrame(again, "conv_id long, turn long, role string, text string")).count() == 6


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    more = [(90001, None, "en", "s", 0), (90002, "123", "en", "s", 3), (None, "the and of the that", None, "s", 19)]
    docs = docs.union(spark.createDataFrame(more, docs.schema))
    kinds = docs.schema.simpleString()

    known = corpus_pipeline.language_id(spark, docs, FOLDER)
    assert known.schema.simpleString() == kinds
    rows = {r.doc_id: r for r in known.collect()}
    assert 90001 not in rows and 90002 not in rows and rows[None].lang
    clean = [r for r in docs.collect() if r.text and len(r.text) > 100]
    assert sum(r.doc_id in rows for r in clean) >= 0.99 * len(clean)

    kept = corpus_pipeline.near_dedup(spark, docs, FOLDER)
    assert kept.schema.simpleString() == kinds
    group = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    want = sorted([a for a, b in group if a == b and a is not None] + [-1])
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == want

    texts = ["one text of its own here", "quite another text under that id", "one text of its own here"]
    clash = spark.createDataFrame([(7, t, "en", "s", 1) for t in texts], docs.schema)
    assert sorted(r.text for r in corpus_pipeline.near_dedup(spark, clash, FOLDER).collect()) == sorted(texts[:2])

    cut = corpus_pipeline.suffix_dedup(spark, docs, FOLDER)
    assert cut.schema.simpleString() == kinds and cut.count() == docs.count()
    left = {r.row.doc_id: r.kept.decode("utf-8", "ignore") for r in suffixes.remove_repeats(docs).collect()}
    for r in cut.collect():
        assert r.text == left[r.doc_id] and r.n_chars == len(r.text)
    for stage in (corpus_pipeline.language_id, corpus_pipeline.near_dedup, corpus_pipeline.suffix_dedup, corpus_pipeline.pack):
        assert stage(spark, docs.filter("false"), FOLDER).count() == 0


def test_pipeline_runs(spark, library):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "suffix_dedup", "pack"]
    by_doc = collections.defaultdict(int)
    for r in rows:
        by_doc[r.doc_id] += r.length
    assert all(by_doc[r.doc_id] == r.doc_tokens for r in rows)
    assert language.UNKNOWN == "und"
