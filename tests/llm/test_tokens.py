import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import DOCS, awkward, clashing, documents, prose, rows_of
from tokenizers import Tokenizer

from queuesight.llm.token_counts import Counter, count_tokens, spliced_counts
from queuesight.llm.token_files import ChunkEncoder, read_token_files, write_token_files
from queuesight.llm.wavelet import BLOCK, WaveletShard, write_shard
from queuesight.session import fresh_path

WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "Don't  stop<|endoftext|>now <|endoftext|> ok <|startoftext|>", "é é ﬁ Ⅷ x² ½", "A B C\x1cD\x85E", "tab\tand\r\nlines\n\n\nend ", "   lead",
    "'s 'S 's's don'T", "日本語 テキスト。 한국어", "a​b İstanbul ΑΣ ΑΣ.b", "x" * 300, "\U0001f600\U0001f600 <|endof", "\n", " ", "a \n b", "!!! ??? ...,;", "́ start", "word,word , word", "éa, Ünï! ÀÉ?? naïve's œuvre, İx. ĭ ſ ªº µ.", "ok<|endoftext|>, a<|endoftext|>", "x's, don't. it'll!! we're?", "a_b_ _c_ 3rd, 4. é1, 日本,", "ß. ŉ, Ĳ! ﬁ.", "é, ȩ́. é́,", "…, a…, —. a—, 5%.",
]


@pytest.mark.parametrize("size", [0, 1, 2, 777, BLOCK, BLOCK + 5, 2 * BLOCK + 3])
@pytest.mark.parametrize("bits", [1, 5, 16, 17])
def test_wavelet_matrix_round_trip_and_queries(size, bits):
    rng = np.random.default_rng(size + bits)
    ids = (rng.zipf(1.3, size) % (1 << bits)).astype(np.uint32 if bits > 16 else np.uint16)
    cut = [0, size // 3, size // 3, size]
    shard = WaveletShard(write_shard(ids, [None, 5, 9], [b - a for a, b in zip(cut, cut[1:], strict=False)], bits))
    assert (shard.tokens() == ids).all() and shard.doc_ids == [None, 5, 9]
    assert [(d, s, x.tolist()) for d, s, x in shard.documents()] == [(d, a, ids[a:b].tolist()) for d, a, b in zip([None, 5, 9], cut, cut[1:], strict=False)]
    for i in rng.integers(0, size, 12) if size else []:
        assert shard.access(int(i)) == ids[i]
        token, low, high = int(ids[i]), *sorted(rng.integers(0, size + 1, 2).tolist())
        assert shard.count(token, low, high) == np.count_nonzero(ids[low:high] == token)
        places = np.flatnonzero(ids == token)
        k = int(rng.integers(0, len(places)))
        assert shard.select(token, k) == places[k]
        if len(places) < 50:
            assert shard.occurrences(token) == places.tolist()
    assert shard.count((1 << bits) + 1) == 0
    with pytest.raises(IndexError):
        shard.access(size)


def test_chunk_encoder_is_the_library():
    plain = Tokenizer.from_file(WORD_BPE)
    rng = random.Random(1)
    texts = [t or "" for _, t in awkward()] + ODD + [prose(rng, 50).title() for _ in range(20)]
    for room in (5, 100_000):
        encoder = ChunkEncoder(WORD_BPE, 2, room)
        assert not encoder.whole and encoder.letters
        for text, data in zip(texts, encoder.encode(texts), strict=True):
            assert np.frombuffer(data, encoder.kind).tolist() == [*plain.encode(text, add_special_tokens=False).ids, 2]
    other = ChunkEncoder(BYTE_BPE, 2)
    plain = Tokenizer.from_file(BYTE_BPE)
    assert other.whole
    for text, data in zip(texts, other.encode(texts), strict=True):
        assert np.frombuffer(data, other.kind).tolist() == [*plain.encode(text, add_special_tokens=False).ids, 2]


def plain_digest(rows):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    encoded = sorted(((i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0))
    return encoded


def test_files_hold_every_document_in_order(spark):
    rows = awkward() + [(50 + i, t) for i, t in enumerate(ODD)]
    random.Random(2).shuffle(rows)
    path = fresh_path(spark, "test-tokens")
    manifest = write_token_files(clashing(documents(spark, rows)), path, WORD_BPE, 2, shard_tokens=500)
    assert manifest.count() > 3
    got = sorted(map(tuple, read_token_files(spark, path, manifest).collect()), key=lambda r: r[1])
    want = plain_digest(rows)
    assert [r[0] for r in got] == [i for i, _ in want]
    start = 0
    for r in got:
        assert r[1] == start
        start += r[2]
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted(((r[0], r[2], r[3]) for r in got), key=repr) == sorted(((i, len(x), crc(x)) for i, x in want), key=repr)


def test_no_documents(spark):
    path = fresh_path(spark, "test-tokens")
    empty = spark.createDataFrame([], DOCS)
    assert rows_of(read_token_files(spark, path, write_token_files(empty, path, WORD_BPE, 2))) == []
    assert rows_of(count_tokens(empty, BYTE_BPE)) == []


def test_counts_are_the_library_s(spark):
    plain = Tokenizer.from_file(BYTE_BPE)
    rng = random.Random(5)
    rows = awkward() + [(50 + i, t) for i, t in enumerate(ODD)]
    rows += [(100, "y" * 5_000), (101, " ".join(ODD) * 20), (102, prose(rng, 3_000) + "z" * 900 + prose(rng, 3_000)), (103, " \n" * 2_000), (104, "<|endoftext|> a" * 600)]
    want = sorted(((i, len((t or "").encode()), n, n > 1024) for i, t in rows for n in [len(plain.encode(t or "", add_special_tokens=False).ids)]), key=repr)
    df = clashing(documents(spark, rows))
    assert rows_of(count_tokens(df, BYTE_BPE)) == want
    assert rows_of(count_tokens(df, BYTE_BPE, huge=300, chunk=200, overlap=64)) == want


def test_splice_at_every_offset(spark):
    plain = Tokenizer.from_file(BYTE_BPE)
    rng = random.Random(6)
    texts = [(str(i), "".join(rng.choice(["the ", " ", "don't ", "ab", "\n", "é ", "<|endoftext|>", "12 ", "!? "]) for _ in range(400))) for i in range(40)]
    got = dict(map(tuple, spliced_counts(spark.createDataFrame(texts, "key string, text string"), BYTE_BPE, size=150, overlap=48).collect()))
    assert got == {k: len(plain.encode(t, add_special_tokens=False).ids) for k, t in texts}


def test_counting_by_pieces_in_any_room():
    plain = Tokenizer.from_file(BYTE_BPE)
    texts = ODD + [prose(random.Random(i), 40) for i in range(10)]
    for room in (3, 10_000):
        counter = Counter(BYTE_BPE, room)
        assert counter.by_piece and counter.counts(texts) == [len(plain.encode(t, add_special_tokens=False).ids) for t in texts]


def test_other_tokenizers_take_whole_texts(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    plain = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(1, "Some text. " * 50), (2, None), (3, "é" * 40)]
    got = {r.doc_id: r.n_tokens for r in count_tokens(documents(spark, rows), path, huge=10).collect()}
    assert got == {i: len(plain.encode(t or "")) for i, t in rows}
