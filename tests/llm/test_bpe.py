"""Against the tokenizer library, and exact round trips."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from postlab.llm import bpe, pretoken

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
CONTENT = open(PATH, "rb").read()
ALPHABET = ["a", "b", "'", "s", "t", "re", "ve", "ll", "m", "d", " ", "  ", "\n", "\t", "1", "²", "é",
            "Ñ", "!", "…", "😀", "\x1c", "\u00a0", "\u3000", "中", "\u0301", "'re", " '", "\U000105c0"]


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(CONTENT, pretoken.class_table())


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN,
                             mergeable_ranks=bpe.read_ranks(CONTENT), special_tokens={})


def test_ids_equal_the_library(encoder, library):
    rng = random.Random(1)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 40))) for _ in range(3000)]
    texts += ["", "a" * 3000, " " * 500, "'" * 99, "ab" * 400, "<|endoftext|>"]
    ids, offsets = encoder.encode(texts)
    decoder = bpe.Decoder(CONTENT)
    for text, one, at in zip(texts, ids, offsets):
        expected = library.encode_ordinary(text)
        assert np.frombuffer(one, "<u4").tolist() == expected
        sizes = [len(library.decode_single_token_bytes(t)) for t in expected]
        assert np.frombuffer(at, "<u4").tolist() == [sum(sizes[:i]) for i in range(len(sizes))]
        assert decoder.decode(one, at) == text.encode()


def test_both_merges_agree(encoder):
    rng = random.Random(2)
    pieces = [bytes(rng.choices(b"abcdehinorst ", k=rng.randint(1, 60))) for _ in range(500)]
    packed = bpe.merge_many(pieces, encoder.merged.pairs)
    for piece, ids in zip(pieces, packed):
        if piece not in encoder.ranks:
            assert np.frombuffer(ids, "<u4").tolist() == bpe.merge(piece, encoder.ranks)


def test_a_full_cache_forgets_and_goes_on(encoder, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_PIECES", 2)
    for text in ("one two three four", "five six one two"):
        ids, _ = encoder.encode([text])
        assert np.frombuffer(ids[0], "<u4").tolist() == library.encode_ordinary(text)


def test_frame(spark):
    words = bpe.Vocabulary(spark, PATH)
    rows = [(1, "it's", "x"), (1, "it's", "x"), (2, None, None), (3, "", "y"), (4, "a " * 400_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(df, words), words)
    assert out.columns == ["doc_id", "ids", "offsets", "n_tokens", "decoded"]
    got = sorted((r.doc_id, r.n_tokens, bytes(r.decoded)) for r in out.collect())
    assert got[:4] == [(1, 2, b"it's"), (1, 2, b"it's"), (2, 0, b""), (3, 0, b"")]
    assert got[4][2] == b"a " * 400_000
    assert bpe.encode(df.limit(0), words).count() == 0
