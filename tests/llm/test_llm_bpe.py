import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from contrast.llm import bpe as B


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path(B.VOCABULARY), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def unpacked(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_random_texts_equal_the_library(library):
    rng = random.Random(0)
    parts = ["a", "b", "the", "ing", " ", "  ", "\n", "é", "ß", "😀", "1", "23", "'s", "!!", "x" * 5, "\x00", "<|endoftext|>"]
    coder = B.load()
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 50)))
        assert unpacked(coder.packed(text)) == library.encode_ordinary(text)
        assert coder.decode(coder.packed(text)) == text.encode()


def test_long_pieces_and_long_texts(library, monkeypatch):
    rng = random.Random(1)
    coder = B.load()
    for text in ("a" * 20000, "".join(rng.choice("abcdefgh") for _ in range(20000)), "!" * 999):
        assert unpacked(coder.packed(text)) == library.encode_ordinary(text)
    monkeypatch.setattr(B, "LONG_TEXT", 10)
    monkeypatch.setattr(B, "BLOCK_PIECES", 3)
    text = "Some words, some more words.  And a tail  "
    assert unpacked(coder.packed(text)) == library.encode_ordinary(text)


def test_memo_starts_again_when_full(library):
    coder = B.ByteBpe(B.load().ranks, public_tokenizers.PATTERN, memo=3)
    text = "one two three four five one two three"
    assert unpacked(coder.packed(text)) == library.encode_ordinary(text) and len(coder.memo) <= 3


def test_tokens_that_merges_never_make():
    """Such a token is used for a whole piece only, as the library does."""
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"xyz": 259}
    library = tiktoken.Encoding("t", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    coder = B.ByteBpe(ranks, r"\S+|\s+")
    for text in ("xyz", "axyz", "abc", "bcabc", "abcxyz xyz", "aabbcc"):
        assert unpacked(coder.packed(text)) == library.encode_ordinary(text)


def test_report(documents, odd, rows_of, library):
    got = sorted(rows_of(B.bpe_report(documents(odd))), key=str)
    wanted = []
    for key, text in odd:
        ids = library.encode_ordinary(text or "")
        wanted.append(
            {
                "doc_id": key,
                "n_tokens": len(ids),
                "ids_sha256": hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                "decoded_sha256": hashlib.sha256((text or "").encode()).hexdigest(),
            }
        )
    assert got == sorted(wanted, key=str)
    assert B.bpe_report(documents(odd).where(F.lit(False))).count() == 0
