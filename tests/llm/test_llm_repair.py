import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from contrast.llm import repair as R


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(R.VOCABULARY))


def packed_block(ids, base=50_000):
    rules, lengths, symbols = R.compress(ids, base)
    return R.Block(
        base, rules.astype("<u2").tobytes(), lengths.astype("<u4").tobytes(), symbols.astype("<u2").tobytes()
    )


def test_words_equal_the_library(library):
    rng = random.Random(1)
    parts = ["a", "The", "ing", " ", "  ", "\n", "é", "É", "ß", "😀", "1", "'s", "!!", "***", "ña", "\t", ".", ",", "…",
             "́", "İ", "ﬁ", "Σ", "<|endoftext|>", "<|ENDOFTEXT|>", "\x1c", "\xa0", "µ", "ª", "don't", "¿"]
    words = R.word_ids()
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for text, packed in zip(texts, words.packed(texts), strict=True):
        ids = np.frombuffer(packed, "<u2").tolist()
        assert ids == [*library.encode(text, add_special_tokens=False).ids, R.END]
    assert words.packed([]) == []


@pytest.mark.parametrize("n", [0, 1, 2, 40, 5000, 60_000])
@pytest.mark.parametrize("kinds", [1, 2, 5, 900])
def test_grammar_round_trip_and_random_access(n, kinds):
    ids = np.random.default_rng(n + kinds).integers(0, kinds, n)
    block = packed_block(ids)
    assert (block.decode() == ids).all()
    for start, stop in ((0, 1), (n // 3, n // 2), (max(n - 1, 0), n + 5), (n, n + 1)):
        assert (block.decode(start, stop) == ids[start:stop]).all()


def test_repeats_compress():
    ids = np.tile(np.random.default_rng(1).integers(0, 40_000, 50), 400)
    rules, lengths, symbols = R.compress(ids, 50_000)
    assert len(symbols) < 2 * R.LEAST and lengths.max() > len(ids) / (2 * R.LEAST)
    block = packed_block(ids)
    assert (block.decode() == ids).all() and len(block.flat) < 50_000 + len(ids)


def test_rounds_end_when_no_pair_is_frequent():
    ids = np.random.default_rng(5).zipf(1.3, 30_000) % 3000
    rules, _, symbols = R.compress(ids, 3000)
    pairs = list(zip(symbols[:-1].tolist(), symbols[1:].tolist(), strict=True))
    counts, last = {}, {}
    for at, pair in enumerate(pairs):
        if last.get(pair, -2) < at - 1:
            counts[pair] = counts.get(pair, 0) + 1
            last[pair] = at
    assert len(rules) and max(counts.values()) < R.LEAST


def test_files_hold_every_document(spark, documents, odd, library, rows_of):
    rows = odd + [(1000 - i, f"Text number {i}, and more of it. " * (i % 9)) for i in range(80)]
    got = rows_of(R.repair_report(documents(rows)))

    def ids(text):
        return np.array([*library.encode(text or "", add_special_tokens=False).ids, R.END], "<u4")

    key = lambda r: (r[0] is not None, r[0] or 0, ids(r[1]).astype("<u2").tobytes())
    start, wanted = 0, []
    for doc, text in sorted(rows, key=key):
        own = ids(text)
        wanted.append((doc, start, len(own), zlib.crc32(own.tobytes())))
        start += len(own)
    found = sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got), key=lambda r: r[1])
    assert found == wanted


def test_small_blocks_and_ranges(documents, library):
    rows = [(i, f"word{i} and some more words here") for i in range(60)]
    written = R.settle(R.blocks(documents(rows), block=50), "blocks")
    assert written.count() > 8
    every = [i for _, text in rows for i in [*library.encode(text, add_special_tokens=False).ids, R.END]]
    for start, stop in ((0, 7), (33, 260), (len(every) - 3, len(every) + 9)):
        parts = sorted((r["at"], bytes(r["ids"])) for r in R.read_range(written, start, stop).collect())
        assert [i for _, raw in parts for i in np.frombuffer(raw, "<u4").tolist()] == every[start:stop]


def test_empty_table(documents):
    assert R.repair_report(documents([(1, "x")]).where(F.lit(False))).count() == 0


def test_rounds_look_only_where_pairs_may_be_frequent():
    """The few places kept hold every frequent pair and nearly none of the rare ones."""
    rng = np.random.default_rng(4)
    keys = rng.permutation(np.concatenate((np.arange(200_000), np.repeat(np.arange(9) * 77_777, 16)))).astype(np.uint32)
    places = R._often(keys, 16)
    values, counts = np.unique(keys, return_counts=True)
    assert set(np.flatnonzero(np.isin(keys, values[counts >= 16]))) <= set(places) and len(places) < 1000
    assert (R._frequent(keys[places], 16, 100) == R._frequent(keys, 16, 100)).all()
