import math
import random
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from contrast.llm import quality as Q


def corpus(n=240):
    rng = random.Random(3)
    words = ["".join(rng.choice("aeioustrn") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    rows, good = [], {}
    for i in range(n):
        bad = i % 6 == 0
        text = " ".join(rng.choice(words) + ("$$$" if bad else "") for _ in range(rng.randint(12, 90)))
        rows.append((i, text))
        good[i] = int(not bad)
    return rows, good


@pytest.fixture
def labels(spark):
    def build(good):
        return spark.createDataFrame(
            [*good.items(), (None, 1), (900_000, 0), (3, None)], "doc_id long, quality int"
        ).withColumn("toxic", F.lit(0))

    return build


def test_junk_goes_and_good_rows_stay(documents, odd, labels):
    rows, good = corpus()
    sample = {k: v for k, v in good.items() if k % 2 == 0 or k % 3 == 0}
    table = documents(rows + [(key, text) for key, text in odd])
    kept = Q.keep_good(table, labels(sample))
    assert kept.columns == table.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert {i for i in ids if i is not None and i > 9} == {i for i, g in good.items() if g and i > 9}


def test_models_equal_brute_force(documents, labels):
    rows, good = corpus(60)
    table = documents(rows)
    marked = Q._marked(table, Q.labelled_sample(labels(good)))
    counts = {r["bucket"]: (r["raw"], r["target"]) for r in Q.count_ngrams(marked).collect()}
    raw, target = np.zeros(Q.BUCKETS, int), np.zeros(Q.BUCKETS, int)
    for key, text in rows:
        grams = np.bincount(Q.ngrams(text), minlength=Q.BUCKETS)
        raw += grams
        target += grams * good[key]
    assert counts == {b: (raw[b], target[b]) for b in np.flatnonzero(raw)}
    ratios = Q.log_ratios(Q.count_ngrams(marked))
    wanted = {key: (ratios[g].sum(), len(g)) for key, g in ((key, Q.ngrams(text)) for key, text in rows)}
    for r in Q.importances(marked, ratios).collect():
        total, size = wanted[r["doc_id"]]
        assert r["importance"] == pytest.approx(total)
        assert r["log_weight"] == pytest.approx(total / math.sqrt(size))


def gumbel(key, text):
    """Noise of a row: the hash of its id, of its text's hash and of the seed, one after the other."""
    text_hash = xxhash.xxh64_digest(text.encode(), 42)[::-1]
    h = 42
    for part in (struct.pack("<q", key), text_hash, struct.pack("<i", Q.SEED)):
        h = xxhash.xxh64_intdigest(part, h)
    return -math.log(-math.log(((h >> 11) + 0.5) / 2**53))


def test_top_k_equals_brute_force(documents, labels):
    """Kept are the k rows of largest weight plus noise, with a given k and with the default."""
    rows, good = corpus(120)
    for k in (None, 0, 37, 500):
        got = Q.resample(documents(rows), labels(good), k=k).collect()
        texts = dict(rows)
        keys = {r["doc_id"]: r["log_weight"] + gumbel(r["doc_id"], texts[r["doc_id"]]) for r in got}
        assert all(r["key"] == pytest.approx(keys[r["doc_id"]]) for r in got)
        size = sum(good.values()) if k is None else k
        wanted = set(sorted(keys, key=keys.get, reverse=True)[:size])
        assert {r["doc_id"] for r in got if r["kept"]} == wanted


def test_draw_is_no_threshold(documents, labels):
    """Rows of equal weight are drawn at random, and the more so the higher the temperature."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(8))) for i in range(200)]
    differ = []
    for temperature in (1.0, 1e9):
        got = Q.resample(documents(rows), labels({i: 1 for i in range(20)}), temperature, k=100).collect()
        best = sorted(got, key=lambda r: -r["log_weight"])[:100]
        differ.append(len({r["doc_id"] for r in got if r["kept"]} - {r["doc_id"] for r in best}))
    assert 5 < differ[0] and 30 < differ[1] < 70


def test_texts_in_blocks_and_without_words(monkeypatch):
    assert len(Q.ngrams("")) == 0 and len(Q.ngrams(" \n")) == 0 and len(Q.ngrams("one")) == 1
    text = "alpha beta\tbeta gamma, delta " * 30 + "x" * 500
    whole = sorted(Q.ngrams(text))
    monkeypatch.setattr(Q, "LONG_TEXT", 100)
    for size in (1, 2, 3, 7, 1000):
        monkeypatch.setattr(Q, "TOKENS", size)
        assert sorted(Q.ngrams(text)) == whole


def test_curve_and_one_class():
    x = np.array([-3.0, -2.0, -1.0, 1.0, 2.0, 3.0])
    slope, offset = Q.logistic_curve(x, np.array([0, 0, 0, 1, 1, 1.0]))
    assert slope > 0 and abs(offset) < 1e-6 and math.isfinite(slope)
    assert Q.logistic_curve(x, np.ones(6))[1] > 0 and Q.logistic_curve(x[:0], x[:0])[1] > 0


def test_without_labels_all_stay(documents, labels, odd):
    table = documents(odd)
    none = labels({}).where(F.lit(False))
    assert Q.keep_good(table, none).count() == len(odd)
    assert Q.quality_report(table.where(F.lit(False)), none).count() == 0
