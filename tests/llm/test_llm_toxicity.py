import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from contrast.llm import toxicity as T


def corpus(n=700):
    rng = random.Random(8)
    words = ["".join(rng.choice("aeiourstn") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    bad = ["blorgwit", "zunkface", "quibscum"]
    rows, toxic = [], {}
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 60))]
        toxic[i] = int(i % 5 == 0)
        for _ in range(3 * toxic[i]):
            text[rng.randrange(len(text))] = rng.choice(bad)
        rows.append((i, " ".join(text)))
    return rows, toxic


def labelled(spark, toxic):
    return spark.createDataFrame([*toxic.items(), (None, 1), (7, None)], "doc_id long, toxic int")


def test_held_out_rows_and_misspellings(spark, documents, odd):
    rows, toxic = corpus()
    more = [(10_000, "aeio rstn blorgwitt and zunkfaces here"), (10_001, "aeio rstn and plain words here")]
    table = documents(rows + more + odd)
    got = T.toxicity_report(table, labelled(spark, toxic)).collect()
    assert len(got) == len(rows) + len(more) + len(odd)
    for r in got:
        text = "" if r["doc_id"] is None else str(r["doc_id"])
        assert r["held_out"] == (zlib.crc32(text.encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [r for r in got if r["held_out"] and r["doc_id"] in toxic and r["doc_id"] > 9]
    right = sum(r["predicted"] == toxic[r["doc_id"]] for r in held)
    assert right / len(held) > 0.97
    score = {r["doc_id"]: r["score"] for r in got if r["doc_id"] and r["doc_id"] >= 10_000}
    assert score[10_000] > score[10_001]


def test_labels_of_held_out_rows_change_nothing(spark, documents):
    rows, toxic = corpus(200)
    table = documents(rows)
    other = {k: 1 - v if zlib.crc32(str(k).encode()) % 4 == 2 else v for k, v in toxic.items()}
    one, two = (
        sorted((r["doc_id"], r["score"]) for r in T.toxicity_report(table, labelled(spark, t)).collect())
        for t in (toxic, other)
    )
    assert one == two


def test_rows_and_blocks(monkeypatch):
    memo = T._Memo(lambda word: np.array(T.subwords(word)))
    bucket, weight = T.sparse_row("one two two", memo)
    assert abs(weight.sum() - 2 / (2 + T.PADDING)) < 1e-6 and len(set(bucket)) == len(bucket)
    assert len(T.sparse_row("", memo)[0]) == 0
    whole = T.distinct_words("alpha beta gamma " * 20)
    monkeypatch.setattr(T, "LONG_TEXT", 30)
    assert T.distinct_words("alpha beta gamma " * 20) == whole


def test_one_class_no_labels_and_empty_table(spark, documents, odd):
    table = documents(odd)
    none = labelled(spark, {}).where(F.lit(False))
    assert {r["predicted"] for r in T.toxicity_report(table, none).collect()} == {0}
    assert T.toxicity_report(table.where(F.lit(False)), none).count() == 0


def test_long_texts_are_cut_at_white_space(monkeypatch):
    text = "alpha beta\tgamma\nÉTÉ " * 40 + "x" * 300 + " end"
    whole = [word for block in T.words_of(text) for word in block]
    for size in (1, 7, 50, 200):
        monkeypatch.setattr(T, "LONG_TEXT", size)
        assert [word for block in T.words_of(text) for word in block] == whole
