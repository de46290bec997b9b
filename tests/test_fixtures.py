from collections import Counter

import pytest

from contrast import fixtures as X


@pytest.fixture
def folder(spark, tmp_path):
    docs = [
        (1, "B b a, é́A", "en"),
        (2, None, "en"),
        (3, "", "en"),
        (4, "1 2", None),
        (5, "x y x", "en"),
        (5, "x z", "en"),
        (5, "x", "de"),
        (None, "n n", "en"),
        (None, "n", "en"),
    ] + [(100 + i, f"w{'a' * (i % 7)} same same", "fr") for i in range(2500)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(1, 1), (5, 0), (5, 1), (101, None), (None, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), docs, labels


def test_terms_of_repeated_and_missing_ids(spark, folder):
    sf_dir, docs, labels = folder
    cells = Counter()
    for doc, text, lang in docs:
        for word in "".join(c if c.isalpha() or c == "́" else " " for c in (text or "").lower()).split():
            cells[doc, lang, word] += 1
    want = Counter()
    for (doc, lang, word), n in cells.items():
        found = [q for d, q in labels if d == doc and d is not None] or [None]
        for quality in found:
            group = {1: "case", 0: "control"}.get(quality, "baseline")
            want[lang, group, word, None if doc is None else str(doc), n] += 1
    got = X.terms(spark, sf_dir, by_language=True).select(*X.LONG[:4], "count").collect()
    assert Counter(tuple(row) for row in got) == want


def test_cells_of_documents_with_an_id_of_their_own_are_not_shuffled(spark, folder, monkeypatch, capsys):
    plans = []

    def noted(df, label):
        if label == "terms":
            df.explain()
            plans.append(capsys.readouterr().out)
        return settled(df, label)

    settled = X.settle
    monkeypatch.setattr(X, "settle", noted)
    sf_dir, _, _ = folder
    spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id >= 100").write.parquet(f"{sf_dir}/own/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{sf_dir}/own/labels.parquet")
    X.terms(spark, f"{sf_dir}/own")
    assert len(plans) == 1 and "hashpartitioning" not in plans[0]


def test_packed_terms_are_the_same_cells_and_no_row_is_empty(spark, folder):
    sf_dir, docs, _ = folder
    packed = X.terms(spark, sf_dir, by_language=True, packed=True).cache()
    assert packed.columns == ["cohort", "group", "sample_id", "cells"]
    assert packed.where("cells is null or size(cells) = 0").isEmpty()
    assert packed.where("sample_id = '101'").count() == 1 and packed.count() < len(docs) + 10
    flat = X.terms(spark, sf_dir, by_language=True)
    key = lambda df: Counter(tuple(row) for row in df.select(*X.LONG).collect())
    assert key(X.unpacked(packed)) == key(flat)


def test_words_are_cut_as_the_break_has_it(spark):
    texts = ["", " ", "a", "A1b", "ÀÉ-ß·ñ", "x y z", "\U0001d400b 日本。語", "İstanbul ΣΑΣ", "x" * 70_000, "é́ ́"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    word = X.F.explode(X.F.split(X.F.lower("text"), X.WORD_BREAK)).alias("feature_id")
    want = rows.select("doc_id", word).where("feature_id <> ''").groupBy("doc_id", "feature_id").count()
    got = X.unpacked(X.counted_words(rows))
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(got) == key(want) and got.count() > 12
