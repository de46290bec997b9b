import hashlib

import pytest
from pyspark.sql import functions as F

from contrast.llm import fingerprint as P


def test_edited_texts_equal_brute_force(documents, odd, rows_of):
    rows = odd + [(20 + i, f"line {i}\nshared line\n" + "w " * i) for i in range(40)]
    got = rows_of(P.fingerprint_report(documents(rows)))
    ordered = sorted(
        ((key, text or "") for key, text in rows),
        key=lambda r: (-r[0] if r[0] is not None else 1 << 62, r[1].encode()),
    )
    texts = [text for _, text in ordered]
    edited = [
        t[: len(t) - len(t) // 3] + texts[(i + 1) % len(texts)][: len(t) // 3] for i, t in enumerate(texts)
    ]
    wanted = sorted(
        (str(key), len(t), hashlib.sha256(e.encode()).hexdigest())
        for (key, t), e in zip(ordered, edited, strict=True)
    )
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == wanted
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert (r["fingerprint"] != r["edited_fingerprint"]) or r["near_edited"] == 1


def test_order_of_paragraphs_insertion_and_deletion(spark, documents):
    table = documents([(1, "a b\nc d e\nf"), (2, "f\na b\nc d e"), (3, "a b\nf"), (4, "c d e"), (5, "a b\nc d e\nf f")])
    prints = {r["doc_id"]: r["fingerprint"] for r in P.fingerprints(table).collect()}
    assert prints[1] == prints[2] and prints[1] != prints[5]
    pair = spark.createDataFrame([(prints[3], prints[4], prints[1])], "a string, b string, c string")
    row = pair.select(P.combine(F.col("a"), F.col("b")).alias("sum"), P.combine(F.col("c"), F.col("b"), -1).alias("rest")).first()
    assert row["sum"] == prints[1] and row["rest"] == prints[3]


def test_likeness_tells_edits_from_others(spark, rows_of):
    import random

    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = [(i, "\n".join(" ".join(word() for _ in range(20)) for _ in range(10))) for i in range(60)]
    got = rows_of(P.fingerprint_report(spark.createDataFrame(rows, "doc_id long, text string")))
    assert sum(r["near_edited"] for r in got) / 60 == pytest.approx(2 / 3, abs=0.08)
    assert sum(r["near_next"] for r in got) / 60 < 0.12


def test_empty_table_and_single_row(documents, rows_of):
    table = documents([(1, "a b c")])
    row = rows_of(P.fingerprint_report(table))[0]
    assert row["near_next"] == 1.0
    assert P.fingerprint_report(table.where(F.lit(False))).count() == 0
