import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import compare
from contrast.llm import negatives as N
from contrast.llm.oracles import ORACLES

SCHEMA = "vec_id long, embedding array<float>, label int"
ODD = [
    (0, [1.0, 0.5, -0.25], 1), (0, [1.0, 0.25, 0.0], 1), (1, [1.0, 0.5, -0.25], 1), (2, [1.0, 0.5, -0.25], 2),
    (3, [1.0, 0.5, -0.25], 2), (3, [0.9, 0.5, 0.0], 2), (100, [1.0, 0.0], 1), (4, [0.5, 0.5], 1), (5, [0.5, 0.25], 3),
    (200, [], 1), (6, [], 1), (8, [], 2), (300, None, 1), (400, [1.0, None, 0.0], 1), (500, [float("nan"), 0.0, 0.0], 1),
    (600, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 2), (700, [0.9, 0.4, 0.1], 2), (9, [float("inf"), 1.0, 0.0], 2),
    (10, [40000.0, 0.0, 0.0], 2), (11, [32767.0, -32767.0, 1.0], 1), (900, [-1.0, -1.0, -1.0], 4), (12, [1.0, 1.0, 1.0], 4),
]


def plain(rows):
    """Brute force with Python integers."""
    sound = []
    for i, (key, x, label) in enumerate(rows):
        if key is None or label is None or x is None or any(v is None or not abs(v) < N.LARGEST for v in x):
            continue
        q = [math.floor(256 * float(np.float32(v))) for v in x]
        sound.append((i, key, q, (label + 1) % 10 if key % 7 == 0 else label))
    out = []
    for i, key, q, label in sound:
        if key % 100:
            continue
        met = sorted(
            (-sum(a * b for a, b in zip(q, p)), other, j, name)
            for j, other, p, name in sound
            if j != i and len(p) == len(q)
        )
        for top, positive, *_ in [m for m in met if m[3] == label][:5]:
            fits = [m for m in met if m[3] != label and 80 * -top <= 100 * -m[0] <= 100 * -top]
            out += [(key, positive, rank, m[1], -top, -m[0]) for rank, m in enumerate(fits[:5], 1)]
    return sorted(out)


def reported(df):
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(row) for row in df.select(*names).collect())


@pytest.mark.parametrize("d, bits", [(64, 9), (5, 3), (13, 15), (8, 22), (1, 1), (0, 1)])
def test_scores_are_inner_products(d, bits):
    rng = np.random.default_rng(d)
    a, c = (rng.integers(-(1 << bits), 1 << bits, (n, d)) for n in (7, 11))
    a[0, :], c[0, :] = -(1 << bits), -(1 << bits)
    planes = N.bit_planes(c, bits + 1) if d else np.zeros((11, bits + 1, 0), np.uint8)
    assert (N.scores(N.subset_sums(a), planes) == c @ a.T).all()


def test_best_prefers_first_of_ties():
    values = np.array([3, 5, 5, 1, 5, 4, 5])
    assert N._best(values, np.array([0, 1, 2, 4, 5, 6]), 3).tolist() == [1, 2, 4]
    assert N._best(values, np.array([3, 0]), 3).tolist() == [0, 3]


@pytest.mark.parametrize("blocks", [(256, 2048), (2, 3)])
def test_odd_rows_against_brute_force_and_sql(spark, blocks):
    table = spark.createDataFrame(ODD, SCHEMA)
    for name in ("row", "id", "q", "d", "n", "score", "anchor"):
        table = table.withColumn(name, F.lit("clash"))
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    ours = N.hard_negatives(table.withColumn("label", shifted), anchors_of=blocks[0], rows_of=blocks[1])
    assert reported(ours) == plain(ODD)
    connection = duckdb.connect()
    connection.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    connection.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", ODD)
    assert compare.spark_rows(ours) == compare.duck_rows(connection, ORACLES["op11_hard_negatives"])


def test_hot_label_in_many_blocks(spark):
    rng = random.Random(4)
    rows = [
        (i, [round(rng.gauss(0, 0.2) + (0.3 if j == i % 3 else 0), 3) for j in range(9)], 1 if i % 3 else i % 10)
        for i in range(0, 2000, 5)
    ]
    table = spark.createDataFrame(rows, SCHEMA)
    want = plain(rows)
    assert len(want) > 200
    assert reported(N.negatives_report(table)) == want
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    assert reported(N.hard_negatives(table.withColumn("label", shifted), anchors_of=3, rows_of=50)) == want


def test_empty_table(spark):
    assert N.negatives_report(spark.createDataFrame([], SCHEMA)).count() == 0
