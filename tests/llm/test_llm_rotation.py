import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from contrast.llm import rotation as R


def plain(rows, threshold=R.THRESHOLD):
    """Brute force over all pairs in double precision."""
    def sound(x, label):
        return label is not None and x is not None and all(v is not None and math.isfinite(v) for v in x) and any(x)

    unit = [np.array(x, float) / np.linalg.norm(np.array(x, float)) if sound(x, lab) else None for _, x, lab in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if unit[i] is None or unit[j] is None or rows[i][2] != rows[j][2] or len(unit[i]) != len(unit[j]):
                continue
            if unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (key, _, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), key), key)
    return sorted((rows[i][0], links[i], least[find(i)], rows[i][0] == least[find(i)]) for i in range(len(rows)))


def reported(df):
    return sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in df.collect())


SCHEMA = "vec_id long, embedding array<float>, label int"
ODD = [
    (1, [1.0, 0.0, 0.0], 1), (2, [1.0, 0.0, 0.0], 1), (3, [2.0, 0.01, 0.0], 1), (4, None, 1),
    (5, [0.0, 0.0, 0.0], 1), (6, [float("nan"), 1.0, 0.0], 1), (7, [1.0, 0.0, 0.0], None),
    (8, [1.0, 0.0], 1), (9, [1.0, 0.0], 1), (10, [2.0**100, 2.0**100, 0.0], 2), (11, [1.0, 1.0, 0.0], 2),
    (12, [-1.0, -1.0, 0.0], 2), (13, [1.0, None, 0.0], 2), (14, [float("inf"), 1.0, 1.0], 2), (15, [], 2),
    (16, [-0.0, 1.0, 0.0], 3), (17, [0.0, 1.0, 0.0], 3),
]


def test_odd_vectors(spark):
    table = spark.createDataFrame(ODD, SCHEMA)
    for name in ("x", "h1", "id", "code", "bands", "own", "n"):
        table = table.withColumn(name, F.lit("clash"))
    assert reported(R.vector_groups(table)) == plain(ODD)
    assert R.vector_groups(table.where(F.lit(False))).count() == 0


@pytest.mark.parametrize("block", [512, 16])
def test_clusters_equal_brute_force(spark, block):
    """Dense clusters with copies, also when every bucket is cut into blocks."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 32))
    rows = []
    for i in range(260):
        x = centres[i % 12 if i % 3 else 0] + rng.normal(size=32) * rng.choice([0.0, 0.05, 0.12, 0.2])
        rows.append((i, x.astype(np.float32).tolist(), i % 2))
    got = reported(R.vector_groups(spark.createDataFrame(rows, SCHEMA), block=block))
    assert got == plain(rows)


def test_estimates_are_unbiased_and_within_bounds():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 64))
    y = x + rng.normal(size=x.shape) * 0.12
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    bits, factors = R.encode(x)
    estimate = np.array([R.estimates(bits[i : i + 1], factors[i : i + 1], y[i : i + 1])[0, 0] for i in range(400)])
    true = (x * y).sum(axis=1)
    assert abs((estimate - true).mean()) < 0.002
    near = true >= R.THRESHOLD
    assert near.any()
    assert (estimate + R.bound(factors, bits.shape[1], R.THRESHOLD) >= R.THRESHOLD)[near].all()


def test_rotations_keep_lengths():
    for d in (1, 3, 64, 700):
        r = R.rotations(d)
        assert len(r) >= R.CODE_BITS and np.allclose(r.T @ r, np.eye(d))
