import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from contrast.functions.columns import fill_slots
from contrast.operators import matrix, normalize
from contrast.plans import flows


@pytest.fixture
def cells(spark):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(30, 6)) * [1, 2, 3, 4, 5, 6] + 10
    rows = [
        (f"s{i:02d}", f"f{j}", j, float(data[i, j])) for i in range(30) for j in range(6)
    ]
    df = spark.createDataFrame(rows, "sample_id string, feature_id string, pos int, logcpm double")
    return data, df.repartition(5)


def test_fill_slots(spark):
    rows = [(1, [(1, 2.0), (4, 5.0)]), (2, [(0, 1.0), (5, 2.0)]), (3, None), (4, [])]
    df = spark.createDataFrame(rows, "k int, cells array<struct<slot:int,value:double>>")
    got = {r.k: r.v for r in df.select("k", fill_slots(F.col("cells"), 6, 0.0).alias("v")).collect()}
    assert got == {
        1: [0, 2, 0, 0, 5, 0],
        2: [1, 0, 0, 0, 0, 2],
        3: [0] * 6,
        4: [0] * 6,
    }


@pytest.mark.parametrize("block", [2, 1024])
def test_densify(long_of, block):
    groups = {"s1": "case", "s2": "control", "s3": "case"}
    counts = {"f": {"s1": 4}, "g": {"s2": 1, "s3": 2}}
    got = {
        (r.feature_id, r.sample_id): (r["count"], r.group)
        for r in matrix.densify(long_of(counts, groups), block).collect()
    }
    assert got == {
        (f, s): (counts[f].get(s, 0), groups[s]) for f in counts for s in groups
    }


def test_densify_keeps_cohorts_apart(long_of):
    left = long_of({"f": {"s1": 4}}, {"s1": "case"}, "a")
    right = long_of({"g": {"s2": 1}}, {"s2": "case"}, "b")
    got = matrix.densify(left.unionByName(right)).collect()
    assert {(r.cohort, r.feature_id, r.sample_id) for r in got} == {("a", "f", "s1"), ("b", "g", "s2")}


def test_top_variable_positions(cells):
    data, df = cells
    best = matrix.top_variable(df, 3).orderBy("pos").collect()
    want = np.argsort(-data.var(axis=0, ddof=1))[:3]
    assert [r.feature_id for r in best] == [f"f{j}" for j in want]
    assert [r.pos for r in best] == [0, 1, 2]
    assert best[0].variance == pytest.approx(data.var(axis=0, ddof=1).max())


def test_top_variable_with_missing_cells_as_zero(cells):
    data, df = cells
    holes = df.where("not (feature_id = 'f0' and sample_id < 's15')")
    full = data.copy()
    full[:15, 0] = 0
    best = {r.feature_id: r.variance for r in matrix.top_variable(holes, 6, n_samples=30).collect()}
    assert best == pytest.approx({f"f{j}": full[:, j].var(ddof=1) for j in range(6)})


def test_wide_vectors_fill_gaps(cells):
    data, df = cells
    features = matrix.top_variable(df, 6)
    order = {r.feature_id: r.pos for r in features.collect()}
    holes = df.where("not (feature_id = 'f2' and sample_id = 's03')")
    vectors = matrix.wide_vectors(holes, features, 6).orderBy("sample_id")
    rows = [r.v for r in vectors.select(vector_to_array("features").alias("v")).collect()]
    want = np.zeros_like(data)
    for j in range(6):
        want[:, order[f"f{j}"]] = data[:, j]
    want[3, order["f2"]] = 0
    assert np.allclose(rows, want)


def test_svd_equals_numpy(cells):
    data, df = cells
    features = df.select("feature_id", "pos").distinct()
    vectors = matrix.wide_vectors(df, features, 6)
    reduced, sigma = matrix.svd_features(vectors, 6)
    u = np.array([r.svd for r in reduced.orderBy("sample_id").collect()])
    scaled = (data - data.mean(axis=0)) / data.std(axis=0, ddof=1)
    want_u, want_sigma, _ = np.linalg.svd(scaled, full_matrices=False)
    assert np.allclose(sigma, want_sigma)
    assert np.allclose(np.abs(u), np.abs(want_u), atol=1e-7)
    assert np.allclose(u.T @ u, np.eye(6), atol=1e-8)
    assert sum(s * s for s in sigma) == pytest.approx(29 * 6)
    flat = matrix.flatten_components(reduced, 6)
    assert flat.columns == ["sample_id"] + [f"svd_{i}" for i in range(6)]
    assert matrix.projection(reduced, 0, 2).columns == ["sample_id", "component_x", "component_y"]


def test_standardize_long(cells):
    _, df = cells
    z = matrix.standardize_long(df).groupBy("feature_id")
    for row in z.agg(F.avg("z").alias("m"), F.stddev("z").alias("s")).collect():
        assert row.m == pytest.approx(0, abs=1e-12) and row.s == pytest.approx(1)


def test_version_collisions_are_averaged_in_log_space(spark):
    rows = [
        ("X.13", "s1", 2.0),
        ("X.13_PAR_Y", "s1", 4.0),
        ("X.13", "s2", 1.0),
        ("Y.1", "s1", 7.0),
        ("Z", "s1", 8.0),
    ]
    df = spark.createDataFrame(rows, "feature_id string, sample_id string, logcpm double")
    got = {(r.feature_id, r.sample_id): r.logcpm for r in normalize.collapse_versions(df).collect()}
    assert got == {("X", "s1"): 3.0, ("X", "s2"): 1.0, ("Y", "s1"): 7.0, ("Z", "s1"): 8.0}


def test_sparse_vectors_equal_dense_vectors(long_of):
    rng = np.random.default_rng(9)
    groups = {f"s{i}": "case" if i % 2 else "control" for i in range(12)}
    names = ["A.1", "A.2", "B.1", "C", "D.1", "D.2", "D.3"]
    counts = {f: {s: int(rng.poisson(2)) for s in groups} for f in names}
    # A sample whose only cell is in a feature that is not selected.
    groups["lone"] = "case"
    counts = {f: dict(cells, lone=0) for f, cells in counts.items()}
    counts["Z"] = dict.fromkeys(groups, 1)
    sparse = {f: {s: c for s, c in cells.items() if c} for f, cells in counts.items()}

    def vectors(table, implicit_zeros):
        labelled = matrix.label_cohort(long_of(table, groups), "LUNG")
        rows, features, _ = flows.feature_vectors(labelled, 3, implicit_zeros)
        order = [r.feature_id for r in features.orderBy("pos").collect()]
        values = rows.select("sample_id", vector_to_array("features").alias("v"))
        return order, {r.sample_id: r.v for r in values.collect()}

    order, dense = vectors(counts, False)
    assert "Z" not in order and "lone" in dense
    other, thin = vectors(sparse, True)
    assert order == other and dense.keys() == thin.keys()
    for sample in dense:
        assert thin[sample] == pytest.approx(dense[sample])


def test_union_labels(long_of):
    groups = {"s1": "case", "s2": "control"}
    long = long_of({"f": {"s1": 1, "s2": 2}}, groups)
    base = long_of({"f": {"b1": 3}}, {"b1": "baseline"})
    both = matrix.union_cohorts(
        [matrix.label_cohort(long, "LUNG"), matrix.label_cohort(base, "LUNG", control_only=True)]
    )
    got = {r.sample_id: (r.is_case, r.group_label) for r in both.collect()}
    assert got == {"s1": (1, "LUNG-case"), "s2": (0, "LUNG-control"), "b1": (0, "LUNG-control")}
    sizes = {r.group_label: r.n_samples for r in matrix.samples_per_group(both).collect()}
    assert sizes == {"LUNG-case": 1, "LUNG-control": 2}


def test_pivot(spark):
    rows = [("s1", "a", 1), ("s2", "b", 2)]
    df = spark.createDataFrame(rows, "sample_id string, feature_id string, count long")
    got = {r.sample_id: (r.a, r.b) for r in matrix.pivot_matrix(df, ["a", "b"]).collect()}
    assert got == {"s1": (1, 0), "s2": (0, 2)}


def test_low_rank_svd_has_no_noise_components(spark):
    from pyspark.ml.linalg import Vectors

    from contrast.operators import matrix

    rows = [(f"s{i}", Vectors.dense([i, 2.0 * i, -i])) for i in range(8)]
    reduced, sigma = matrix.svd_features(spark.createDataFrame(rows, ["sample_id", "features"]), 3)
    assert len(sigma) == 1
    flat = matrix.flatten_components(reduced, 3).collect()
    assert all(r.svd_0 is not None and r.svd_1 is None and r.svd_2 is None for r in flat)
    assert matrix.projection(reduced, 0, 2).where("component_y is null").count() == 8
