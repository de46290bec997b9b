import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from contrast.functions import columns as C
from contrast.operators import diff, moments, normalize

GROUPS = {f"t{i}": "case" for i in range(4)} | {f"n{i}": "control" for i in range(3)}
COUNTS = {
    "f1": dict(zip(GROUPS, (10, 12, 15, 11, 2, 3, 1))),
    "f2": dict(zip(GROUPS, (1, 0, 2, 1, 30, 41, 28))),
    "f3": dict(zip(GROUPS, (50, 60, 40, 55, 52, 61, 47))),
    "only_case": dict(zip(GROUPS, (5, 5, 4, 6, 0, 0, 0))),
}


def reference_welch(counts, groups):
    """Welch statistics by numpy over the dense matrix."""
    library = {s: sum(cells.get(s, 0) for cells in counts.values()) for s in groups}
    out = {}
    for feature, cells in counts.items():
        y = {s: math.log2(cells.get(s, 0) / library[s] * 1e6 + 1) for s in groups}
        case = np.array([y[s] for s in groups if groups[s] == "case"])
        control = np.array([y[s] for s in groups if groups[s] == "control"])
        a, b = case.var(ddof=1) / len(case), control.var(ddof=1) / len(control)
        if a + b > 0:
            t = (case.mean() - control.mean()) / math.sqrt(a + b)
            df = (a + b) ** 2 / (a**2 / (len(case) - 1) + b**2 / (len(control) - 1))
            out[feature] = (case.mean() - control.mean(), t, df)
    return out


@pytest.mark.parametrize("sparse", [False, True])
def test_welch_equals_numpy_dense_and_sparse(long_of, sparse):
    counts = COUNTS
    if sparse:
        counts = {f: {s: c for s, c in cells.items() if c} for f, cells in COUNTS.items()}
    long = long_of(counts, GROUPS)
    got = {
        r.feature_id: (r.log2fc, r.t_stat, r.df)
        for r in diff.diff_core(long, implicit_zeros=sparse).collect()
    }
    want = reference_welch(COUNTS, GROUPS)
    assert got.keys() == want.keys()
    for feature in want:
        assert got[feature] == pytest.approx(want[feature], rel=1e-9)


def test_feature_in_one_group_only_is_dropped_without_implicit_zeros(long_of):
    counts = dict(COUNTS, lonely={s: 9 for s in GROUPS if GROUPS[s] == "case"})
    tested = {r.feature_id for r in diff.diff_core(long_of(counts, GROUPS)).collect()}
    assert "lonely" not in tested and "f1" in tested


def test_single_sample_group_and_zero_variance_are_dropped(long_of):
    groups = {"t1": "case", "t2": "case", "n1": "control"}
    counts = {"f": {"t1": 5, "t2": 9, "n1": 7}, "g": {"t1": 3, "t2": 1, "n1": 1}}
    assert diff.diff_core(long_of(counts, groups)).count() == 0
    groups["n2"] = "control"
    flat = {"f": {s: 5 for s in groups}, "g": {s: 7 for s in groups}}
    assert diff.diff_core(long_of(flat, groups)).count() == 0


def test_zero_library_gives_null_and_leaves_the_counts(long_of):
    groups = dict(GROUPS, empty="case")
    counts = {f: dict(cells, empty=0) for f, cells in COUNTS.items()}
    long = long_of(counts, groups)
    cells = normalize.log_cpm(long).where("sample_id = 'empty'").collect()
    assert all(r.cpm is None and r.logcpm is None for r in cells)
    for sparse in (False, True):
        tested = diff.diff_core(long, implicit_zeros=sparse).collect()
        assert {r.n_case for r in tested} == {4}


def test_expression_filter_is_strict_and_rounds_half_to_even(spark, long_of):
    # Library size 1,000,000: a count of 1 is exactly cpm 1 and does not count.
    groups = {f"s{i}": "case" for i in range(5)}
    counts = {
        "big": {s: 999_998 - (i == 0) for i, s in enumerate(groups)},
        "at_one": {s: 1 for s in groups},
        "above": {s: 1 + (i == 0) for i, s in enumerate(groups)},
    }
    kept = {r.feature_id: r for r in normalize.expressed_features(long_of(counts, groups)).collect()}
    assert set(kept) == {"big", "above"}
    assert kept["above"].n_expressed == 1 and kept["above"].min_samples == 1
    values = spark.createDataFrame([(5,), (15,), (25,)], "n long")
    halves = values.select(normalize.min_samples("n", 0.5).alias("m")).collect()
    assert [r.m for r in halves] == [2, 8, 12]


def test_cpm_sums_to_a_million(long_of):
    cells = normalize.log_cpm(long_of(COUNTS, GROUPS))
    for row in cells.groupBy("sample_id").agg(F.sum("cpm").alias("s")).collect():
        assert row.s == pytest.approx(1e6)


def test_salted_library_join_gives_the_same_cells(long_of):
    long = long_of(COUNTS, GROUPS)
    key = lambda r: (r.feature_id, r.sample_id)
    plain = sorted(normalize.log_cpm(long).collect(), key=key)
    salted = sorted(normalize.log_cpm(long, broadcast_limit=0).collect(), key=key)
    assert [r.asDict() for r in plain] == [r.asDict() for r in salted]


@pytest.mark.parametrize(
    "t, df, p",
    [
        (0.0, 5.0, 1.0),
        (2.0, 10.0, 0.0733880347707403),
        (-2.0, 10.0, 0.0733880347707403),
        (300.0, 1200.0, 0.0),
    ],
)
def test_t_pvalue_known_values(spark, t, df, p):
    row = spark.createDataFrame([(t, df)], "t double, df double").select(C.t_pvalue("t", "df"))
    assert row.first()[0] == pytest.approx(p, rel=1e-12)


def test_swapping_the_groups_flips_the_sign(long_of):
    swapped = {s: "control" if g == "case" else "case" for s, g in GROUPS.items()}
    left = {r.feature_id: r for r in diff.diff_core(long_of(COUNTS, GROUPS)).collect()}
    right = {r.feature_id: r for r in diff.diff_core(long_of(COUNTS, swapped)).collect()}
    for feature, row in left.items():
        assert row.t_stat == pytest.approx(-right[feature].t_stat)
        assert row.df == pytest.approx(right[feature].df)


def plain_bh(pvalues):
    order = sorted(range(len(pvalues)), key=lambda i: pvalues[i])
    out, low = [0.0] * len(pvalues), 1.0
    for rank in range(len(order), 0, -1):
        i = order[rank - 1]
        low = min(low, pvalues[i] * len(pvalues) / rank)
        out[i] = low
    return out


def run_bh(spark, groups):
    rows = [(c, f"f{i:04d}", p) for c, ps in groups.items() for i, p in enumerate(ps)]
    df = spark.createDataFrame(rows, "cohort string, feature_id string, pvalue double")
    return moments.bh_fdr(df.repartition(3)).collect()


def check_bh(spark, groups):
    got = run_bh(spark, groups)
    for cohort, pvalues in groups.items():
        rows = sorted((r for r in got if r.cohort == cohort), key=lambda r: r.feature_id)
        assert [r.fdr for r in rows] == pytest.approx(plain_bh(pvalues), rel=1e-8)
        assert all(r.pvalue <= r.fdr * (1 + 1e-8) and r.fdr <= 1 for r in rows)
        by_rank = sorted(rows, key=lambda r: r.rank)
        assert [r.rank for r in by_rank] == list(range(1, len(rows) + 1))
        assert [(r.pvalue, r.feature_id) for r in by_rank] == sorted(
            (r.pvalue, r.feature_id) for r in rows
        )
        assert all(a.fdr <= b.fdr for a, b in zip(by_rank, by_rank[1:]))


def test_bh_with_hot_ties_and_extremes(spark):
    rng = np.random.default_rng(0)
    hot = [1.0] * 400 + [0.0] * 100 + rng.random(700).tolist() + [1e-300, 1e-12, 1e-12]
    check_bh(spark, {"hot": hot, "small": [0.03], "pair": [0.5, 0.5]})


@settings(max_examples=5, deadline=None)
@given(st.lists(st.sampled_from([0.0, 1e-9, 0.01, 0.02, 0.3, 0.5, 1.0]), min_size=1, max_size=60))
def test_bh_property(spark, pvalues):
    check_bh(spark, {"c": pvalues})


def test_diff_analysis_summary(long_of):
    de = diff.diff_analysis(long_of(COUNTS, GROUPS))
    assert de.columns == diff.RESULT
    row = diff.de_summary(de).first()
    assert row.n_tested == 4 and row.n_up + row.n_down <= row.n_significant
    best = diff.top_by_pvalue(de, 1).first()
    assert best["rank"] == 1


def test_cohorts_are_independent(long_of):
    both = long_of(COUNTS, GROUPS, "a").unionByName(
        long_of({f: COUNTS[f] for f in ("f1", "f2", "f3")}, GROUPS, "b")
    )
    alone = diff.diff_analysis(long_of(COUNTS, GROUPS, "a")).orderBy("feature_id").collect()
    together = diff.diff_analysis(both).where("cohort = 'a'").orderBy("feature_id").collect()
    for left, right in zip(alone, together, strict=True):
        assert left.feature_id == right.feature_id and left["rank"] == right["rank"]
        assert left.fdr == pytest.approx(right.fdr)


def test_null_and_nan_p_values_are_no_tests(spark):
    from contrast.operators.moments import bh_fdr

    rows = [("c", "a", 0.01), ("c", "b", None), ("c", "d", float("nan")), ("c", "e", 0.04), (None, "f", 0.5)]
    got = {r.feature_id: r for r in bh_fdr(spark.createDataFrame(rows, "cohort string, feature_id string, pvalue double")).collect()}
    assert got["b"].fdr is None and got["b"]["rank"] is None and got["d"].fdr is None
    assert abs(got["a"].fdr - 0.02) < 1e-12 and abs(got["e"].fdr - 0.04) < 1e-12


def test_null_cohort_keeps_its_rows(spark):
    from contrast.operators.target import zscore

    rows = [(None, 1.0), (None, 3.0), ("c", 2.0), ("c", 4.0)]
    scored = zscore(spark.createDataFrame(rows, "cohort string, v double"), {"v": "z"})
    assert sorted(round(r.z, 6) for r in scored.collect()) == [-0.707107, -0.707107, 0.707107, 0.707107]


def test_constants_do_not_shuffle_the_big_side(spark):
    from contrast.operators.target import zscore

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        big = spark.range(5000).selectExpr("cast(id % 5 as string) cohort", "cast(id as double) v")
        plan = zscore(big, {"v": "z"})._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(cohort" not in plan and "BroadcastHashJoin" in plan


def _packed(long):
    """Two cells a row at most, so a sample has several rows."""
    half = F.pmod(F.xxhash64("feature_id"), F.lit(2)).alias("half")
    grouped = long.groupBy("cohort", "group", "sample_id", half)
    return grouped.agg(F.collect_list(F.struct("feature_id", "count")).alias("cells")).drop("half")


def test_packed_tables_give_the_same_results(long_of):
    long = long_of(COUNTS, GROUPS)
    packed = _packed(long)
    key = lambda df: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)
    names = ["cohort", "group", "feature_id", "sample_id", "count", "lib_size", "logcpm"]
    assert key(normalize.log_cpm(packed).select(*names)) == key(normalize.log_cpm(long).select(*names))
    assert key(normalize.library_size(packed)) == key(normalize.library_size(long))
    assert key(diff.diff_analysis(packed, implicit_zeros=True)) == key(diff.diff_analysis(long, implicit_zeros=True))


def test_libraries_meet_the_rows_of_samples_and_not_their_cells(long_of, capsys):
    normalize.log_cpm(_packed(long_of(COUNTS, GROUPS)), broadcast_limit=0).explain()
    plan = capsys.readouterr().out
    assert plan.index("Generate explode(cells") < plan.index("SortMergeJoin")


def test_moments_are_taken_once_for_tested_and_untested_rows(long_of, capsys):
    diff.diff_analysis(long_of(COUNTS, GROUPS), implicit_zeros=True).explain()
    assert "LOG2" not in capsys.readouterr().out
