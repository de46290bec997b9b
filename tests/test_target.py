import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from contrast.operators import serving, target
from contrast.sources import tables


@pytest.fixture
def scores(spark):
    rows = [
        ("c", "f1", "F1", 2.0, 0.01, 1.0, 3.0),
        ("c", "f2", "F2", 2.0, 0.01, 2.0, 2.0),
        ("c", "f3", "f3", 1.0, 0.01, 0.5, 1.0),
        ("c", "f4", "f4", 5.0, 0.05, 0.5, 4.0),
        ("c", "f5", "f5", 5.0, None, 9.0, 4.5),
        ("c", "f6", "f6", 5.0, float("nan"), 9.0, 4.6),
        ("c", "f7", "f7", 3.0, 0.02, 7.0, -1.0),
    ]
    names = "cohort string, feature_id string, symbol string, log2fc double, fdr double"
    return spark.createDataFrame(
        rows, names + ", baseline_mean_logcpm double, target_score double"
    )


def test_verdict_limits(scores):
    got = {r.feature_id: r.verdict for r in target.verdict(scores, safe_max=2.0).collect()}
    # A baseline exactly at the limit is safe; an effect exactly 1 or an fdr of 0.05 is not enough.
    assert got == {
        "f1": "candidate",
        "f2": "candidate",
        "f3": "not_significant",
        "f4": "not_significant",
        "f5": "not_significant",
        "f6": "not_significant",
        "f7": "danger",
    }


def test_quadrant_uses_the_quantile_of_all_features(scores):
    zoned = {r.feature_id: r for r in target.quadrant(scores).collect()}
    threshold = np.percentile([1.0, 2.0, 0.5, 0.5, 9.0, 9.0, 7.0], 25)
    assert zoned["f1"].safe_max == pytest.approx(threshold)
    assert zoned["f1"].zone == ("good" if 1.0 <= threshold else "danger")
    assert zoned["f7"].zone == "danger" and zoned["f3"].zone == "background"
    labels = {r.feature_id for r in target.quadrant_labels(target.quadrant(scores), 1, 1).collect()}
    assert "f7" in labels


def test_score_carries_the_threshold(scores, monkeypatch):
    """The same zones and verdicts, also where the constants are too large to broadcast."""
    de = scores.select("cohort", "feature_id", "log2fc", "fdr")
    baseline = scores.select(
        "cohort", "feature_id", "baseline_mean_logcpm", F.lit(0.0).alias("baseline_median_logcpm")
    )
    symbols = scores.select("feature_id", "symbol").limit(3)
    plain = target.target_score(de, baseline, symbols)
    for limit in (None, 0):
        if limit is not None:
            monkeypatch.setattr("contrast.plans.settle.BROADCAST_LIMIT", limit)
        carried = target.target_score(de, baseline, symbols, safe_quantile=0.25)
        assert carried.columns == [*plain.columns, "safe_max"]
        for judge, names in ((target.quadrant, ["safe_max", "zone"]), (target.verdict, ["verdict"])):
            rows = [sorted(judge(t).select("feature_id", *names).collect()) for t in (plain, carried)]
            assert rows[0] == rows[1] and len(rows[0]) == 7


def test_zscore_has_mean_zero_and_sd_one(scores):
    z = target.zscore(scores, {"log2fc": "z"})
    row = z.agg(F.avg("z").alias("m"), F.stddev("z").alias("s")).first()
    assert row.m == pytest.approx(0, abs=1e-12) and row.s == pytest.approx(1)


@pytest.fixture
def tested(spark):
    rows = [
        ("c", "a", 1.0, 1e-10, 1e-9),
        ("c", "b", -1.0, 1e-8, 1e-7),
        ("c", "d", 0.99, 1e-8, 1e-7),
        ("c", "e", 4.0, 0.0, 0.0),
        ("c", "g", 3.0, 0.9, 0.95),
        ("c", "h", 2.0, 1e-3, float("nan")),
    ]
    return spark.createDataFrame(
        rows, "cohort string, feature_id string, log2fc double, pvalue double, fdr double"
    )


def test_volcano_sides_floor_and_symbols(spark, tested):
    symbols = spark.createDataFrame([("a", "A")], "feature_id string, symbol string")
    got = {r.feature_id: r for r in target.volcano_points(tested, symbols).collect()}
    sides = {f: r.side for f, r in got.items()}
    assert sides == {"a": "up", "b": "down", "d": "none", "e": "up", "g": "none", "h": "none"}
    assert got["e"].neglog10p == pytest.approx(-math.log10(5e-324), abs=0.01)
    assert got["a"].symbol == "A" and got["b"].symbol == "b"


def test_volcano_labels_are_distinct(spark, tested):
    symbols = spark.createDataFrame([], "feature_id string, symbol string")
    labels = target.volcano_labels(target.volcano_points(tested, symbols), k=1, extremes=2)
    names = [r.feature_id for r in labels.collect()]
    assert sorted(names) == ["a", "b", "e"]


def test_sparse_baseline_equals_dense_baseline(long_of):
    rng = np.random.default_rng(3)
    groups = {f"s{i}": "baseline" for i in range(9)}
    counts = {
        f"f{k}": {s: int(c) for s, c in zip(groups, rng.poisson(rate, len(groups)))}
        for k, rate in enumerate((0.2, 0.5, 0.7, 1.0, 2.0, 30.0))
    }
    counts["half"] = {s: i % 2 for i, s in enumerate(groups)}
    counts["all"] = {s: i + 1 for i, s in enumerate(groups)}
    sparse = {f: {s: c for s, c in cells.items() if c} for f, cells in counts.items()}
    dense_rows = target.baseline_profile(long_of(counts, groups)).collect()
    sparse_rows = target.baseline_profile(long_of(sparse, groups), implicit_zeros=True).collect()
    got = {r.feature_id: r for r in sparse_rows}
    for row in dense_rows:
        if row.feature_id in got:
            twin = got[row.feature_id]
            assert twin.baseline_mean_logcpm == pytest.approx(row.baseline_mean_logcpm)
            assert twin.baseline_median_logcpm == pytest.approx(row.baseline_median_logcpm)
    assert {r.feature_id for r in dense_rows} - set(got) <= {f for f, c in sparse.items() if not c}


def test_recurrence_counts_cohorts(spark):
    rows = [
        (cohort, "f", "F", "candidate", 1.0, 2.0) for cohort in ("a", "b", "d")
    ] + [("a", "g", "G", "candidate", 1.0, 2.0), ("b", "g", "G", "danger", 1.0, 2.0)]
    judged = spark.createDataFrame(
        rows,
        "cohort string, feature_id string, symbol string, verdict string, target_score double, log2fc double",
    )
    assert [(r.symbol, r.n_cohorts) for r in target.recurrence(judged, 3).collect()] == [("F", 3)]
    assert target.recurrence(judged, 1).count() == 2


def test_profiles_lookup_and_reload(spark, scores, tmp_path):
    path = str(tmp_path / "profiles")
    documents = serving.profiles(scores, safe_max=2.0)
    tables.write_profiles(documents, path)
    tables.write_profiles(documents, path)
    other = documents.withColumn("cohort", F.lit("d")).where("feature_id = 'f1'")
    tables.write_profiles(other, path)
    back = tables.read_profiles(spark, path)
    assert back.groupBy("cohort").count().orderBy("cohort").collect() == [("c", 7), ("d", 1)]
    keys = spark.createDataFrame([("F1",), ("F3",), ("nope",)], "symbol string")
    found = serving.lookup(back, keys).collect()
    assert sorted((r.wanted, r.found, r.cohort) for r in found if r.found) == [
        ("F1", True, "c"),
        ("F1", True, "d"),
        ("F3", True, "c"),
    ]
    assert [r.wanted for r in found if not r.found] == ["nope"]
    one = serving.find(back, "f1")
    assert one.count() == 2
    assert "EqualTo(symbol_key,F1)" in one._jdf.queryExecution().executedPlan().toString()
    stats = {r.cohort: r for r in serving.serve_stats(back).collect()}
    assert (stats["c"].n_total, stats["c"].n_candidate, stats["c"].n_danger) == (7, 2, 1)
    assert [r.symbol for r in serving.top_candidates(back, 1, by=()).collect()] == ["F1"]
    assert [r.symbol for r in serving.top_danger(back, 5).collect()] == ["f7"]
    tables.write_profiles(other, path, replace="all")
    assert tables.read_profiles(spark, path).count() == 1
