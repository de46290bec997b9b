import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from contrast.plans import ordered, settle as plan
from contrast.plans.ordered import group_rank
from contrast.plans.settle import settle
from contrast.plans.topk import top_k


def skewed(spark, n=4000):
    """A third of all rows in one group and a third of all rows on one value."""
    rng = random.Random(1)
    rows = []
    for i in range(n):
        group = "hot" if i % 3 == 0 else f"g{rng.randrange(5)}"
        value = 0.5 if rng.random() < 0.34 else rng.random()
        rows.append((group, value, f"k{i:05d}"))
    return rows, spark.createDataFrame(rows, "g string, v double, k string").repartition(7)


@pytest.mark.parametrize("by", [["g"], []])
def test_rank_equals_a_plain_sort(spark, by):
    rows, df = skewed(spark)
    placed = ordered.place(df, by, ["v", "k"])
    assert placed.select(ordered.BUCKET).distinct().count() >= 1
    got = ordered.rank(placed, by, ["v", "k"], "r", total="n").collect()
    groups = {}
    for g, v, k in rows:
        groups.setdefault(g if by else None, []).append((v, k))
    want = {}
    for members in groups.values():
        for i, (_, k) in enumerate(sorted(members)):
            want[k] = (i + 1, len(members))
    assert {row.k: (row.r, row.n) for row in got} == want


def test_rank_uses_several_buckets_for_one_group(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(1000).select(F.lit("one").alias("g"), F.lit(1.0).alias("v"), "id")
        placed = ordered.place(df, ["g"], ["v", "id"])
        assert placed.select(ordered.BUCKET).distinct().count() == 4
        ranks = ordered.rank(placed, ["g"], ["v", "id"]).collect()
        assert all(row["rank"] == row.id + 1 for row in ranks)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_group_quantile_equals_numpy(spark, q):
    rows, df = skewed(spark)
    got = {r.g: r.q for r in ordered.group_quantile(df, ["g"], "v", q, "q").collect()}
    for group in {g for g, _, _ in rows}:
        values = [v for g, v, _ in rows if g == group]
        assert got[group] == pytest.approx(np.percentile(values, 100 * q), abs=1e-12)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_broadcast_join(spark, how):
    _, df = skewed(spark, 900)
    side = plan.settle(spark.createDataFrame([("hot", 1), ("g1", 2)], "g string, w int"))
    small = plan.join_side(df, side, ["g"], how)
    large = plan.join_side(df, side, ["g"], how, limit=0)
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
    assert sorted(small.collect(), key=str) == sorted(large.collect(), key=str)


def test_measured_bytes_grows_with_the_strings(spark):
    small = plan.measured_bytes(spark.createDataFrame([("a",)], "s string"))
    large = plan.measured_bytes(spark.createDataFrame([("a" * 1000,)], "s string"))
    assert large - small == 999
    assert plan.measured_bytes(spark.createDataFrame([], "s string")) == 0


def test_size_is_measured_once_and_covers_numeric_arrays(spark, monkeypatch):
    wide = plan.settle(spark.range(50).select("id", F.sequence(F.lit(1), F.col("id")).alias("numbers")))
    size = plan.measured_bytes(wide)
    assert size > 50 * 48 + 16 * 1000
    monkeypatch.setattr(plan, "_width", None)
    assert plan.measured_bytes(wide) == size
    monkeypatch.undo()
    assert plan.measured_bytes(wide.limit(0)) == 0


def test_constants_of_a_known_size_are_not_written(spark, monkeypatch):
    rows = spark.createDataFrame([("a", 1), ("a", 2), (None, 5)], "cohort string, v long")
    sums = rows.groupBy("cohort").agg(F.sum("v").alias("total"))
    wanted = {("a", 1, 3), ("a", 2, 3), (None, 5, 5)}
    for limit in (0, None):
        joined = plan.attach_constants(rows, sums, ["cohort"], limit=limit, size=1000)
        assert {tuple(r) for r in joined.collect()} == wanted
    monkeypatch.setattr(plan, "scratch_path", None)
    joined = plan.attach_constants(rows, sums, ["cohort"], size=1000)
    assert {tuple(r) for r in joined.collect()} == wanted


def test_scratch_uses_the_configured_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir", None) or plan.shared_dir(spark)
    assert plan.scratch_path(spark, "x").startswith(folder)
    assert plan.scratch_path(spark, "x") != plan.scratch_path(spark, "x")


def test_top_k_breaks_ties_by_the_last_key(spark):
    df = spark.createDataFrame(
        [("a", 1.0, "z"), ("a", 1.0, "y"), ("a", 0.5, "x"), ("b", 9.0, "w")],
        "cohort string, v double, k string",
    )
    got = {(r.cohort, r.k) for r in top_k(df, 1, [F.desc("v"), "k"]).collect()}
    assert got == {("a", "y"), ("b", "w")}
    assert [r.k for r in top_k(df, 2, [F.desc("v"), "k"], by=()).collect()] == ["w", "y"]


@pytest.mark.parametrize("parts", [1, 13])
def test_rank_selection_is_exact_under_any_partitioning(spark, parts):
    """Groups of over 10,000 values, of ties, of a wide range and of one value."""
    rng = np.random.default_rng(3)
    values = {
        "many": rng.gamma(2, 2, 12_001),
        "ties": rng.integers(0, 3, 15_000).astype(float),
        "wide": np.concatenate([-np.logspace(-300, 300, 700), np.logspace(-300, 300, 500), [np.inf, -np.inf, -0.0]]),
        "close": 7 + rng.random(5000) * 1e-9,
        "one": np.array([5.0]),
        None: rng.normal(size=10),
    }
    rows = [(g, float(v)) for g, vs in values.items() for v in vs] + [("many", None), ("many", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(parts)
    for q in (0.0, 0.1, 0.5, 1.0):
        wanted = {g: max(1, int(np.ceil(q * len(vs)))) for g, vs in values.items() if g}
        ranks = settle(spark.createDataFrame(list(wanted.items()), "g string, _rank long"), "ranks")
        got = {r.g: r.q for r in group_rank(df, ["g"], "v", ranks, "q").collect()}
        assert got == {g: np.sort(values[g])[r - 1] for g, r in wanted.items()}
    beyond = settle(spark.createDataFrame([("one", 2), ("none", 1)], "g string, _rank long"), "ranks")
    assert group_rank(df, ["g"], "v", beyond, "q").count() == 0


def test_medians_equal_quantile_disc(spark):
    """Above 10,000 cells a feature, with the zeros in the table and without them."""
    import duckdb
    import pyarrow as pa

    from contrast.operators import target

    rng = np.random.default_rng(4)
    cells = [
        ("c", "baseline", f"f{j}", f"s{i}", int(n))
        for j, mean in enumerate((0.3, 0.8, 2, 30))
        for i, n in enumerate(rng.poisson(mean, 11_000))
    ]
    schema = "cohort string, group string, feature_id string, sample_id string, count long"
    dense = settle(spark.createDataFrame(cells, schema), "dense")
    size = dict.fromkeys((c[3] for c in cells), 0)
    for c in cells:
        size[c[3]] += c[4]
    connection = duckdb.connect()
    drawn = pa.table({"f": [c[2] for c in cells], "n": [c[4] for c in cells], "s": [size[c[3]] for c in cells]})  # noqa: F841
    want = dict(
        connection.execute(
            "SELECT f, round(quantile_disc(log2(n * 1e6 / s + 1), 0.5), 9) FROM drawn WHERE s > 0 GROUP BY f"
        ).fetchall()
    )
    for long, sparse in ((dense, False), (dense.where("count > 0").repartition(9), True), (dense.repartition(3), True)):
        found = target.baseline_profile(long, implicit_zeros=sparse).collect()
        assert {r.feature_id: round(r.baseline_median_logcpm, 9) for r in found} == want
    assert want["f0"] == 0 and want["f3"] > 0


def test_no_zero_rows_are_made(spark, capsys):
    from contrast.operators import target

    rows = [("c", "baseline", f"f{i % 5}", f"s{i}", i) for i in range(40)]
    schema = "cohort string, group string, feature_id string, sample_id string, count long"
    target.baseline_profile(spark.createDataFrame(rows, schema), implicit_zeros=True).explain()
    assert "Generate" not in capsys.readouterr().out


def test_size_of_the_ranks_is_not_that_of_the_profile(spark, monkeypatch):
    """Features of a few samples have the median 0, so their number alone shuffles no cell."""
    from contrast.operators import target

    rows = [("c", "baseline", f"f{i}", f"s{i % 40}", 1) for i in range(4000)]
    rows += [("c", "baseline", "all", f"s{i}", 3) for i in range(40)]
    schema = "cohort string, group string, feature_id string, sample_id string, count long"
    sizes = []

    def noted(df, by, value, ranks, out, size=None):
        sizes.append((ranks.count(), size))
        return ranked(df, by, value, ranks, out, size)

    ranked = target.group_rank
    monkeypatch.setattr(target, "group_rank", noted)
    found = target.baseline_profile(spark.createDataFrame(rows, schema), implicit_zeros=True)
    got = {r.feature_id: r.baseline_median_logcpm for r in found.where("feature_id in ('all', 'f7')").collect()}
    assert got["f7"] == 0 and got["all"] > 10
    assert sizes[0][0] == 1 and sizes[0][1] < 1000


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_salted_copies_are_never_broadcast(spark, how, capsys):
    """Spark's own estimate is the compressed file of the side, not its copies."""
    big = spark.range(1000).select((F.col("id") % 50).alias("k"), "id")
    side = settle(spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")))
    joins = [
        plan.join_side(big, side, ["k"], how, limit=0),
        plan.attach_constants(big, side, ["k"], limit=0),
        big.join(plan.checked_side(side, limit=0), "k"),
    ]
    for joined in joins:
        joined.explain()
        shown = capsys.readouterr().out
        assert "SortMergeJoin" in shown and "Broadcast" not in shown
        assert joined.count() == 1000


def test_ranges_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS", 100)
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), (F.col("id") * 7 % 11).alias("v"), "id")
    placed = ordered.place(df, ["g"], ["v", "id"])
    assert placed.select(ordered.BUCKET).distinct().count() == 10
    ranked = ordered.rank(placed, ["g"], ["v", "id"], "r", total="n")
    got = {row.id: row.r for row in ranked.collect()}
    for g in (0, 1):
        order = sorted(range(g, 1000, 2), key=lambda i: (i * 7 % 11, i))
        assert [got[i] for i in order] == list(range(1, 501))
