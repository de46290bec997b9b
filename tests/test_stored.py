"""What the planner and the reader make of the stored layouts."""

import pytest
from pyspark.sql import functions as F

from contrast.operators import serving, target
from contrast.sources import buckets, tables


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_scanned(df):
    """Rows that the scans of a plan gave out, after running it."""
    df.collect()
    found = []

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        if name.startswith("FileSourceScan"):
            found.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return sum(found)


@pytest.fixture
def sides(spark):
    keys = spark.range(3000).select(
        F.when(F.col("id") % 7 > 0, F.concat(F.lit("c"), F.col("id") % 3)).alias("cohort"),
        F.concat(F.lit("f.'"), F.floor(F.col("id") / 3)).alias("feature_id"),
        "id",
    )
    effects = keys.where("id % 2 = 0").select("cohort", "feature_id", (F.col("id") * 0.5).alias("log2fc"))
    return effects, keys.where("id % 5 > 0").select("cohort", "feature_id", F.col("id").alias("baseline_mean_logcpm"))


def test_stored_sides_join_without_an_exchange(spark, sides, tmp_path):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        stored = []
        for i, side in enumerate(sides):
            path = str(tmp_path / f"it's {i}")
            buckets.write_bucketed(side, path, target.FEATURE, 8)
            stored.append(buckets.read_bucketed(spark, path))
        joined = target.effect_baseline_join(*stored)
        plain = target.effect_baseline_join(*sides)
        rows = lambda df: sorted(map(tuple, df.collect()))
        assert rows(joined) == rows(plain) and len(rows(joined)) > 500
        assert "Exchange" not in plan_of(joined) and "Exchange" in plan_of(plain)
        # An aggregate by the same key needs none either.
        assert "Exchange" not in plan_of(stored[0].groupBy(*target.FEATURE).agg(F.sum("log2fc")))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_stored_table_is_replaced_and_read_by_another_session(spark, sides, tmp_path):
    path = str(tmp_path / "side")
    for part in (sides[0], sides[0].where("log2fc > 100"), sides[0].where(F.lit(False))):
        buckets.write_bucketed(part, path, target.FEATURE, 4)
        assert buckets.read_bucketed(spark, path).count() == part.count()
        assert buckets.read_bucketed(spark.newSession(), path).count() == part.count()
    assert buckets.read_bucketed(spark, path).dtypes == sides[0].dtypes


def documents(spark, n=4000):
    """Keys with even numbers only, the same range in every cohort."""
    return spark.range(n).select(
        F.concat(F.lit("c"), F.col("id") % 4).alias("cohort"),
        F.concat(F.lit("f"), "id").alias("feature_id"),
        F.format_string("S%06d", F.col("id") * 2).alias("symbol"),
        F.format_string("S%06d", F.col("id") * 2).alias("symbol_key"),
        F.struct(F.lit(1.0).alias("log2fc"), F.lit(0.1).alias("fdr")).alias("efficacy"),
        F.struct(F.lit(2.0).alias("baseline_mean_logcpm")).alias("safety"),
        F.rand(1).alias("target_score"),
        F.lit("candidate").alias("verdict"),
    )


def test_a_lookup_miss_reads_no_row_group(spark, tmp_path):
    path = str(tmp_path / "profiles")
    tables.write_profiles(documents(spark), path)
    stored = tables.read_profiles(spark, path)
    # Within the range of every file, but in none of them.
    misses = [f"s{k:06d}" for k in range(2001, 2021, 2)]
    assert sum(rows_scanned(serving.find(stored, name)) for name in misses) == 0
    assert rows_scanned(serving.find(stored, "s002002")) > 0
    assert serving.find(stored, "s002002").count() == 1
    found = serving.lookup_names(stored, ["s002001", "S002004"]).collect()
    assert {(r.wanted, r.found) for r in found} == {("s002001", False), ("S002004", True)}


def test_without_the_filter_a_miss_reads_rows(spark, tmp_path):
    """The filter is what skips them: the same layout without it is read."""
    path = str(tmp_path / "plain")
    documents(spark).repartitionByRange("cohort", "symbol_key").sortWithinPartitions("cohort", "symbol_key").write.option(
        "parquet.enable.dictionary#symbol_key", "false"
    ).partitionBy("cohort").parquet(path)
    assert rows_scanned(serving.find(tables.read_profiles(spark, path), "s002001")) > 0
