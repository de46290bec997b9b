"""Tables on disk: pairs, long tables, results and profiles."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from contrast import settings as S
from contrast.functions.columns import layout_bucket

LONG_SCHEMA = "`group` string, feature_id string, sample_id string, count long, cohort string"
PROFILE_SCHEMA = (
    "feature_id string, symbol string, symbol_key string, "
    "efficacy struct<log2fc: double, fdr: double>, "
    "safety struct<baseline_mean_logcpm: double>, "
    "target_score double, verdict string, cohort string"
)


def read_pairs(spark, path, names):
    """Headerless two-column text table, such as sample labels or symbols."""
    schema = ", ".join(f"{name} string" for name in names)
    return spark.read.csv(path, sep=S.FIELD_SEPARATOR, schema=schema)


def write_pairs(df, path):
    df.write.mode("overwrite").csv(path, sep=S.FIELD_SEPARATOR)


def read_long(spark, path, cohorts=None, bucket=None):
    """Long table; cohorts and a feature bucket prune the partitions to read.

    The schema is given, so a cohort named like a number stays a string.
    """
    long = spark.read.schema(f"{LONG_SCHEMA}, feature_bucket int").parquet(path)
    if cohorts is not None:
        long = long.where(F.col("cohort").isin(*cohorts))
    if bucket is not None:
        long = long.where(F.col("feature_bucket") == bucket)
    return long.drop("feature_bucket")


def write_long(long, path, feature_buckets=None):
    """Long table partitioned by cohort, and by feature bucket if asked for.

    The rebalance hint lets Spark split a hot cohort or feature into several files
    and merge small ones. Only the cohorts in ``long`` are replaced. Rows of a
    feature sit together, which keeps partial aggregation by feature small.
    """
    parts = ["cohort"]
    if feature_buckets:
        long = long.withColumn("feature_bucket", layout_bucket("feature_id", feature_buckets))
        parts.append("feature_bucket")
    (
        long.hint("rebalance", *parts, "feature_id")
        .sortWithinPartitions(*parts, "feature_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*parts)
        .parquet(path)
    )


def write_result(df, path):
    df.write.mode("overwrite").parquet(path)


def export_csv(df, path):
    """CSV with a header in every part; as many parts as the result has partitions."""
    df.write.mode("overwrite").csv(path, header=True)


def read_csv_result(spark, path, schema):
    """The columns of ``schema`` from a CSV with header, found by name.

    Their order in the file and further columns don't matter; a missing one is an error.
    """
    found = spark.read.csv(path, header=True)
    fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    missing = [field.name for field in fields if field.name not in found.columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return found.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])


def audit_long(long):
    """Rows, distinct features and distinct samples of each cohort.

    One aggregation per counted column, each of which reads that column alone and is
    combined before it is shuffled; no cell is expanded.
    """
    features = (
        long.groupBy("cohort", "feature_id")
        .agg(F.count("*").alias("cells"))
        .withColumns({"feature": F.col("feature_id").isNotNull(), "sample": F.lit(False)})
        .select("cohort", "cells", "feature", "sample")
    )
    samples = (
        long.select("cohort", "sample_id")
        .distinct()
        .withColumns({"cells": F.lit(0), "feature": F.lit(False), "sample": F.col("sample_id").isNotNull()})
        .select("cohort", "cells", "feature", "sample")
    )
    return (
        features.unionByName(samples)
        .groupBy("cohort")
        .agg(
            F.sum("cells").alias("n_rows"),
            F.count_if("feature").alias("n_features"),
            F.count_if("sample").alias("n_samples"),
        )
    )


def label_distribution(long):
    """Distinct samples by group."""
    return (
        long.select("cohort", "sample_id", "group")
        .distinct()
        .groupBy("cohort", "group")
        .agg(F.count("*").alias("n_samples"))
    )


def write_profiles(documents, path, replace="cohorts", row_group_bytes=None):
    """Profile documents by cohort, sorted by lookup key so row groups can be skipped.

    A Bloom filter of the lookup keys in every row group skips what the sort leaves: a
    key that lies within the range of every cohort's files but is in none of them.
    ``replace='cohorts'`` replaces the cohorts at hand, ``'all'`` the whole table.
    """
    mode = {"cohorts": "dynamic", "all": "static"}[replace]
    options = {
        "parquet.bloom.filter.enabled#symbol_key": "true",
        "parquet.bloom.filter.adaptive.enabled": "true",
        # The keys hardly repeat within a file; a dictionary of them would be a second copy.
        "parquet.enable.dictionary#symbol_key": "false",
    }
    if row_group_bytes:
        options["parquet.block.size"] = str(row_group_bytes)
    (
        documents.repartitionByRange("cohort", "symbol_key", "feature_id")
        .sortWithinPartitions("cohort", "symbol_key", "feature_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", mode)
        .options(**options)
        .partitionBy("cohort")
        .parquet(path)
    )


def read_profiles(spark, path):
    return spark.read.schema(PROFILE_SCHEMA).parquet(path)
