"""Profile documents, lookups and ranked reports."""

from pyspark.sql import functions as F

from contrast.functions import columns as C
from contrast.operators.target import verdict
from contrast.plans.topk import top_k


def profiles(scores, safe_max=None):
    """One nested document per (cohort, feature)."""
    judged = scores if "verdict" in scores.columns else verdict(scores, safe_max)
    return judged.select(
        "cohort",
        "feature_id",
        "symbol",
        F.upper("symbol").alias("symbol_key"),
        F.struct("log2fc", "fdr").alias("efficacy"),
        F.struct("baseline_mean_logcpm").alias("safety"),
        "target_score",
        "verdict",
    )


def find(documents, symbol):
    """Documents of one symbol in any case; the filter reaches the Parquet scan."""
    return documents.where(F.col("symbol_key") == symbol.upper())


def lookup(documents, keys):
    """Batch lookup by symbol; keys without a document come back with ``found`` false."""
    wanted = keys.select(F.col("symbol").alias("wanted"), F.upper("symbol").alias("symbol_key"))
    return wanted.join(documents, "symbol_key", "left").select(
        "wanted",
        F.col("feature_id").isNotNull().alias("found"),
        "cohort",
        "feature_id",
        "verdict",
        "target_score",
        F.col("efficacy.log2fc").alias("log2fc"),
        F.col("efficacy.fdr").alias("fdr"),
        F.col("safety.baseline_mean_logcpm").alias("baseline_mean_logcpm"),
    )


def lookup_names(documents, names):
    """Lookup of symbols that are known here; their keys reach the Parquet scan."""
    spark = documents.sparkSession
    keys = spark.createDataFrame([(name,) for name in names], "symbol string").distinct()
    upper = [row[0] for row in keys.select(F.upper("symbol")).distinct().collect()]
    return lookup(documents.where(F.col("symbol_key").isin(upper)), keys)


def top_candidates(documents, k=10, by=("cohort",)):
    order = [C.stable("target_score").desc(), "feature_id"]
    return top_k(documents.where("verdict = 'candidate'"), k, order, by)


def top_danger(documents, k=5, by=("cohort",)):
    order = [C.stable("safety.baseline_mean_logcpm").desc(), "feature_id"]
    return top_k(documents.where("verdict = 'danger'"), k, order, by)


def serve_stats(documents):
    """Documents served per cohort, in total and by verdict."""
    names = {"candidate": "n_candidate", "danger": "n_danger", "not_significant": "n_not_significant"}
    counts = [F.count_if(F.col("verdict") == name).alias(out) for name, out in names.items()]
    return documents.groupBy("cohort").agg(F.count("*").alias("n_total"), *counts)
