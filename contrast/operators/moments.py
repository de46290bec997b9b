"""Group moments, Welch's test and the false discovery rate."""

from pyspark.sql import functions as F

from contrast import settings as S
from contrast.functions import columns as C
from contrast.operators.normalize import group_sizes, log_cpm, min_samples, sample_table
from contrast.plans.ordered import min_from_end, place, rank
from contrast.plans.settle import attach_constants, measured_bytes


def _explicit(group):
    """Moments of the cells that are there, for one group."""
    inside = F.col("group") == group
    value = F.when(inside, F.col("logcpm"))
    return [
        F.count_if(inside & (F.col("lib_size") > 0)).alias(f"_rows_{group}"),
        F.count(value).alias(f"_n_{group}"),
        F.avg(value).alias(f"_mean_{group}"),
        F.var_samp(value).alias(f"_var_{group}"),
    ]


def merge_zeros(n, mean, var, zeros):
    """Moments after adding ``zeros`` values of 0, without making the rows.

    The pairwise merge of two samples, the second having mean and spread 0.
    """
    total = n + zeros
    full_mean = F.when(zeros == 0, mean).otherwise(
        F.coalesce(mean, F.lit(0.0)) * F.try_divide(n, total)
    )
    spread = F.coalesce(var, F.lit(0.0)) * F.greatest(n - 1, F.lit(0))
    shift = F.coalesce(mean * mean, F.lit(0.0)) * F.try_divide(n * zeros, total)
    full_var = F.when(zeros == 0, var).otherwise(
        F.when(total > 1, F.try_divide(spread + shift, total - 1))
    )
    return total, full_mean, full_var


def feature_moments(
    long,
    implicit_zeros=False,
    min_cpm=S.MIN_CPM,
    min_fraction=S.MIN_FRACTION,
    samples=None,
    expressed_only=True,
):
    """Mean, sample variance and count of log-CPM per feature and group.

    One aggregation per (cohort, feature) serves the expression filter and both
    groups. With ``implicit_zeros`` a missing cell is a count of 0: it enters
    through the group sizes, never as a row.
    """
    samples = sample_table(long) if samples is None else samples
    cells = log_cpm(long, samples)
    per_feature = cells.groupBy("cohort", "feature_id").agg(
        F.count_if(F.col("cpm") > F.lit(min_cpm)).alias("n_expressed"),
        *_explicit(S.CASE),
        *_explicit(S.CONTROL),
    )
    sized = attach_constants(
        per_feature, group_sizes(samples), ["cohort"], size=measured_bytes(samples)
    )
    if expressed_only:
        sized = sized.where(F.col("n_expressed") >= min_samples("n_samples", min_fraction))
    columns = []
    for group in (S.CASE, S.CONTROL):
        zeros = F.lit(0)
        if implicit_zeros:
            zeros = F.col(f"size_{group}") - F.col(f"_rows_{group}")
        parts = (F.col(f"_{name}_{group}") for name in ("n", "mean", "var"))
        n, mean, var = merge_zeros(*parts, zeros)
        columns += [
            n.cast("long").alias(f"n_{group}"),
            mean.alias(f"mean_{group}"),
            var.alias(f"var_{group}"),
        ]
    return sized.select("cohort", "feature_id", *columns).where("n_case > 0 and n_control > 0")


def welch(moments):
    """Welch t, its degrees of freedom and the log2 fold change.

    Features whose squared standard error is 0 or unknown are dropped.
    """
    case = F.try_divide("var_case", "n_case")
    control = F.try_divide("var_control", "n_control")
    tested = moments.withColumn("se2", case + control).where("se2 > 0")
    spread = F.try_divide(case * case, F.col("n_case") - 1) + F.try_divide(
        control * control, F.col("n_control") - 1
    )
    effect = F.col("mean_case") - F.col("mean_control")
    return (
        tested.withColumn("log2fc", effect)
        .withColumn("t_stat", effect / F.sqrt("se2"))
        .withColumn("df", F.try_divide(F.col("se2") * F.col("se2"), spread))
        .drop("se2")
    )


def with_pvalue(tested):
    return tested.withColumn("pvalue", C.t_pvalue("t_stat", "df"))


def bh_fdr(df, pvalue="pvalue", key="feature_id", by=("cohort",)):
    """Benjamini-Hochberg adjusted p-values and the rank of each test, per group.

    ``key`` breaks ties of the rank; the fdr does not depend on it. A null or NaN p-value
    is no test: it has neither rank nor fdr and doesn't count among the tests.
    """
    by = list(by)
    order = ["_order", key]
    tested = F.col(pvalue).isNotNull() & ~F.isnan(pvalue)
    untested = df.where(~tested).select(
        *df.columns, F.lit(None).cast("double").alias("fdr"), F.lit(None).cast("long").alias("rank")
    )
    placed = place(df.where(tested).withColumn("_order", C.stable_p(pvalue)), by, order)
    ranked = rank(placed, by, order, "rank", total="_tests")
    raw = ranked.withColumn("_raw", F.col(pvalue) * F.col("_tests") / F.col("rank"))
    adjusted = min_from_end(raw, by, "rank", "_raw", "_fdr")
    done = adjusted.select(*df.columns, F.least(F.lit(1.0), "_fdr").alias("fdr"), "rank")
    return done.unionByName(untested)
