"""Differential analysis of two groups, for any number of cohorts in one job."""

from pyspark.sql import functions as F

from contrast import settings as S
from contrast.functions import columns as C
from contrast.operators.moments import bh_fdr, feature_moments, welch, with_pvalue
from contrast.plans.settle import settle
from contrast.plans.topk import top_k

RESULT = [
    "cohort",
    "feature_id",
    "log2fc",
    "t_stat",
    "df",
    "pvalue",
    "fdr",
    "mean_case",
    "mean_control",
    "n_case",
    "n_control",
    "rank",
]


def diff_core(long, implicit_zeros=False, samples=None):
    """Normalise, filter and test, without p-values."""
    return welch(feature_moments(long, implicit_zeros, samples=samples))


def diff_analysis(
    long, implicit_zeros=False, min_cpm=S.MIN_CPM, min_fraction=S.MIN_FRACTION, samples=None
):
    """log-CPM, expression filter, Welch test, p-value and FDR per cohort."""
    moments = feature_moments(long, implicit_zeros, min_cpm, min_fraction, samples)
    # Settled, as the ranks take the tested rows and the result also the others.
    return bh_fdr(settle(with_pvalue(welch(moments)), "tests")).select(*RESULT)


def de_summary(de, max_fdr=S.MAX_FDR, min_effect=S.MIN_EFFECT):
    """Per cohort: features tested, significant, and strongly up or down."""
    side = C.volcano_side("log2fc", "fdr", max_fdr, min_effect)
    return de.groupBy("cohort").agg(
        F.count("*").alias("n_tested"),
        F.count_if(F.col("fdr") < F.lit(max_fdr)).alias("n_significant"),
        F.count_if(side == "up").alias("n_up"),
        F.count_if(side == "down").alias("n_down"),
    )


def top_by_pvalue(de, k=20):
    return top_k(de, k, ["rank"])


def strongest_up(de, k=10, max_fdr=S.MAX_FDR):
    """Largest effects among the significant features, whatever their sign."""
    return top_k(de.where(F.col("fdr") < max_fdr), k, [C.stable("log2fc").desc(), "feature_id"])


def strongest_down(de, k=10, max_fdr=S.MAX_FDR):
    """Smallest effects among the significant features, whatever their sign."""
    return top_k(de.where(F.col("fdr") < max_fdr), k, [C.stable("log2fc"), "feature_id"])
