"""Subsampling by sample, the scaling table and its linear fit."""

from pyspark.sql import functions as F

from contrast import settings as S
from contrast.operators.diff import diff_core
from contrast.operators.normalize import sample_table
from contrast.plans.ordered import BUCKET, rank
from contrast.plans.settle import join_side, measured_bytes, settle

# Hexadecimal digits that name a range of draws: 4,096 ranges a cohort.
DIGITS = 3


def sample_ranks(long, seed=S.SEED):
    """Every sample of a cohort with its place in a seeded random order.

    The hash that draws a sample is uniform, so its first digits are ranges of even size
    in the order of the draw: the counts of these ranges and a rank within each give the
    place, without a sort across ranges.
    """
    samples = long.select("cohort", "sample_id").distinct()
    salted = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("sample_id")))
    drawn = samples.withColumn("_draw", salted).withColumn(BUCKET, F.substring("_draw", 1, DIGITS))
    ranked = rank(drawn, ["cohort"], ["_draw", "sample_id"], "_rank", total="_total")
    return settle(ranked.select("cohort", "sample_id", "_rank", "_total"), "draws")


def _quota(fraction):
    """Samples to keep: the rounded share, ties to even, but at least two."""
    share = F.bround(F.lit(float(fraction)) * F.col("_total")).cast("long")
    return F.greatest(F.lit(2).cast("long"), share)


def subsample_samples(long, fraction, seed=S.SEED):
    """All cells of a random share of the samples of each cohort."""
    draws = sample_ranks(long, seed)
    chosen = draws.where(F.col("_rank") <= _quota(fraction)).select("cohort", "sample_id")
    return join_side(
        long, chosen, ["cohort", "sample_id"], "left_semi", size=measured_bytes(draws)
    )


def subsample_nested(long, fractions=S.SCALING_FRACTIONS, seed=S.SEED):
    """The subsamples of all fractions in one pass, told apart by ``fraction``."""
    draws = sample_ranks(long, seed)
    # One row per sample and fraction whose quota covers the rank of the sample.
    member = [
        F.when(F.col("_rank") <= _quota(fraction), F.lit(float(fraction))) for fraction in fractions
    ]
    members = draws.select(
        "cohort", "sample_id", F.explode(F.array_compact(F.array(*member))).alias("fraction")
    )
    bound = len(member) * measured_bytes(draws)
    return join_side(long, members, ["cohort", "sample_id"], size=bound)


def subsample_diff(long, fractions=S.SCALING_FRACTIONS, seed=S.SEED, implicit_zeros=False):
    """Per fraction: samples, rows and features tested by the core workload.

    Each fraction takes the part of a cohort in one run of the workload, so the
    cells are multiplied on their way into the aggregation but never written.
    """
    name = F.format_string("%s@%s", "cohort", F.col("fraction").cast("string"))
    nested = subsample_nested(long, fractions, seed)
    named = nested.withColumn("origin", F.col("cohort")).withColumn("cohort", name)
    samples = sample_table(named, "origin", "fraction")
    sizes = samples.groupBy("cohort", "origin", "fraction").agg(
        F.count_distinct("sample_id").alias("n_samples"), F.sum("n_cells").alias("n_rows")
    )
    tested = diff_core(named, implicit_zeros, samples).groupBy("cohort")
    joined = sizes.join(tested.agg(F.count("*").alias("n_features_tested")), "cohort", "left")
    return joined.select(
        F.col("origin").alias("cohort"),
        "fraction",
        "n_samples",
        "n_rows",
        F.coalesce("n_features_tested", F.lit(0).cast("long")).alias("n_features_tested"),
    )


def scaling_fit(points, corpus_rows=S.CORPUS_ROWS):
    """Seconds per million rows and the extrapolation to a corpus.

    The line is fitted from the second smallest size upward, where the fixed
    start-up cost no longer dominates. ``points`` has ``n_rows`` and ``seconds``.
    """
    second = points.orderBy("n_rows").limit(2).agg(F.max("n_rows"))
    millions = F.col("n_rows") / F.lit(1e6)
    line = points.where(F.col("n_rows") >= second.scalar()).agg(
        F.regr_slope("seconds", millions).alias("sec_per_million_rows"),
        F.regr_intercept("seconds", millions).alias("fixed_seconds"),
        F.count("*").alias("n_points"),
    )
    corpus = F.col("sec_per_million_rows") * F.lit(corpus_rows / 1e6) + F.col("fixed_seconds")
    return line.withColumn("corpus_hours", corpus / F.lit(3600.0))
