"""Effect against baseline: composite score, classes, picks and recurrence."""

from pyspark.sql import functions as F

from contrast import settings as S
from contrast.functions import columns as C
from contrast.operators.moments import merge_zeros
from contrast.operators.normalize import group_sizes, logged, sample_table, with_library
from contrast.plans.ordered import BUCKET, group_quantile, group_rank, place, rank
from contrast.plans.settle import attach_constants, measured_bytes, settle
from contrast.plans.topk import top_k

FEATURE = ["cohort", "feature_id"]
SCORE = [
    *FEATURE,
    "symbol",
    "log2fc",
    "fdr",
    "baseline_mean_logcpm",
    "baseline_median_logcpm",
    "z_effect",
    "z_baseline",
    "target_score",
]


def baseline_profile(long, implicit_zeros=False, samples=None):
    """Mean and exact median of log-CPM per feature; no expression filter.

    The median is the least value that at least half of the values don't exceed. With
    ``implicit_zeros`` the samples without a cell count as one value 0 of that weight: they
    only shift the rank to look for, and most features are settled by their counts alone.
    No zero row is made. ``samples`` is the settled sample table of ``long``, if there is one.
    """
    samples = sample_table(long) if samples is None else samples
    # Settled, as three passes read it and the join with the libraries is the dear part.
    held = ["cells"] if "cells" in long.columns else ["feature_id", "count"]
    known = with_library(long, samples).where("lib_size > 0").select("cohort", *held, "lib_size")
    cells = logged(settle(known, "cells")).select(*FEATURE, "logcpm")
    summary = cells.groupBy(*FEATURE).agg(
        F.count("*").alias("_rows"),
        F.count("logcpm").alias("_n"),
        F.avg("logcpm").alias("_mean"),
        F.count_if(F.col("logcpm") < 0).alias("_below"),
        F.count_if(F.col("logcpm") == 0).alias("_nil"),
    )
    zeros = F.lit(0).cast("long")
    if implicit_zeros:
        sizes = group_sizes(samples).select("cohort", "size_all")
        summary = attach_constants(summary, sizes, ["cohort"], size=measured_bytes(samples))
        zeros = F.col("size_all") - F.col("_rows")
    middle = F.ceil((F.col("_n") + F.col("_zeros")) / 2)
    nil = F.col("_nil") + F.col("_zeros")
    position = (
        F.when(middle <= F.col("_below"), middle)
        .when(middle <= F.col("_below") + nil, F.lit(None))
        .otherwise(middle - F.col("_zeros"))
    )
    sized = settle(summary.withColumn("_zeros", zeros).withColumn("_rank", position), "profile")
    # Few features need one: their own size is measured and not that of the profile.
    wanted = settle(sized.where("_rank > 0").select(*FEATURE, "_rank"), "wanted")
    medians = group_rank(cells, FEATURE, "logcpm", wanted, "_median", 2 * measured_bytes(wanted))
    _, mean, _ = merge_zeros(F.col("_n"), F.col("_mean"), F.lit(0.0), F.col("_zeros"))
    some = F.col("_n") + F.col("_zeros") > 0
    return sized.join(medians, FEATURE, "left").select(
        *FEATURE,
        mean.alias("baseline_mean_logcpm"),
        F.when(some, F.coalesce("_median", F.lit(0.0))).alias("baseline_median_logcpm"),
    )


def effect_baseline_join(de, baseline):
    """Tested features that the baseline cohort also has."""
    return de.join(baseline, FEATURE)


def attach_symbol(df, symbols):
    """Left join of the symbol map; an unmapped feature keeps its id as symbol."""
    named = df.join(symbols.select("feature_id", "symbol"), "feature_id", "left")
    return named.withColumn("symbol", C.symbol_or_id("symbol", "feature_id"))


def zscore(df, columns, by=("cohort",), size=None):
    """Add ``out = (value - mean) / sample sd`` per group; ``columns`` maps value to out.

    ``size`` is an upper bound of the size of the means and deviations, if one is known.
    """
    by = list(by)
    parts = []
    for value in columns:
        parts += [F.avg(value).alias(f"_m_{value}"), F.stddev(value).alias(f"_s_{value}")]
    joined = attach_constants(df, df.groupBy(*by).agg(*parts), by, size=size)
    for value, out in columns.items():
        scaled = F.try_divide(F.col(value) - F.col(f"_m_{value}"), F.col(f"_s_{value}"))
        joined = joined.withColumn(out, scaled)
    return joined.drop(*(f"_{kind}_{value}" for value in columns for kind in "ms"))


def target_score(de, baseline, symbols, safe_quantile=None):
    """High effect and low baseline: ``z(effect) - z(baseline)`` per cohort.

    With ``safe_quantile`` every row also carries this quantile of its cohort's baseline as
    ``safe_max``, which ``quadrant`` and ``verdict`` then use; nothing more is written for it
    than the distinct values to rank.
    """
    effects = de.select(*FEATURE, "log2fc", "fdr")
    # Settled, as the z constants and the scored rows both read it.
    joined = settle(effect_baseline_join(effects, baseline), "effects")
    # A cohort has a row of its own here, no shorter than that of its constants.
    size = measured_bytes(joined)
    scored = zscore(joined, {"log2fc": "z_effect", "baseline_mean_logcpm": "z_baseline"}, size=size)
    scored = scored.withColumn("target_score", F.col("z_effect") - F.col("z_baseline"))
    if safe_quantile is None:
        return attach_symbol(scored, symbols).select(*SCORE)
    limits = safe_threshold(joined, safe_quantile)
    limited = attach_constants(scored, limits, ["cohort"], size=size)
    return attach_symbol(limited, symbols).select(*SCORE, "safe_max")


def volcano_points(de, symbols):
    """The table behind a volcano plot."""
    return attach_symbol(de, symbols).select(
        *FEATURE,
        "symbol",
        "log2fc",
        "fdr",
        C.neglog10("pvalue").alias("neglog10p"),
        C.volcano_side("log2fc", "fdr").alias("side"),
    )


def volcano_labels(points, k=8, extremes=4):
    """Points to label: per side the strongest overall and the most extreme effects."""
    sided = points.where("side <> 'none'").withColumn(
        "label_score", F.col("neglog10p") * F.abs("log2fc")
    )
    by = ["cohort", "side"]
    strongest = top_k(sided, k, [C.stable("label_score", 3).desc(), "feature_id"], by)
    extreme = top_k(sided, extremes, [C.stable(F.abs("log2fc")).desc(), "feature_id"], by)
    return strongest.unionByName(extreme).dropDuplicates(FEATURE)


def safe_threshold(scores, q=S.SAFE_QUANTILE):
    """Exact baseline quantile over all scored features of each cohort."""
    return group_quantile(scores, ["cohort"], "baseline_mean_logcpm", q, "safe_max")


def _limited(scores, q=S.SAFE_QUANTILE):
    """Scores with their cohort's threshold, unless they carry it already."""
    if "safe_max" in scores.columns:
        return scores
    return attach_constants(scores, safe_threshold(scores, q), ["cohort"])


def quadrant(scores, q=S.SAFE_QUANTILE):
    """Zone of every scored feature by effect and baseline threshold.

    ``q`` is for scores that don't carry a ``safe_max`` from ``target_score``.
    """
    zone = C.quadrant("log2fc", "fdr", "baseline_mean_logcpm", "safe_max")
    return _limited(scores, q).withColumn("zone", zone)


def quadrant_labels(zoned, good=12, danger=6):
    """Good features with the largest effect and danger features with the highest baseline."""
    best = top_k(
        zoned.where("zone = 'good'"), good, [C.stable("log2fc").desc(), "feature_id"]
    )
    worst = top_k(
        zoned.where("zone = 'danger'"),
        danger,
        [C.stable("baseline_mean_logcpm").desc(), "feature_id"],
    )
    return best.unionByName(worst)


def verdict(scores, safe_max=None):
    """Add the verdict; without ``safe_max`` the limit is the cohort's own quantile."""
    if safe_max is None:
        scores, safe_max = _limited(scores), "safe_max"
    call = C.verdict("log2fc", "fdr", "baseline_mean_logcpm", safe_max)
    return scores.withColumn("verdict", call).drop("safe_max")


def top_candidates(scores, k=20, max_fdr=S.MAX_FDR):
    return top_k(
        scores.where(F.col("fdr") < max_fdr), k, [C.stable("target_score").desc(), "feature_id"]
    )


def top_danger(scores, k=10, max_fdr=S.MAX_FDR, min_effect=S.MIN_EFFECT):
    up = scores.where((F.col("fdr") < max_fdr) & (F.col("log2fc") > min_effect))
    return top_k(up, k, [C.stable("baseline_mean_logcpm").desc(), "feature_id"])


def recurrence(judged, min_cohorts=5):
    """Features that are candidates in at least ``min_cohorts`` cohorts, ranked.

    Rank 1 has the most cohorts, then the highest mean score, then the least id. The
    rank is taken over a distributed sort.
    """
    recurring = (
        judged.where("verdict = 'candidate'")
        .groupBy("feature_id", "symbol")
        .agg(
            F.count_distinct("cohort").alias("n_cohorts"),
            F.avg("target_score").alias("mean_score"),
            F.avg("log2fc").alias("mean_log2fc"),
        )
        .where(F.col("n_cohorts") >= min_cohorts)
        .withColumn("_score", C.stable("mean_score"))
    )
    order = [F.desc("n_cohorts"), F.desc("_score"), "feature_id", "symbol"]
    return rank(place(recurring, [], order), [], order).drop("_score", BUCKET)
