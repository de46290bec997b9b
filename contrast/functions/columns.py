"""Column expressions: small, lazy, evaluated in the JVM."""

from pyspark.sql import functions as F

from contrast import settings as S


def cpm(count, lib_size):
    """Counts per million; a zero library gives NULL."""
    return F.try_divide(F.col(count), F.col(lib_size)) * F.lit(S.CPM_SCALE)


def log_cpm(cpm_column):
    return F.log2(F.col(cpm_column) + F.lit(1.0))


def t_pvalue(t, df):
    """Two-sided Student-t p-value through the incomplete beta function of the JVM."""
    t, df = F.col(t), F.col(df)
    return F.reflect(
        F.lit("org.apache.commons.math3.special.Beta"),
        F.lit("regularizedBeta"),
        df / (df + t * t),
        df / F.lit(2.0),
        F.lit(0.5),
    ).cast("double")


def strip_version(feature):
    return F.regexp_replace(F.col(feature), S.VERSION_PATTERN, "")


def stable_bucket(key, buckets=S.FEATURE_BUCKETS):
    """Bucket of a key that any engine with md5 can reproduce."""
    head = F.conv(F.substring(F.md5(F.col(key)), 1, 8), 16, 10).cast("long")
    return F.pmod(head, F.lit(buckets)).cast("int")


def layout_bucket(key, buckets=S.FEATURE_BUCKETS):
    """Cheaper bucket for physical layout only."""
    return F.pmod(F.hash(F.col(key)), F.lit(buckets))


def symbol_or_id(symbol, feature):
    return F.coalesce(F.col(symbol), F.col(feature))


def _significant(fdr, max_fdr):
    """True only for a real fdr under the limit: NULL and NaN are not significant."""
    column = F.col(fdr)
    return F.coalesce(~F.isnan(column) & (column < F.lit(max_fdr)), F.lit(False))


def stable(value, digits=9):
    """Sort key of a computed value.

    Equal values can differ in their last bits with the order in which partial sums
    are merged. Rounding them away leaves such ties to the next sort key, so a rank
    does not change when tasks run again.
    """
    return F.round(value if not isinstance(value, str) else F.col(value), digits)


def stable_p(p, digits=9):
    """Sort key of a p-value, to a relative precision."""
    return F.round(F.ln(F.greatest(F.col(p), F.lit(S.P_FLOOR))), digits)


def neglog10(p):
    """-log10 with a floor at the smallest positive double."""
    return -F.log10(F.greatest(F.col(p), F.lit(S.P_FLOOR)))


def volcano_side(effect, fdr, max_fdr=S.MAX_FDR, min_effect=S.MIN_EFFECT):
    """``up``, ``down`` or ``none``; an effect exactly at the limit counts."""
    hit = _significant(fdr, max_fdr) & (F.abs(F.col(effect)) >= F.lit(min_effect))
    return (
        F.when(hit & (F.col(effect) > 0), "up")
        .when(hit & (F.col(effect) < 0), "down")
        .otherwise("none")
    )


def _three_way(effect, fdr, baseline, safe_max, names, max_fdr, min_effect):
    up = _significant(fdr, max_fdr) & (F.col(effect) > F.lit(min_effect))
    up = F.coalesce(up & ~F.isnan(F.col(effect)), F.lit(False))
    safe, risky, other = names
    return F.when(~up, other).when(F.col(baseline) <= safe_max, safe).otherwise(risky)


def quadrant(effect, fdr, baseline, threshold, max_fdr=S.MAX_FDR, min_effect=S.MIN_EFFECT):
    """``good``, ``danger`` or ``background``; a baseline at the threshold is good."""
    names = ("good", "danger", "background")
    return _three_way(effect, fdr, baseline, F.col(threshold), names, max_fdr, min_effect)


def verdict(effect, fdr, baseline, safe_max, max_fdr=S.MAX_FDR, min_effect=S.MIN_EFFECT):
    """``candidate``, ``danger`` or ``not_significant``; ``safe_max`` is a column or a number."""
    limit = F.col(safe_max) if isinstance(safe_max, str) else F.lit(float(safe_max))
    names = ("candidate", "danger", "not_significant")
    return _three_way(effect, fdr, baseline, limit, names, max_fdr, min_effect)


def fill_slots(cells, size, empty, value_type="double"):
    """Dense array of ``size`` values from slot-sorted ``array<struct<slot, value>>``.

    Missing slots hold ``empty``. Linear in the size: each cell contributes the
    gap before it and its own value.
    """
    none = F.array().cast(f"array<struct<slot:int,value:{value_type}>>")
    cells = F.coalesce(cells, none)
    empty = F.lit(empty).cast(value_type)
    last = F.coalesce(F.get(cells, F.size(cells) - 1)["slot"], F.lit(-1))

    def gap_and_value(cell, index):
        previous = F.coalesce(F.get(cells, index - 1)["slot"], F.lit(-1))
        gap = F.array_repeat(empty, cell["slot"] - previous - 1)
        return F.concat(gap, F.array(cell["value"]))

    return F.concat(
        F.flatten(F.transform(cells, gap_and_value)),
        F.array_repeat(empty, F.lit(size) - F.lit(1) - last),
    )
