"""Per-sample normalisation of the long table.

The long table has one row per cell: ``cohort, group, feature_id, sample_id,
count``. A sample belongs to one cohort and a (feature, sample) pair occurs once.

It may be packed: one or more rows per sample and group, with ``cells`` (an array of
``feature_id, count``, never empty) in place of the cell's two columns. What is joined by
sample then meets some rows a sample and not its cells.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contrast import settings as S
from contrast.functions import columns as C
from contrast.plans.settle import attach_constants, join_side, measured_bytes, settle

SAMPLE = ["cohort", "sample_id"]


def unpacked(long):
    """One row per cell, also of a packed table."""
    if "cells" not in long.columns:
        return long
    rest = [name for name in long.columns if name != "cells"]
    return long.select(*rest, F.explode("cells").alias("_cell")).select(
        *rest, F.col("_cell.feature_id").alias("feature_id"), F.col("_cell.count").alias("count")
    )


def sample_table(long, *extra):
    """One settled row per sample and group with its total count and cells: the
    only full pass the later steps share. ``extra`` names further sample columns."""
    totals = unpacked(long).groupBy(*SAMPLE, "group", *extra).agg(
        F.sum("count").alias("total"), F.count("*").alias("n_cells")
    )
    return settle(totals, "samples")


def library_size(long=None, samples=None):
    """Total count of every sample, summed before any feature is dropped."""
    if samples is None:
        return unpacked(long).groupBy(*SAMPLE).agg(F.sum("count").alias("lib_size"))
    return samples.groupBy(*SAMPLE).agg(F.sum("total").alias("lib_size"))


def group_sizes(samples):
    """Per cohort: distinct samples, and samples with a usable library per group.

    A row is no longer than that of a sample, so the size of ``samples`` bounds the result's.
    """
    usable = F.sum("total").over(W.partitionBy(*SAMPLE)) > 0
    flagged = samples.withColumn("_usable", F.coalesce(usable, F.lit(False)))
    return flagged.groupBy("cohort").agg(
        F.count_distinct("sample_id").alias("n_samples"),
        F.count_if(F.col("_usable") & (F.col("group") == S.CASE)).alias("size_case"),
        F.count_if(F.col("_usable") & (F.col("group") == S.CONTROL)).alias("size_control"),
        F.count_if("_usable").alias("size_all"),
    )


def with_library(long, samples=None, broadcast_limit=None):
    """Add ``lib_size`` to every row of the long table, packed or not.

    The library sizes are one row per sample. They are broadcast if their measured
    size allows it, which leaves the long table unshuffled.
    """
    samples = sample_table(long) if samples is None else samples
    library = library_size(samples=samples)
    # The settled samples are measured, not the aggregate over them, which would run twice.
    size = measured_bytes(samples)
    return join_side(long, library, SAMPLE, limit=broadcast_limit, size=size)


def logged(sized):
    """Add ``cpm`` and ``logcpm`` to every cell of a table that has the library sizes."""
    cells = unpacked(sized).withColumn("cpm", C.cpm("count", "lib_size"))
    return cells.withColumn("logcpm", C.log_cpm("cpm"))


def log_cpm(long, samples=None, broadcast_limit=None):
    """Add ``lib_size``, ``cpm`` and ``logcpm`` to every cell."""
    return logged(with_library(long, samples, broadcast_limit))


def min_samples(n_samples, min_fraction=S.MIN_FRACTION):
    """Samples that must express a feature; ties of the rounding go to even."""
    return F.bround(F.lit(min_fraction) * F.col(n_samples)).cast("long")


def expressed_features(long, min_cpm=S.MIN_CPM, min_fraction=S.MIN_FRACTION):
    """Features with ``cpm > min_cpm`` in enough samples of their cohort."""
    samples = sample_table(long)
    sizes = group_sizes(samples).select("cohort", "n_samples")
    counts = (
        log_cpm(long, samples)
        .groupBy("cohort", "feature_id")
        .agg(F.count_if(F.col("cpm") > F.lit(min_cpm)).alias("n_expressed"))
    )
    return (
        attach_constants(counts, sizes, ["cohort"], size=measured_bytes(samples))
        .withColumn("min_samples", min_samples("n_samples", min_fraction))
        .where("n_expressed >= min_samples")
        .select("cohort", "feature_id", "n_expressed", "min_samples")
    )


def collapse_versions(cells, value="logcpm", implicit_zeros=False):
    """Strip the version of every feature id and average the ids that then collide.

    Only ids that share a stripped form are grouped. All other cells pass straight
    through, so the table as a whole is not shuffled. With ``implicit_zeros`` an id
    without a cell enters the average as 0.
    """
    labels = [name for name in cells.columns if name not in ("feature_id", value)]
    bases = cells.select("feature_id").distinct().withColumn("_base", C.strip_version("feature_id"))
    bases = settle(bases, "bases")
    sharing = bases.groupBy("_base").agg(F.count("*").alias("_ids"))
    named = settle(bases.join(sharing, "_base"), "named")
    mean = F.try_divide(F.sum(value), F.col("_ids")) if implicit_zeros else F.avg(value)
    columns = [F.col("_base").alias("feature_id"), *labels, value]
    single = join_side(cells, named.where("_ids = 1").drop("_ids"), ["feature_id"])
    merged = (
        join_side(cells, named.where("_ids > 1"), ["feature_id"])
        .groupBy("_base", "_ids", *labels)
        .agg(mean.alias(value))
    )
    return single.select(*columns).unionByName(merged.select(*columns))
