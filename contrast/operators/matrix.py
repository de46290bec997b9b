"""Cohort union, dense cells, feature vectors and the truncated SVD."""

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from contrast import settings as S
from contrast.functions.columns import fill_slots
from contrast.operators.moments import merge_zeros
from contrast.plans.ordered import place, rank
from contrast.plans.settle import attach_constants, join_side, settle
from contrast.plans.tall import Scaled, truncated_svd

# Samples per block of the sample axis: the bound of every collected array.
BLOCK = 1024


def label_cohort(long, domain, control_only=False):
    """Add ``domain``, ``is_case`` and ``group_label`` to one cohort table.

    Anything but the control group is a case; a control-only cohort has no cases.
    """
    is_case = F.lit(0) if control_only else F.when(F.col("group") == S.CONTROL, 0).otherwise(1)
    state = F.when(F.col("is_case") == 1, "case").otherwise("control")
    return (
        long.withColumn("domain", F.lit(domain) if isinstance(domain, str) else domain)
        .withColumn("is_case", is_case)
        .withColumn("group_label", F.concat_ws("-", "domain", state))
    )


def union_cohorts(frames):
    """Bag union by column name."""
    return reduce(lambda left, right: left.unionByName(right), frames)


def samples_per_group(labelled):
    """Distinct samples per group label."""
    return labelled.groupBy("group_label").agg(F.count_distinct("sample_id").alias("n_samples"))


def sample_positions(long, block=BLOCK):
    """Block and slot of every sample of a cohort, in order of the sample id."""
    samples = long.select("cohort", "sample_id", "group").distinct()
    order = ["sample_id"]
    ranked = rank(place(samples, ["cohort"], order), ["cohort"], order, "_rank", total="n_samples")
    position = F.col("_rank") - 1
    return settle(
        ranked.select(
            "cohort",
            "sample_id",
            "group",
            "n_samples",
            F.floor(position / F.lit(block)).cast("long").alias("block"),
            (position % F.lit(block)).cast("int").alias("slot"),
        ),
        "positions",
    )


def dense_blocks(long, positions, block=BLOCK):
    """Matrix rows by (cohort, feature, sample block), gaps filled with 0.

    Only the cells that exist are shuffled. Each array is bounded by ``block``.
    """
    placed = join_side(
        long.select("cohort", "feature_id", "sample_id", "count"),
        positions.select("cohort", "sample_id", "block", "slot"),
        ["cohort", "sample_id"],
    )
    cells = placed.groupBy("cohort", "feature_id", "block").agg(
        F.sort_array(
            F.collect_list(F.struct("slot", F.col("count").cast("long").alias("value")))
        ).alias("cells")
    )
    sizes = positions.groupBy("cohort").agg(F.max("n_samples").alias("n_samples"))
    last_block = F.floor((F.col("n_samples") - 1) / F.lit(block)).cast("long")
    grid = (
        attach_constants(long.select("cohort", "feature_id").distinct(), sizes, ["cohort"])
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last_block)))
    )
    width = F.least(F.lit(block), F.col("n_samples") - F.col("block") * block).cast("int")
    return grid.join(cells, ["cohort", "feature_id", "block"], "left").select(
        "cohort",
        "feature_id",
        "block",
        fill_slots(F.col("cells"), width, 0, "long").alias("counts"),
    )


def block_samples(positions):
    """Sample ids and groups of each block, in slot order."""
    member = F.struct("slot", "sample_id", "group")
    return settle(
        positions.groupBy("cohort", "block").agg(
            F.sort_array(F.collect_list(member)).alias("members")
        ),
        "blocks",
    )


def densify(long, block=BLOCK):
    """Every (feature, sample) cell of each cohort; cells that are missing count 0.

    The size of the result is features x samples by definition. The analyses do
    not need it: they take missing cells into account through the group sizes.
    """
    positions = sample_positions(long, block)
    rows = join_side(
        dense_blocks(long, positions, block), block_samples(positions), ["cohort", "block"]
    )
    cell = F.explode(F.arrays_zip("members", "counts")).alias("cell")
    return rows.select("cohort", "feature_id", cell).select(
        "cohort",
        F.col("cell.members.group").alias("group"),
        "feature_id",
        F.col("cell.members.sample_id").alias("sample_id"),
        F.col("cell.counts").alias("count"),
    )


def top_variable(cells, n=S.TOP_FEATURES, value="logcpm", n_samples=None):
    """The ``n`` features with the largest sample variance, and their position.

    ``n_samples`` (a column or number) counts missing cells as 0. The result has
    at most ``n`` rows.
    """
    parts = [F.count(value).alias("_n"), F.avg(value).alias("_m"), F.var_samp(value).alias("_v")]
    spread = cells.groupBy("feature_id").agg(*parts)
    variance = F.col("_v")
    if n_samples is not None:
        zeros = F.lit(n_samples) - F.col("_n")
        _, _, variance = merge_zeros(F.col("_n"), F.col("_m"), F.col("_v"), zeros)
    best = (
        spread.select("feature_id", variance.alias("variance"))
        .where("variance is not null")
        .orderBy(F.desc("variance"), "feature_id")
        .limit(n)
    )
    listed = best.agg(
        F.sort_array(
            F.collect_list(F.struct((-F.col("variance")).alias("v"), "feature_id"))
        ).alias("best")
    )
    return settle(
        listed.select(F.posexplode("best").alias("pos", "row")).select(
            F.col("row.feature_id").alias("feature_id"),
            (-F.col("row.v")).alias("variance"),
            "pos",
        ),
        "features",
    )


def wide_vectors(cells, features, n, value="logcpm", samples=None):
    """One dense vector of ``n`` features per sample; gaps are 0.0.

    ``features`` gives each feature its position. It is bounded by ``n``, and so
    is the array collected per sample; no wide pivot takes place. ``samples`` lists
    the samples of a sparse table, as one of them may have none of the features.
    """
    kept = join_side(
        cells.select("sample_id", "feature_id", F.col(value).alias("value")),
        features.select("feature_id", F.col("pos").alias("slot")),
        ["feature_id"],
    )
    rows = kept.groupBy("sample_id").agg(
        F.sort_array(F.collect_list(F.struct("slot", "value"))).alias("cells")
    )
    if samples is not None:
        rows = samples.select("sample_id").join(rows, "sample_id", "left")
    values = fill_slots(F.col("cells"), n, 0.0)
    return rows.select("sample_id", array_to_vector(values).alias("features"))


def pivot_matrix(cells, names, value="count"):
    """Small wide table with one column per name of an explicit list."""
    wide = cells.groupBy("sample_id").pivot("feature_id", list(names)).agg(F.first(value))
    return wide.na.fill(0)


def standardize_long(cells, value="logcpm", by=("feature_id",)):
    """Zero mean and unit sample sd per feature, in long form."""
    by = list(by)
    scale = cells.groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev(value).alias("_s"))
    joined = join_side(cells, settle(scale, "scale"), by)
    scaled = F.try_divide(F.col(value) - F.col("_m"), F.col("_s"))
    return joined.withColumn("z", F.coalesce(scaled, F.lit(0.0))).drop("_m", "_s")


def standardize(vectors):
    """Zero mean and unit sample sd per vector position."""
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    return scaler.fit(vectors).transform(vectors)


def _decompose(vectors, k):
    """Settled rows, their standardisation (mean, scale), singular values and V."""
    arrays = vectors.withColumn("features", vector_to_array("features"))
    rows = settle(arrays, "vectors")
    if rows.isEmpty():
        return rows, np.zeros(0), np.zeros(0), np.zeros(0), np.zeros((0, 0))
    scaler = StandardScaler(inputCol="features", withMean=True, withStd=True)
    fitted = scaler.fit(rows.select(array_to_vector("features").alias("features")))
    mean, deviation = fitted.mean.toArray(), fitted.std.toArray()
    scale = np.where(deviation > 0, 1 / np.where(deviation > 0, deviation, 1), 0.0)
    sigma, right = truncated_svd(Scaled(rows, "features", mean, scale), k)
    return rows, mean, scale, sigma, right


def svd_features(vectors, k=S.SVD_COMPONENTS):
    """Left singular vectors of the standardised matrix, and the singular values.

    The decomposition goes by small R factors of the rows (``plans/tall.py``). Only V
    (features x k) reaches the driver; U is one product per batch of rows, so the sample
    ids never leave their rows. Fewer than ``k`` components come back when the matrix has
    no more. Signs are fixed: a component's largest loading is positive.
    """
    rows, mean, scale, sigma, right = _decompose(vectors, k)
    project = right / sigma

    @F.pandas_udf("array<double>")
    def left(arrays: pd.Series) -> pd.Series:
        if arrays.empty:
            return pd.Series([], dtype=object)
        return pd.Series(list(((np.stack(arrays.to_numpy()) - mean) * scale) @ project))

    others = [name for name in vectors.columns if name != "features"]
    reduced = rows.select(*others, left("features").alias("svd"))
    return reduced, [float(value) for value in sigma]


def svd_loadings(vectors, k=S.SVD_COMPONENTS):
    """Right singular vectors: component, position, loading and singular value."""
    _, _, _, sigma, loadings = _decompose(vectors, k)
    rows = [
        (component, pos, float(loadings[pos, component]), float(value))
        for component, value in enumerate(sigma)
        for pos in range(len(loadings))
    ]
    schema = "component int, pos int, loading double, sigma double"
    return vectors.sparkSession.createDataFrame(rows, schema)


def flatten_components(reduced, k):
    """``svd_0 ... svd_(k-1)`` columns instead of the array; null beyond the last one."""
    others = [name for name in reduced.columns if name != "svd"]
    return reduced.select(*others, *(F.get("svd", F.lit(i)).alias(f"svd_{i}") for i in range(k)))


def projection(reduced, i=0, j=1):
    """Two components of every sample together with its labels."""
    others = [name for name in reduced.columns if name != "svd"]
    return reduced.select(
        *others,
        F.get("svd", F.lit(i)).alias("component_x"),
        F.get("svd", F.lit(j)).alias("component_y"),
    )
