"""Exact order statistics over a distributed sort.

A global (or per-group) rank as one window would put all rows of a group into
one task. Here the rows are range-partitioned on ``by + order``, each range is a
bucket, and a small table with one row per (group, bucket) carries the totals of
the buckets before or after. A hot group simply spans more buckets.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contrast.plans.settle import join_side, settle

BUCKET = "_bucket"
# Rows of a range at most, on average; a task sorts some ten megabytes of them.
ROWS = 1 << 17
# Steps of a histogram per doubling of (1 + value).
STEPS = 64


def place(df, by, order):
    """Add the range bucket of every row and settle, so that all passes agree.

    There are ``spark.sql.shuffle.partitions`` ranges, more if they would hold over ``ROWS``
    rows. The rows are settled before they are counted, and then sampled for the ranges.
    """
    df = settle(df, "rows")
    ranges = -(-df.count() // ROWS)
    if ranges <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        ranges = None
    ranged = df.repartitionByRange(*([ranges] if ranges else []), *by, *order)
    placed = settle(ranged.withColumn(BUCKET, F.spark_partition_id()), "ordered")
    placed._ranges = ranges
    return placed


def _dealt(placed, by):
    """The ranges dealt over as many tasks as there are, if that is more than usual."""
    ranges = getattr(placed, "_ranges", None)
    return placed.repartition(ranges, *by, BUCKET) if ranges else placed


def _bucket_window(by, descending=False):
    bucket = F.col(BUCKET).desc() if descending else F.col(BUCKET).asc()
    return W.partitionBy(*by).orderBy(bucket)


def _row_window(by, order):
    return W.partitionBy(*by, BUCKET).orderBy(*order)


def running_sum(placed, by, order, value, out, total=None):
    """Running sum of a count column in sort order, and optionally its total.

    ``order`` must identify a row within its group.
    """
    summary = placed.groupBy(*by, BUCKET).agg(F.sum(value).alias("_own"))
    before = _bucket_window(by).rowsBetween(W.unboundedPreceding, -1)
    offsets = summary.withColumn("_before", F.coalesce(F.sum("_own").over(before), F.lit(0)))
    if total:
        offsets = offsets.withColumn(total, F.sum("_own").over(W.partitionBy(*by)))
    within = _row_window(by, order).rowsBetween(W.unboundedPreceding, 0)
    # The window comes first, as its order also serves the join.
    return (
        _dealt(placed, by)
        .withColumn("_within", F.sum(value).over(within))
        .join(offsets.drop("_own"), [*by, BUCKET])
        .withColumn(out, F.col("_before") + F.col("_within"))
        .drop("_before", "_within")
    )


def rank(placed, by, order, out="rank", total=None):
    """1-based row number within each group."""
    return running_sum(placed, by, order, F.lit(1).cast("long"), out, total)


def min_from_end(ranked, by, position, value, out):
    """Minimum of ``value`` over the row and all rows after it by ``position``."""
    lows = ranked.groupBy(*by, BUCKET).agg(F.min(value).alias("_low"))
    after = _bucket_window(by, descending=True).rowsBetween(W.unboundedPreceding, -1)
    later = lows.withColumn("_later", F.min("_low").over(after)).drop("_low")
    within = _row_window(by, [F.col(position).desc()]).rowsBetween(W.unboundedPreceding, 0)
    return (
        ranked.withColumn("_within", F.min(value).over(within))
        .join(later, [*by, BUCKET])
        .withColumn(out, F.least("_within", "_later"))
        .drop("_later", "_within")
    )


def group_quantile(df, by, value, q, out):
    """Exact linearly interpolated quantile of ``value`` per group."""
    kept = df.select(*by, F.col(value).cast("double").alias("_v")).where("_v is not null")
    # Equal values collapse to one row before the sort, so ties cannot pile up.
    counted = kept.groupBy(*by, "_v").agg(F.count("*").alias("_n"))
    placed = place(counted, by, ["_v"])
    upto = running_sum(placed, by, ["_v"], F.col("_n"), "_upto", total="_total")
    position = (F.col("_total") - 1) * F.lit(q)
    low, high = F.floor(position), F.ceil(position)
    holds = [
        (F.col("_upto") > at) & (F.col("_upto") - F.col("_n") <= at) for at in (low, high)
    ]
    ends = (
        upto.where(holds[0] | holds[1])
        .groupBy(*by)
        .agg(
            F.max(F.when(holds[0], F.col("_v"))).alias("_low"),
            F.max(F.when(holds[1], F.col("_v"))).alias("_high"),
            F.max(position - low).alias("_part"),
        )
    )
    return ends.select(
        *by, (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")).alias(out)
    )


def _step(value):
    """A whole number that never falls as the value grows; some 131,000 of them at most."""
    size = F.floor(F.log2(F.abs(value) + 1) * STEPS)
    return F.when(value < 0, -size).otherwise(size)


def group_rank(df, by, value, ranks, out, size=None):
    """The value of a rank (1-based, ascending) in every group that ``ranks`` lists.

    Exact, and independent of how the rows are partitioned. ``ranks`` is settled and has
    ``by`` and ``_rank``. A histogram of each group shows the step that holds the rank;
    only the rows of this one step are sorted. Null and NaN values don't count; a group
    with fewer values than its rank is left out. ``size`` is an upper bound of the size of
    ``ranks`` with one more number a row, if one is known.
    """
    by = list(by)
    known = df.select(*by, (F.col(value).cast("double") + F.lit(0.0)).alias("_v"))
    known = known.where("_v is not null and not isnan(_v)").withColumn("_step", _step(F.col("_v")))
    tally = join_side(known, ranks, by, size=size).groupBy(*by, "_step", "_rank").agg(F.count("*").alias("_n"))
    # Some hundred rows a group, as a histogram has that many steps.
    order = W.partitionBy(*by).orderBy("_step").rowsBetween(W.unboundedPreceding, 0)
    upto = tally.withColumn("_upto", F.sum("_n").over(order))
    below = F.col("_upto") - F.col("_n")
    held = upto.where((below < F.col("_rank")) & (F.col("_rank") <= F.col("_upto")))
    steps = settle(held.select(*by, "_step", (F.col("_rank") - below).alias("_rest")), "steps")
    inside = join_side(known, steps, [*by, "_step"], size=size).groupBy(*by, "_v", "_rest").agg(F.count("*").alias("_n"))
    sums = running_sum(place(inside, by, ["_v"]), by, ["_v"], F.col("_n"), "_upto")
    first = (F.col("_upto") >= F.col("_rest")) & (F.col("_upto") - F.col("_n") < F.col("_rest"))
    return sums.where(first).select(*by, F.col("_v").alias(out))
