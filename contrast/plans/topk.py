"""Top-k rows of each group."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contrast.plans.ordered import BUCKET, place, rank


def top_k(df, k, order, by=("cohort",)):
    """The first ``k`` rows per group; ``order`` must break all ties.

    Spark limits every group inside each task before the shuffle, so a hot group
    never reaches one task whole. It does so up to
    spark.sql.optimizer.windowGroupLimitThreshold; a larger ``k`` goes by distributed
    ranks. Without groups this is a plain sort with limit.
    """
    if not by:
        return df.orderBy(*order).limit(k)
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if k > limit:
        ranked = rank(place(df, list(by), list(order)), list(by), list(order), "_k")
        return ranked.where(F.col("_k") <= k).drop("_k", BUCKET)
    position = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn("_k", position).where(F.col("_k") <= k).drop("_k")
