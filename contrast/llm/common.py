"""Small helpers the operators share."""

from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import functions as F
from pyspark.sql import types as T

from contrast.plans.settle import settle

__all__ = ["batches_of", "importable", "read", "settle", "whole_texts"]


def importable(spark):
    """Let Python workers import this package from where the driver has it.

    On a cluster that doesn't have it there, ship it with ``--py-files``.
    """
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{known}".rstrip(":")


@contextmanager
def batches_of(spark, rows):
    """Arrow batches of at most so many rows in what is executed inside.

    The buffers of a batch lie beside the heap, once in the executor and once in its worker.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= rows:
        spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def read(spark, sf_dir, table):
    """A table of the data folder, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole_texts(docs, *more):
    """``doc_id``, ``text`` (null: empty) and the columns of ``docs`` named in ``more``.

    Every other column is left behind here, so no extra column can clash with a
    name that an operator uses inside.
    """
    return docs.select(
        F.col("doc_id").cast(T.LongType()).alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *more,
    )
