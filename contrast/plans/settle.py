"""Written intermediate tables and joins against sides of a checked size."""

import re
import tempfile
import threading
from functools import reduce
from uuid import uuid4

from pyspark.sql import functions as F
from pyspark.sql import types as T

# A side is broadcast only while its measured size stays under this many bytes. Its hash
# table takes about twice that in the driver, beside the blocks that are sent.
BROADCAST_LIMIT = 64 * 1024 * 1024
# Beyond it, the rows of one key are spread over this many salts.
SALTS = 16


# Paths written by the innermost ``tidied`` of this thread.
_open = threading.local()


def shared_dir(spark):
    """The shared scratch folder of the session (``spark.checkpoint.dir``)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    local = tempfile.mkdtemp(prefix="contrast-")
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def scratch_path(spark, label):
    """A new path under the shared folder."""
    path = f"{shared_dir(spark)}/contrast-{label}-{uuid4().hex}"
    if getattr(_open, "paths", None) is not None:
        _open.paths.append(path)
    return path


def delete_path(spark, path):
    """Delete a file or folder through Spark's own file systems."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def tidied(spark, build, label="table"):
    """Settle the table that ``build()`` returns and delete all others written for it.

    Nothing that outlives the call may read what ``build`` wrote, except for its result.
    """
    outer, _open.paths = getattr(_open, "paths", None), []
    try:
        result = settle(build(), label)
        *used, kept = _open.paths
    finally:
        _open.paths = outer
    if outer is not None:
        outer.append(kept)
    for path in used:
        delete_path(spark, path)
    # The shuffles behind them go when the driver collects its garbage, which may be late.
    spark._jvm.System.gc()
    return result


def settle(df, label="table", **options):
    """Write ``df`` once and go on from the written table.

    Cuts the lineage in a way that survives lost executors, freezes values that
    depend on task placement, and keeps later passes from recomputing the plan.
    ``options`` are those of the Parquet writer.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _width(field):
    kind = field.dataType
    if isinstance(kind, T.StringType):
        return F.coalesce(F.octet_length(field.name), F.lit(0)) + 24
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.NumericType, T.BooleanType)):
        return F.coalesce(F.size(field.name), F.lit(0)) * 16 + 64
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(field.name))), F.lit(0)) * 2 + 64
    return F.lit(16)


def measured_bytes(df):
    """Upper estimate of the in-memory size of a settled table; measured once.

    An observation of the write would spare the pass, but a session that has observed
    anything can no longer be serialised with the models of MLlib.
    """
    if getattr(df, "_measured", None) is None:
        width = sum((_width(field) for field in df.schema.fields), F.lit(32))
        df._measured = df.agg(F.sum(width.cast("long")).alias("bytes")).first()["bytes"] or 0
    return df._measured


def join_side(big, side, on, how="inner", limit=None, size=None):
    """Equi-join a cell-sized table with a settled side.

    The side is broadcast if its measured size is within ``limit``, so the big
    table is not shuffled. Otherwise both are shuffled on the key and a salt, so
    the rows of one hot key are spread over several tasks. Both ways give the
    same rows. ``size`` is an upper bound of the side's size, if one is known.

    The salted copies are hinted to a merge join: Spark takes the compressed files of the
    side for its size and would broadcast all copies.
    """
    limit = BROADCAST_LIMIT if limit is None else limit
    if (measured_bytes(side) if size is None else size) <= limit:
        return big.join(F.broadcast(side), on, how)
    salt = "_salt"
    rest = [name for name in big.columns if name not in on] or list(on)
    salted = big.withColumn(salt, F.pmod(F.xxhash64(*rest), F.lit(SALTS)).cast("int"))
    copies = side.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies.hint("merge"), [*on, salt], how).drop(salt)


def checked_side(side, limit=None):
    """``side`` hinted by its measured size, for keys that aren't hot.

    Left to itself, Spark broadcasts a side whose compressed file is small.
    """
    limit = BROADCAST_LIMIT if limit is None else limit
    return F.broadcast(side) if measured_bytes(side) <= limit else side.hint("merge")


def attach_constants(df, constants, by, limit=None, size=None):
    """Add the constants of its group to every row; a null key is a group like any other.

    ``constants`` has one row per group and is settled and measured, unless ``size``, an
    upper bound of its size, is known to be within the limit: then it is computed where it
    is needed. Within the limit it is broadcast, so a hot group of ``df`` isn't shuffled;
    beyond it the rows of a group are spread over salts.
    """
    limit = BROADCAST_LIMIT if limit is None else limit
    side = constants.withColumnsRenamed({name: f"_key_{name}" for name in by})
    if size is None or size > limit:
        side = settle(side, "constants")
        size = measured_bytes(side)
    same = [F.col(name).eqNullSafe(F.col(f"_key_{name}")) for name in by]
    if size <= limit:
        side = F.broadcast(side)
    else:
        rest = [name for name in df.columns if name not in by] or list(by)
        df = df.withColumn("_salt", F.pmod(F.xxhash64(*rest), F.lit(SALTS)).cast("int"))
        side = side.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        side = side.hint("merge")
        same.append(F.col("_salt") == F.col("_copy"))
    joined = df.join(side, reduce(lambda a, b: a & b, same))
    return joined.drop("_salt", "_copy", *(f"_key_{name}" for name in by))
