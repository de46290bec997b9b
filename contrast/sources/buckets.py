"""Tables stored in hash buckets of their key, so that joins on it need no shuffle.

Two tables with the same key columns and number of buckets are joined bucket by bucket:
neither side has an Exchange. The rows of a key share a bucket, so this suits tables with
one row a key, such as results and profiles; cell tables stay in ``write_long``.

The layout is stored beside the table, and a session that reads it registers the table
under a name made from its path.
"""

import hashlib

from pyspark.sql import functions as F

from contrast import settings as S

LAYOUT = "columns string, keys array<string>, buckets int"


def _layout_path(path):
    return f"{path.rstrip('/')}-layout"


def _name(path):
    return f"contrast_{hashlib.md5(path.rstrip('/').encode()).hexdigest()[:20]}"


def write_bucketed(df, path, keys, buckets=S.RESULT_BUCKETS):
    """Store ``df`` in ``buckets`` buckets of ``keys``, one file each; what is there is replaced."""
    spark, keys, name = df.sparkSession, list(keys), _name(path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    (
        df.repartition(buckets, *keys)
        .write.format("parquet")
        .bucketBy(buckets, *keys)
        .sortBy(*keys)
        .option("path", path)
        .mode("overwrite")
        .saveAsTable(name)
    )
    # Only the entry of the catalog goes; the files stay.
    spark.sql(f"DROP TABLE {name}")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    layout = spark.range(1).select(
        F.lit(columns).alias("columns"), F.array(*map(F.lit, keys)).alias("keys"), F.lit(buckets).alias("buckets")
    )
    layout.write.mode("overwrite").parquet(_layout_path(path))


def read_bucketed(spark, path):
    """The table stored by ``write_bucketed``, with its layout known to the planner."""
    name = _name(path)
    layout = spark.read.schema(LAYOUT).parquet(_layout_path(path)).first()
    keys = ", ".join(f"`{key}`" for key in layout["keys"])
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(
        f"CREATE TABLE {name} ({layout['columns']}) USING parquet "
        f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {layout['buckets']} BUCKETS "
        f"LOCATION '{path.replace(chr(39), chr(92) + chr(39))}'"
    )
    return spark.table(name)
