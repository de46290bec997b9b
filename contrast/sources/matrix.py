"""Commented text matrices: one row per feature, one column per sample."""

from pyspark.sql import functions as F

from contrast import settings as S
from contrast.operators.matrix import BLOCK, block_samples, dense_blocks, sample_positions
from contrast.plans.settle import join_side, settle

# Files of these names can't be split. Their lines are stored in row groups of this many
# bytes, so that many tasks can share one file.
PACKED = ".gz"
ROW_GROUP = 16 * 1024 * 1024


def read_matrix(spark, path, id_column=S.MATRIX_ID_COLUMN):
    """All lines of the matrix files but the comments.

    ``kind`` is ``header`` or ``row``; ``file`` tells the files of one read apart,
    each of which has a header of its own.
    """
    is_header = F.col("value").startswith(id_column)
    return (
        spark.read.text(path)
        .select("value", F.col("_metadata.file_path").alias("file"))
        .where(~F.col("value").startswith(S.COMMENT_PREFIX) & (F.trim("value") != ""))
        .withColumn("kind", F.when(is_header, "header").otherwise("row"))
    )


def matrix_headers(raw):
    """Sample ids of each file in column order."""
    fields = F.split("value", S.FIELD_SEPARATOR)
    return raw.where("kind = 'header'").select(
        "file", F.slice(fields, 2, F.size(fields)).alias("sample_ids")
    )


def header_positions(raw):
    """One row per header column: file, position and sample id."""
    return matrix_headers(raw).select("file", F.posexplode("sample_ids").alias("pos", "sample_id"))


def unpacked(raw):
    """Lines with those of compressed files in a table that can be split.

    The one full read of such a file: its header and its rows both come from the table.
    """
    names = raw.inputFiles()
    if not any(name.endswith(PACKED) for name in names):
        return raw
    packed = F.col("file").endswith(PACKED)
    stored = settle(raw.where(packed), "lines", **{"parquet.block.size": ROW_GROUP})
    if all(name.endswith(PACKED) for name in names):
        return stored
    return raw.where(~packed).unionByName(stored)


def matrix_to_long(raw):
    """Unpivot: one row per (feature, sample) with its count.

    Each text row meets the header of its file before it is taken apart, so the
    cells need no join. A short row has fewer cells, surplus fields are ignored,
    and a count that is not a number is NULL. A file without header fails.
    Compressed files are read once, by ``unpacked``.
    """
    raw = unpacked(raw)
    headers = settle(matrix_headers(raw), "headers")
    fields = F.split("value", S.FIELD_SEPARATOR)
    rows = raw.where("kind = 'row'").select(
        "file", fields[0].alias("feature_id"), F.slice(fields, 2, F.size(fields)).alias("counts")
    )
    titled = join_side(rows, headers, ["file"], "left")
    missing = F.raise_error(F.concat(F.lit("no header line in "), "file"))
    ids = F.coalesce("sample_ids", missing.cast("array<string>"))
    titled = titled.select("feature_id", "counts", ids.alias("sample_ids"))
    width = F.least(F.size("sample_ids"), F.size("counts"))
    cells = F.arrays_zip(
        F.slice("sample_ids", 1, width).alias("sample_id"),
        F.slice("counts", 1, width).alias("count"),
    )
    return titled.select("feature_id", F.inline(cells).alias("sample_id", "count")).select(
        "feature_id", "sample_id", F.col("count").try_cast("long").alias("count")
    )


def label_samples(long, labels, keep=(S.CASE_LABEL, S.CONTROL_LABEL)):
    """Attach sample types and keep the classes to contrast; others are dropped."""
    kept = settle(labels.where(F.col("sample_type").isin(*keep)), "labels")
    return join_side(long, kept, ["sample_id"])


def to_groups(labelled, cohort, case=S.CASE_LABEL, control=S.CONTROL_LABEL):
    """Long table columns from labelled cells."""
    group = F.when(F.col("sample_type") == case, S.CASE).when(
        F.col("sample_type") == control, S.CONTROL
    )
    return labelled.select(
        F.lit(cohort).alias("cohort"), group.alias("group"), "feature_id", "sample_id", "count"
    )


def write_matrix(long, path, id_column=S.MATRIX_ID_COLUMN, block=BLOCK):
    """Write a long table as matrix files, one per cohort and block of samples."""
    positions = sample_positions(long, block)
    separator = S.FIELD_SEPARATOR
    rows = dense_blocks(long, positions, block).select(
        "cohort",
        "block",
        F.lit(1).alias("line"),
        F.concat_ws(
            separator, "feature_id", F.col("counts").cast("array<string>")
        ).alias("value"),
    )
    ids = F.transform("members", lambda member: member["sample_id"])
    headers = block_samples(positions).select(
        "cohort", "block", F.concat_ws(separator, F.lit(id_column), ids).alias("header")
    )
    comment = F.concat(F.lit(S.COMMENT_PREFIX), F.lit("cohort="), "cohort")
    lines = F.array(
        F.struct(F.lit(-1).alias("line"), comment.alias("value")),
        F.struct(F.lit(0).alias("line"), F.col("header").alias("value")),
    )
    top = headers.select("cohort", "block", F.inline(lines))
    (
        top.unionByName(rows)
        .repartition("cohort", "block")
        .sortWithinPartitions("cohort", "block", "line", "value")
        .select("cohort", "block", "value")
        .write.mode("overwrite")
        .partitionBy("cohort", "block")
        .text(path)
    )
