"""Long tables derived from the star-schema, event, text and vector tables.

A  terms of documents: term counts per document, labelled by quality
B  retail: quantities per brand and customer, grouped by market segment
C  vectors: embedding positions as features
D  events: counts per event type and user
E  symbols: nation names as symbols of nation keys
F  predictions: quality labels against toxicity flags
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contrast import settings as S
from contrast.operators.normalize import unpacked
from contrast.plans.settle import checked_side, settle

LONG = ["cohort", "group", "feature_id", "sample_id", "count"]
BRAND_TYPE = ("p_brand", "p_type")
# Whatever is neither a letter nor a mark on one, in any script.
WORD_BREAK = r"[^\p{L}\p{M}]+"
# The part of it that lies beyond ASCII.
WIDE_BREAK = r"[^\x00-\x7F\p{L}\p{M}]+"
# Baseline log-CPM up to which a recurring term is a candidate.
RECURRENCE_LIMIT = 14.0
# Documents whose words are counted at a time.
COUNTED = 1024
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def terms(spark, sf_dir, by_language=False, halves=False, packed=False):
    """Fixture A, settled: every term of every document, whole texts.

    Documents without a label are the baseline group. With ``halves`` the documents of
    even and of odd id are cohorts of their own, which share their terms. The table is
    written with the cells of a document in one row; ``packed`` leaves them there.
    """
    cohort = F.col("lang") if by_language else F.lit("corpus")
    if halves:
        cohort = F.concat_ws("-", cohort, (F.col("doc_id") % 2).cast("string"))
    documents = table(spark, sf_dir, "documents").where("text is not null")
    documents = documents.select("doc_id", cohort.alias("cohort"), "text")
    quality = table(spark, sf_dir, "labels").select("doc_id", "quality")
    group = F.when(F.col("quality") == 1, S.CASE).when(F.col("quality") == 0, S.CONTROL)

    def labelled(rows):
        """Rows with the group of every label of their document."""
        found = rows.join(checked_side(quality), "doc_id", "left")
        return found.withColumn("group", F.coalesce(group, F.lit(S.BASELINE))).drop("quality")

    # An id that is null or comes again has its rows added up; any other document is
    # counted where it is read, so that no cell is shuffled.
    several = documents.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    several = settle(several.select(F.col("doc_id").alias("again")), "several")
    cells, added = documents, None
    if not several.isEmpty():
        same = F.col("doc_id").eqNullSafe(F.col("again"))
        cells = documents.join(checked_side(several), same, "left_anti")
        added = (
            unpacked(counted_words(documents.join(checked_side(several), same, "left_semi")))
            .groupBy("doc_id", "cohort", "feature_id")
            .agg(F.sum("count").alias("count"))
        )
    cells = counted_words(labelled(cells))
    if added is not None:
        # One cell a row: the rows without an id are one sample, of any size.
        single = F.array(F.struct("feature_id", "count")).alias("cells")
        cells = cells.unionByName(labelled(added).select("doc_id", "cohort", "group", single))
    cells = cells.select("cohort", "group", F.col("doc_id").cast("string").alias("sample_id"), "cells")
    cells = settle(cells, "terms")
    return cells if packed else unpacked(cells).select(*LONG)


def counted_words(rows):
    """``cells`` of every row with a word in ``text``: its different words and their counts.

    Spark lowers the texts and blanks what breaks words beyond ASCII. So a byte is a part of a
    word if it is an ASCII letter or beyond ASCII, and the words of some rows at a time are
    cut and counted as arrays.
    """
    others = [name for name in rows.columns if name != "text"]
    blanked = F.regexp_replace(F.lower("text"), WIDE_BREAK, " ").cast("binary")
    listed = rows.select(*others, F.coalesce(blanked, F.lit(b"")).alias("text"))
    names = [*others, "cells"]
    cell = T.StructType([T.StructField("feature_id", T.StringType()), T.StructField("count", T.LongType())])
    schema = T.StructType([*listed.schema.fields[:-1], T.StructField("cells", T.ArrayType(cell))])
    step = COUNTED
    inside = np.arange(256) >= 128
    for first, last in ("az", "AZ"):
        inside[ord(first) : ord(last) + 1] = True

    def cut(texts):
        """Row and word of each longest run of bytes that are ``inside``."""
        _, ends, data = texts.buffers()
        ends = np.frombuffer(ends, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]
        ends -= ends[0]
        kept = np.flatnonzero(inside[raw])
        # A word begins where the byte before is none of it, or is one of another row.
        row = np.repeat(np.arange(len(texts)), np.diff(ends))[kept]
        begins = np.flatnonzero((np.diff(kept, prepend=-2) > 1) | (np.diff(row, prepend=-1) > 0))
        offsets = np.append(begins, len(kept)).astype(np.int32)
        letters = np.ascontiguousarray(raw[kept])
        words = pa.StringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(letters))
        return row[begins], words

    def run(batches):
        for part in (batch.slice(at, step) for batch in batches for at in range(0, batch.num_rows, step)):
            row, words = cut(part.column(part.num_columns - 1))
            coded = words.dictionary_encode()
            size = max(1, len(coded.dictionary))
            cells, count = np.unique(row * size + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
            found = [coded.dictionary.take(pa.array(cells % size)), pa.array(count, pa.int64())]
            found = pa.StructArray.from_arrays(found, names=["feature_id", "count"])
            lengths = np.bincount(cells // size, minlength=part.num_rows)
            some = np.flatnonzero(lengths)
            ends = pa.array(np.append(0, np.cumsum(lengths[some])), pa.int32())
            columns = [column.take(pa.array(some)) for column in part.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(ends, found)], names=names)

    return listed.mapInArrow(run, schema)


def contrast_of(long):
    """The two contrast groups of a long table."""
    return long.where(F.col("group").isin(S.CASE, S.CONTROL))


def baseline_of(long):
    return long.where(F.col("group") == S.BASELINE)


def term_symbols(spark, sf_dir):
    """Symbols for the terms of the benchmark texts only: other terms stay unmapped."""
    words = table(spark, sf_dir, "benchmark").select(
        F.explode(F.split(F.lower("text"), WORD_BREAK)).alias("feature_id")
    )
    return words.where("feature_id <> ''").distinct().withColumn("symbol", F.upper("feature_id"))


def retail(spark, sf_dir, by_region=False, features=("p_brand",)):
    """Fixture B, settled: whole quantities per feature and customer.

    A feature is a brand, or the combination of several part columns.
    """
    segment = F.col("c_mktsegment")
    group = (
        F.when(segment == "BUILDING", S.CASE)
        .when(segment == "HOUSEHOLD", S.CONTROL)
        .when(segment == "FURNITURE", S.BASELINE)
        .otherwise("other")
    )
    region = (
        table(spark, sf_dir, "nation")
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("n_nationkey", "r_name")
    )
    customer = (
        table(spark, sf_dir, "customer")
        .join(region, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("c_custkey", group.alias("group"), "r_name")
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    name = F.concat_ws(".", *features)
    part = table(spark, sf_dir, "part").select("p_partkey", name.alias("feature_id"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    sold = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(checked_side(part), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("o_custkey", "feature_id")
        .agg(F.sum("l_quantity").cast("long").alias("count"))
    )
    return settle(
        sold.join(checked_side(customer), F.col("o_custkey") == F.col("c_custkey")).select(
            (F.col("r_name") if by_region else F.lit("all")).alias("cohort"),
            "group",
            "feature_id",
            F.col("o_custkey").cast("string").alias("sample_id"),
            "count",
        ),
        "retail",
    )


def vectors(spark, sf_dir):
    """Fixture C: one cell per embedding position; case is label 5 and above."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(
        F.col("vec_id").cast("string").alias("sample_id"),
        F.col("label").cast("string").alias("domain"),
        F.when(F.col("label") >= 5, 1).otherwise(0).alias("is_case"),
        F.posexplode("embedding").alias("pos", "value"),
    ).select(
        "sample_id",
        F.col("pos").cast("string").alias("feature_id"),
        "pos",
        F.col("value").cast("double").alias("value"),
        "domain",
        "is_case",
    )


def vector_positions(cells):
    """Feature list of fixture C: the position is the feature."""
    return settle(cells.select("feature_id", "pos").distinct(), "features")


def events(spark, sf_dir):
    """Fixture D, settled: events per type and user; odd users are the case group."""
    odd = F.col("user_id") % 2 == 1
    return settle(
        table(spark, sf_dir, "events")
        .groupBy("event_type", "user_id")
        .agg(F.count("*").alias("count"))
        .select(
            F.lit("events").alias("cohort"),
            F.when(odd, S.CASE).otherwise(S.CONTROL).alias("group"),
            F.col("event_type").alias("feature_id"),
            F.col("user_id").cast("string").alias("sample_id"),
            "count",
        ),
        "events",
    )


def event_labels(spark, sf_dir):
    """Sample labels of fixture D: odd users, even users, and some of neither class."""
    user = F.col("user_id")
    kind = (
        F.when(user % 10 == 0, "Metastatic")
        .when(user % 2 == 1, S.CASE_LABEL)
        .otherwise(S.CONTROL_LABEL)
    )
    return (
        table(spark, sf_dir, "events")
        .select(user.cast("string").alias("sample_id"), kind.alias("sample_type"))
        .distinct()
    )


def nation_symbols(spark, sf_dir):
    """Fixture E: names of the nations of even regions; the others are unmapped."""
    return (
        table(spark, sf_dir, "nation")
        .where(F.col("n_regionkey") % 2 == 0)
        .select(F.col("n_nationkey").cast("string").alias("feature_id"), F.col("n_name").alias("symbol"))
    )


def predictions(spark, sf_dir):
    """Fixture F: quality as label, absence of toxicity as prediction, length as score."""
    return (
        table(spark, sf_dir, "labels")
        .join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
        .select(
            F.col("quality").cast("double").alias("label"),
            (1 - F.col("toxic")).cast("double").alias("prediction"),
            F.col("n_chars").cast("double").alias("score"),
        )
    )
