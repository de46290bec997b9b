"""Mixing sources to target weights by temperature.

The token shares of the sources are raised to an exponent and normalised. Bisection
finds the largest exponent (the mix nearest to the data) that meets the targets:

* the entropy of the weights is at least ``entropy`` of the largest possible one,
* no source is repeated more than ``repeats`` times its tokens; this limit goes first.

The budget is the least number of tokens at which every source is passed once in whole
(so no document is lost), or the number given. A source gets weight times budget tokens:
whole passes over all its documents, and part of one more. Each pass has its own
permutation: documents are dealt to blocks by a keyed hash and stand in the order of
their hashes, block by block. The last pass ends where its tokens are used up: whole
blocks are taken from the sums of the blocks, and only the one block in which the
budget ends is looked at row by row.

Column expressions only; per-source sums are one row per source, and running sums are
over the 4096 blocks of a source or the rows of one block, so no source is gathered in
a task.

A null source is a source of its own. Tokens are words between white space; a text
without any counts one, so that it can be drawn. Rows are drawn one by one, also those
that share an id. One source alone has weight one.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from contrast.llm.common import settle
from contrast.plans.settle import join_side

ENTROPY = 0.95
REPEATS = 1.5
# The exponent is found to this many binary digits, so it is an exact number.
STEPS = 20
BLOCK_BITS = 12
SEED = 11


def source_rows(docs):
    """``doc_id``, ``source``, ``tokens``, ``text_md5`` of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.greatest(F.lit(1), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))).cast("long").alias("tokens"),
        F.md5(text).alias("text_md5"),
    )


def _add(values):
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def _largest(ok):
    """Largest multiple of 2**-STEPS in 0..1 up to which ``ok`` holds; it holds at 0."""

    def halve(acc, _):
        middle = (acc["low"] + acc["high"]) / 2
        good = ok(middle)
        return F.struct(
            F.when(good, middle).otherwise(acc["low"]).alias("low"),
            F.when(good, acc["high"]).otherwise(middle).alias("high"),
        )

    start = F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, halve, lambda acc: acc["low"])
    return F.when(ok(F.lit(1.0)), F.lit(1.0)).otherwise(found)


def source_weights(rows, entropy=ENTROPY, repeats=REPEATS, budget=None):
    """``source``, ``tokens``, ``exponent``, ``weight``, ``target``: one row per source.

    The token sums stand in one array while the exponent is sought: it has one number
    for each source. Three numbers come back to the driver.
    """
    sums = settle(rows.groupBy("source").agg(F.sum("tokens").alias("tokens")), "sources")
    most, least = F.element_at("t", -1), F.element_at("t", 1)

    def powers(a):
        return F.transform("t", lambda t: F.pow(t / F.col("total"), a))

    def spread_enough(a):
        # Entropy of p = x / s over all x: log s - sum(x log x) / s.
        s = _add(powers(a))
        xlogx = _add(F.transform(powers(a), lambda x: x * F.log(x)))
        return F.log(s) - xlogx / s >= F.lit(float(entropy)) * F.log(F.size("t").cast("double"))

    def seldom_enough(a):
        # The smallest source is repeated most.
        if budget is None:
            passes = F.pow(least / most, a - 1)
        else:
            passes = F.pow(least / F.col("total"), a) / _add(powers(a)) * float(budget) / least
        return passes <= F.lit(float(repeats))

    by_entropy = _largest(spread_enough)
    by_repeats = 1 - _largest(lambda b: seldom_enough(1 - b))
    # At the budget that passes the largest source once.
    once = most / (F.pow(most / F.col("total"), F.col("exponent")) / F.col("norm"))
    fit = (
        sums.agg(F.sort_array(F.collect_list(F.col("tokens").cast("double"))).alias("t"))
        .withColumn("total", _add("t"))
        .withColumn("exponent", F.greatest(by_entropy, by_repeats))
        .withColumn("norm", _add(powers(F.col("exponent"))))
        .where(F.size("t") > 0)
        .select("total", "exponent", "norm", once.alias("budget"))
        .first()
    )
    total, exponent, norm, least_budget = fit or (1.0, 1.0, 1.0, 0.0)
    weight = F.pow(F.col("tokens") / F.lit(total), F.lit(exponent)) / F.lit(norm)
    return sums.select(
        "source",
        "tokens",
        F.lit(exponent).alias("exponent"),
        F.round(weight, 12).alias("weight"),
        F.round(weight * F.lit(float(least_budget if budget is None else budget))).cast("long").alias("target"),
    )


def _place(number):
    """48 bits of MD5: the place of a row in the permutation of a pass."""
    key = F.concat_ws(
        ":", F.lit(str(SEED)), number, F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "text_md5"
    )
    return F.conv(F.substr(F.md5(key), F.lit(1), F.lit(12)), 16, 10).cast("long")


def _block(place):
    return F.shiftright(place, 48 - BLOCK_BITS)


def _named(source):
    """Sources as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("-"))


def pass_ends(rows, weights):
    """One row per source: ``whole`` passes, and where the next one ends.

    Blocks below ``cut`` are in the last pass; of block ``cut`` there is room for
    ``room`` tokens.
    """
    plan = settle(
        weights.select(
            _named(F.col("source")).alias("key"),
            F.expr("target div tokens").alias("whole"),
            F.expr("target % tokens").alias("rest"),
        ),
        "passes",
    )
    placed = join_side(rows.withColumn("key", _named(F.col("source"))), plan, ["key"])
    sums = placed.groupBy("key", "whole", "rest", _block(_place(F.col("whole"))).alias("block")).agg(
        F.sum("tokens").alias("own")
    )
    upto = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    over = sums.withColumn("upto", F.sum("own").over(upto)).where("upto > rest")
    return over.groupBy("key", "whole").agg(
        F.min(F.struct("block", (F.col("rest") - F.col("upto") + F.col("own")).alias("room"))).alias("end")
    ).select("key", "whole", F.col("end.block").alias("cut"), F.col("end.room").alias("room"))


def _room_taken(rows, ends):
    """Keys (doc_id, text_md5, source) of the cut blocks' rows that still fit."""
    placed = join_side(rows.withColumn("key", _named(F.col("source"))), ends, ["key"]).withColumn(
        "place", _place(F.col("whole"))
    )
    line = (
        Window.partitionBy("key")
        .orderBy("place", "doc_id", "text_md5")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        placed.where(_block(F.col("place")) == F.col("cut"))
        .withColumn("upto", F.sum("tokens").over(line))
        .groupBy("key", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).alias("id"), "text_md5")
        .agg(F.sum((F.col("upto") <= F.col("room")).cast("long")).alias("fits"), F.count("*").alias("rows"))
        .where("fits > 0")
    )


def mix(docs, entropy=ENTROPY, repeats=REPEATS, budget=None):
    """``docs``, each row as often as the mix draws it, with ``pass``, ``block``, ``place``.

    ``pass`` counts from 0; a pass of a source is read in the order of block and place.
    Of rows that repeat id, source and text in a block where the budget ends, all are
    drawn if all fit; else each passes for the others, and they are drawn whole passes
    only.
    """
    columns = docs.columns
    rows = settle(source_rows(docs), "mixed")
    weights = source_weights(rows, entropy, repeats, budget)
    ends = settle(pass_ends(rows, weights), "ends")
    taken = settle(_room_taken(rows, ends).where("fits = rows").drop("fits", "rows"), "taken")
    base = docs.select(
        F.struct(*[docs[c] for c in columns]).alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_md5"),
        _named(F.col("source").cast("string")).alias("key"),
        F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("-")).alias("id"),
    )
    drawn = join_side(base, ends, ["key"]).withColumn("last", _block(_place(F.col("whole"))))
    drawn = join_side(drawn, taken.withColumn("fits", F.lit(True)), ["key", "id", "text_md5"], "left")
    more = (F.col("last") < F.col("cut")) | ((F.col("last") == F.col("cut")) & F.coalesce("fits", F.lit(False)))
    times = F.col("whole") + more.cast("long")
    return (
        drawn.where(times > 0)
        .withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), times - 1)))
        .withColumn("place", _place(F.col("pass")))
        .select("row", "pass", _block(F.col("place")).alias("block"), "place")
    )


def mix_report(docs):
    """One row for each time that a document is drawn."""
    drawn = mix(docs.select("doc_id", "source", "text"))
    return drawn.select(
        F.col("row.doc_id").cast("long").alias("doc_id"),
        F.col("row.source").alias("source"),
        "pass",
        "block",
        "place",
    )


def mixed_documents(docs, entropy=ENTROPY, repeats=REPEATS, budget=None):
    """The documents as drawn, with the columns of ``docs``."""
    return mix(docs, entropy, repeats, budget).select("row.*")
