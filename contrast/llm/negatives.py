"""Hard negatives by exact Four-Russians scores.

Components are integers, ``floor(256 * x)``. An anchor's components are taken in groups of
eight, and for each group the sums of all 256 subsets are tabled. A candidate is stored as
bit planes (two's complement): byte ``g`` of plane ``p`` holds bit ``p`` of the eight
components of group ``g``. So the score of a plane is a sum of table lookups, one for each
group, and the planes are added with shifts: doubled from the top one down, which counts
negatively. Scores are exact integers; nothing is estimated or pruned.

Anchors are a stated share of the rows, and each meets every row, in blocks: a block of
``ANCHORS`` anchors (whose tables fit a processor's cache) with a block of ``ROWS`` rows is
one group of the shuffle, so a hot label is only more blocks. A block gives a few best rows
for each anchor; these are cut again over all blocks.

1. Positives: an anchor's best rows among those of its label.
2. Negatives: for each positive, the best rows of other labels whose score lies between
   ``LOW`` percent of the positive's score and all of it.

Higher scores come first, then smaller ids. Rows without a label, an id or a vector, and
those with a null or non-finite component, take no part; nor do those with a component of
``LARGEST`` or more, whose products might leave 64 bits. Only vectors of equal length meet;
those of length 0 have a score of 0. Rows of one id are rows of their own: each may be an
anchor, and be a positive of another one. A positive below zero has no negatives, as the
window is empty. An empty table gives an empty table.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from contrast.llm.common import settle
from contrast.plans.settle import join_side

SCALE = 256
EVERY = 100
POSITIVES, NEGATIVES = 5, 5
LOW = 80
LARGEST = 1 << 15
ANCHORS, ROWS = 256, 2048


def subset_sums(anchors):
    """Tables (group, byte, anchor) of integer rows, one anchor a row."""
    n, d = anchors.shape
    groups = -(-d // 8)
    most = int(np.abs(anchors).max(initial=0))
    padded = np.zeros((n, groups * 8), _kind(most, most + 1, d))
    padded[:, :d] = anchors
    tables = np.zeros((groups, 256, n), padded.dtype)
    for bit in range(8):
        part = padded[:, bit::8].T[:, None, :]
        tables[:, 1 << bit : 2 << bit] = tables[:, : 1 << bit] + part
    return tables


def _kind(x, y, d):
    return np.int32 if x * y * max(d, 1) < 1 << 30 else np.int64


def bit_planes(rows, width):
    """Bytes (row, plane, group) of integers that fit ``width`` bits with their sign."""
    planes = [np.packbits(rows >> p & 1, axis=1, bitorder="little") for p in range(width)]
    return np.stack(planes, axis=1)


def scores(tables, planes):
    """Inner products (row, anchor)."""
    total = np.zeros((len(planes), tables.shape[2]), np.int64 if planes.shape[1] > 12 else tables.dtype)
    for p in reversed(range(planes.shape[1])):
        own = np.zeros_like(total)
        for g in range(len(tables)):
            own += tables[g][planes[:, p, g]]
        total = own * -1 if p == planes.shape[1] - 1 else total * 2 + own
    return total


def _best(values, among, k):
    """The ``k`` largest of ``values[among]``, first ones first; ``among`` ascends."""
    own = values[among]
    if len(among) > k:
        keep = own >= np.partition(own, len(own) - k)[len(own) - k]
        among, own = among[keep], own[keep]
    return among[np.argsort(-own, kind="stable")[:k]]


# --- on Spark ---------------------------------------------------------------------


def _rows(vectors):
    x = F.col("embedding").cast("array<double>")
    sound = x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) >= LARGEST))
    own = vectors.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("vec_id").cast("long").alias("id"),
        F.col("label").cast("string").alias("label"),
        F.size(x).alias("d"),
        F.when(sound, F.transform(x, lambda v: F.floor(v * SCALE).cast("int"))).alias("q"),
    )
    return settle(own.where("id is not null and label is not null and q is not null"), "scaled")


def _width(rows):
    """Bits, with the sign, that hold every component."""
    most = F.greatest(F.array_max("q"), -F.array_min("q") - 1)
    return int(rows.agg(F.coalesce(F.max(most), F.lit(0)).alias("most")).first()["most"]).bit_length() + 1


def _packed(rows, width):
    """The rows with their bit planes."""

    def run(batches):
        for batch in batches:
            q = batch.column(4)
            lengths = np.diff(q.offsets.to_numpy())
            starts = np.cumsum(lengths) - lengths
            values = q.flatten().to_numpy()
            planes = [b""] * batch.num_rows
            for d in np.unique(lengths[lengths > 0]):
                at = np.flatnonzero(lengths == d)
                packed = bit_planes(values[starts[at][:, None] + np.arange(d)], width)
                for i, row in enumerate(at):
                    planes[row] = packed[i].tobytes()
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(4)), pa.array(planes, pa.binary())],
                names=["row", "id", "label", "d", "planes"],
            )

    return settle(rows.mapInArrow(run, "row long, id long, label string, d int, planes binary"), "planes")


def _met(anchors, rows, by, anchors_of, rows_of):
    """Both sides dealt to pairs of blocks of equal ``by``, grouped for a cogroup."""
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n"))
    wanted = anchors.groupBy(*by).agg(F.count("*").alias("m"))
    blocks = settle(
        wanted.join(sizes, by).select(
            *by,
            F.ceil(F.col("m") / anchors_of).alias("anchor_blocks"),
            F.ceil(F.col("n") / rows_of).alias("row_blocks"),
        ),
        "blocks",
    )

    def dealt(side, own, other):
        placed = join_side(side, blocks, by)
        block = F.pmod(F.xxhash64("row"), F.col(f"{own}s"))
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}s") - 1))
        return placed.withColumn(own, block).withColumn(other, each).drop("anchor_blocks", "row_blocks").groupBy(
            *by, "anchor_block", "row_block"
        )

    return dealt(anchors, "anchor_block", "row_block"), dealt(rows, "row_block", "anchor_block")


def _block_scores(anchors, rows, width):
    """Scores (row, anchor) of a pair of blocks, the rows ordered by id."""
    d = anchors.column("d")[0].as_py()
    rows = rows.sort_by([("id", "ascending"), ("row", "ascending")])
    q = anchors.column("q").combine_chunks().flatten().to_numpy()
    table = subset_sums(q.reshape(anchors.num_rows, d).astype(np.int64))
    planes = np.frombuffer(b"".join(rows.column("planes").to_pylist()), np.uint8)
    return rows, scores(table, planes.reshape(rows.num_rows, width, -(-d // 8)))


def _positives(anchors, rows, width, k, anchors_of, rows_of):
    """``anchor``, ``row``, ``id``, ``score`` of the best rows of each anchor's label."""

    def run(left, right):
        out = ([], [], [], [])
        if left.num_rows and right.num_rows:
            right, found = _block_scores(left, right, width)
            row, ids = right.column("row").to_numpy(), right.column("id").to_numpy()
            for a, anchor in enumerate(left.column("row").to_numpy()):
                best = _best(found[:, a], np.flatnonzero(row != anchor), k)
                for column, value in zip(out, ([anchor] * len(best), row[best], ids[best], found[best, a]), strict=True):
                    column.extend(value)
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["anchor", "row", "id", "score"])

    left, right = _met(anchors, rows, ["label", "d"], anchors_of, rows_of)
    found = left.cogroup(right).applyInArrow(run, "anchor long, row long, id long, score long")
    return _first(found, ["anchor"], k, "nth")


def _first(found, by, k, out):
    """The ``k`` best of each group with their rank; cut in the tasks before the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id", "row")
    return found.withColumn(out, F.row_number().over(order)).where(F.col(out) <= k)


def _negatives(anchors, rows, width, k, low, anchors_of, rows_of):
    """``anchor``, ``positive``, ``row``, ``id``, ``score``: rows of other labels in the windows."""

    def run(left, right):
        out = ([], [], [], [], [])
        if left.num_rows and right.num_rows:
            right, found = _block_scores(left, right, width)
            row, ids = right.column("row").to_numpy(), right.column("id").to_numpy()
            names = np.array(right.column("label").to_pylist(), object)
            for a, (anchor, label, positives) in enumerate(
                zip(*(left.column(c).to_pylist() for c in ("row", "label", "positives")), strict=True)
            ):
                own = found[:, a]
                foreign = names != label
                for positive in positives:
                    top = positive["score"]
                    fits = foreign & (own >= -(-low * top // 100)) & (own <= top)
                    best = _best(own, np.flatnonzero(fits), k)
                    values = ([anchor] * len(best), [positive["row"]] * len(best), row[best], ids[best], own[best])
                    for column, value in zip(out, values, strict=True):
                        column.extend(value)
        names = ["anchor", "positive", "row", "id", "score"]
        return pa.table([pa.array(c, pa.int64()) for c in out], names=names)

    left, right = _met(anchors, rows, ["d"], anchors_of, rows_of)
    found = left.cogroup(right).applyInArrow(run, "anchor long, positive long, row long, id long, score long")
    return _first(found, ["anchor", "positive"], k, "rank")


def hard_negatives(
    vectors, every=EVERY, positives=POSITIVES, negatives=NEGATIVES, low=LOW, anchors_of=ANCHORS, rows_of=ROWS
):
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id`` and both scores.

    Anchors are the rows whose ``vec_id`` is divisible by ``every``. ``anchors_of`` and
    ``rows_of`` set the size of the blocks and change no row of the result.
    """
    rows = _rows(vectors)
    width = _width(rows)
    packed = _packed(rows, width)
    anchors = rows.where(F.col("id") % every == 0)
    good = settle(_positives(anchors, packed, width, positives, anchors_of, rows_of), "positives")
    # At most ``positives`` rows a group.
    listed = good.groupBy(F.col("anchor").alias("row")).agg(
        F.collect_list(F.struct("row", "score")).alias("positives")
    )
    bad = _negatives(anchors.join(listed, "row"), packed, width, negatives, low, anchors_of, rows_of)
    named = good.select(
        "anchor", F.col("row").alias("positive"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    ids = anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return (
        bad.join(named, ["anchor", "positive"])
        .join(ids, "anchor")
        .select(
            "anchor_id",
            "positive_id",
            "rank",
            F.col("id").alias("negative_id"),
            "positive_score",
            F.col("score").alias("negative_score"),
        )
    )


def negatives_report(vectors):
    """Every seventh id gets the label after its own, as noise; then hard negatives."""
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.select("vec_id", "embedding", shifted.alias("label")))
