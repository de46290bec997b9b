"""Embedding near-duplicates by randomised-rotation binary codes.

Vectors are scaled to length one and rotated at random (several independent rotations, one
below the other, until there are ``CODE_BITS`` numbers). The signs are the code; the inner
product of the rotated vector with its own code is stored as its correction factor. For a
vector o with code c and factor f, and a rotated vector q, ``c.q / f`` is an unbiased
estimate of the inner product, and its error is about ``sqrt(1 - f*f) / f`` over the root
of the code's length, times the sine of the angle. A pair at the threshold or above lies
within ``SIGMAS`` of these; only pairs whose estimate plus this bound reaches the
threshold are computed again, in double precision, and only these links count.

Candidates come from the codes too: ``BANDS`` pieces of ``BAND_BITS`` bits, and vectors of
one label that agree in a piece meet. At the threshold two bits differ with a probability
of 6.4 %; so a pair at 0.98 is missed with a probability of about one in a million, a
closer one less often. A pair that meets in several pieces counts in the first.

Vectors that are equal are one row up to the end. A bucket with more than ``BLOCK`` rows
is cut into blocks by hash and each pair of blocks is a group of its own, so no task
holds a bucket. Pairs aren't given out: a group gives the number of links of each row
and one link to the root of the row's component in the group.

Vectors that are null, of length zero or hold null or non-finite components, and those
without a label, have no links; they are their own component. Vectors of different
lengths don't link. Rows of one id are one node. A vector without an id counts as a copy
of others but starts no component of its own.
"""

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from contrast.llm.common import settle
from contrast.llm.components import components
from contrast.plans.settle import join_side

THRESHOLD = 0.98
CODE_BITS = 512
BAND_BITS = 16
BANDS = CODE_BITS // BAND_BITS
SIGMAS = 6.0
BLOCK = 512
SEED = 3


@lru_cache(8)
def rotations(dimensions):
    """Random orthogonal matrices below each other, scaled so that lengths are kept."""
    rng = np.random.default_rng(SEED)
    times = max(1, -(-CODE_BITS // dimensions))
    parts = []
    for _ in range(times):
        q, r = np.linalg.qr(rng.normal(size=(dimensions, dimensions)))
        parts.append(q * np.sign(np.diag(r)))
    return np.concatenate(parts) / math.sqrt(times)


def encode(unit):
    """(bits, factors) of unit vectors, one a row."""
    y = unit @ rotations(unit.shape[1]).T
    bits = y >= 0
    factors = np.abs(y).sum(axis=1) / math.sqrt(y.shape[1])
    return bits, factors


def estimates(bits, factors, unit):
    """Estimated inner products: row i's code against vector j."""
    y = unit @ rotations(unit.shape[1]).T
    signs = np.where(bits, 1.0, -1.0).astype(np.float32) / np.float32(math.sqrt(y.shape[1]))
    return (signs @ y.T.astype(np.float32)) / factors[:, None]


def bound(factors, bits, threshold):
    """Largest error to allow for at the threshold."""
    spread = np.sqrt(np.maximum(0, 1 - factors**2)) / factors / math.sqrt(max(1, bits - 1))
    return SIGMAS * spread * math.sqrt(1 - threshold**2)


def _pieces(bits):
    """Bands of a code as numbers."""
    cut = bits[:, : BANDS * BAND_BITS].reshape(len(bits), BANDS, BAND_BITS)
    return cut @ (1 << np.arange(BAND_BITS))


# --- on Spark ---------------------------------------------------------------------


def _hashed(vectors):
    """``id``, ``label``, ``x`` (doubles) and two hashes; null hashes for what can't link."""
    x = F.col("embedding").cast("array<double>")
    sound = (
        F.col("label").isNotNull()
        & x.isNotNull()
        & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
        & F.exists(x, lambda v: v != 0)
    )
    # Zeros of either sign are one value.
    plain = F.when(F.coalesce(sound, F.lit(False)), F.transform(x, lambda v: v + F.lit(0.0)))
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("id"),
        F.col("label").cast("string").alias("label"),
        plain.alias("x"),
    )
    known = F.col("x").isNotNull()
    return rows.withColumns(
        {
            "h1": F.when(known, F.xxhash64("label", "x")),
            "h2": F.when(known, F.xxhash64("x", "label", F.lit(SEED))),
        }
    )


def _classes(hashed):
    """One row for each different vector of a label: least id, copies, code, factor, bands."""

    def run(batches):
        for batch in batches:
            x = batch.column(batch.schema.get_field_index("x"))
            lengths = np.diff(x.offsets.to_numpy())
            values = x.flatten().to_numpy()
            starts = np.cumsum(lengths) - lengths
            n = batch.num_rows
            codes, factors, bands = [None] * n, np.zeros(n), [None] * n
            for d in np.unique(lengths):
                rows = np.flatnonzero(lengths == d)
                bits, factor = encode(_unit(values[starts[rows][:, None] + np.arange(d)]))
                factors[rows] = factor
                packed, pieces = np.packbits(bits, axis=1), _pieces(bits)
                for i, row in enumerate(rows):
                    codes[row], bands[row] = packed[i].tobytes(), pieces[i]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(lengths, pa.int32()),
                    pa.array(codes, pa.binary()),
                    pa.array(factors),
                    pa.array(bands, pa.list_(pa.int32())),
                ],
                names=[*batch.schema.names, "d", "code", "factor", "bands"],
            )

    one = hashed.where("h1 is not null").groupBy("label", "x", "h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    return one.where("id is not null").mapInArrow(
        run,
        "label string, x array<double>, h1 long, h2 long, id long, copies long, "
        "d int, code binary, factor double, bands array<int>",
    )


def _unit(x):
    # Scaled first, so that squares of very large or small numbers don't overflow.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _links_of(x, bits, factors, copies, blocks, threshold):
    """(links to others counted here, root of each row) of a group of vectors."""
    unit = _unit(x)
    near = estimates(bits, factors, unit) + bound(factors, bits.shape[1], threshold)[:, None] >= threshold
    if blocks.min() != blocks.max():
        near &= blocks[:, None] != blocks[None, :]
    np.fill_diagonal(near, False)
    near |= near.T
    i, j = np.nonzero(np.triu(near))
    link = np.zeros_like(near)
    # Exact cosines, a stretch of pairs at a time.
    for at in range(0, len(i), 1 << 16):
        a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        good = (unit[a] * unit[b]).sum(axis=1) >= threshold
        link[a[good], b[good]] = link[b[good], a[good]] = True
    root = np.arange(len(x))
    while True:
        least = np.minimum(root, np.where(link, root[None, :], len(x)).min(axis=1))
        least = least[least]
        if (least == root).all():
            break
        root = least
    return link, root


def near_links(classes, threshold=THRESHOLD, block=BLOCK):
    """``id``, ``links``, ``root``: what each group of candidates knows of its rows."""
    slim = classes.select("label", "d", "id", F.posexplode("bands").alias("band", "piece"))
    key = ["label", "d", "band", "piece"]
    met = settle(slim.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    rows = join_side(slim, met, key)
    n = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(SEED)), n).cast("int")
    placed = (
        rows.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
        .withColumn("one", F.least("own", "other"))
        .withColumn("two", F.greatest("own", "other"))
        .select(*key, "one", "two", "own", "id")
    )
    group = [*key, "one", "two"]
    width = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = (
        placed.join(classes.select("id", "copies", "x", "code", "factor", "bands"), "id")
        .repartition(width, *group)
        .sortWithinPartitions(*group, "id")
        .select(*group, "own", "id", "copies", "x", "code", "factor", "bands")
    )

    def run(batches):
        held, current, out = [], None, []

        def done():
            if len({row["id"] for row in held}) < 2:
                return
            x = np.array([row["x"] for row in held])
            code = np.frombuffer(b"".join(row["code"] for row in held), np.uint8).reshape(len(held), -1)
            bits = np.unpackbits(code, axis=1)[:, : len(rotations(x.shape[1]))].astype(bool)
            copies = np.array([row["copies"] for row in held])
            bands = np.array([row["bands"] for row in held])
            blocks = np.array([row["own"] for row in held])
            factors = np.array([row["factor"] for row in held])
            link, root = _links_of(x, bits, factors, copies, blocks, threshold)
            ids = np.array([row["id"] for row in held])
            # Pairs that already met in an earlier band are counted there.
            counted = link
            for band in range(held[0]["band"]):
                counted = counted & (bands[:, band][:, None] != bands[:, band][None, :])
            linked = np.flatnonzero(link.any(axis=1))
            for row in linked:
                out.append((int(ids[row]), int(counted[row] @ copies), int(ids[root[row]])))

        def given():
            batch = pa.RecordBatch.from_arrays(
                [pa.array([row[i] for row in out], pa.int64()) for i in range(3)],
                names=["id", "links", "root"],
            )
            out.clear()
            return batch

        for batch in batches:
            for row in batch.to_pylist():
                mark = tuple(row[k] for k in group)
                if mark != current:
                    done()
                    held.clear()
                    current = mark
                    if len(out) > 1 << 14:
                        yield given()
                held.append(row)
        done()
        yield given()

    return full.mapInArrow(run, "id long, links long, root long")


def vector_groups(vectors, threshold=THRESHOLD, block=BLOCK):
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` of every vector."""
    hashed = _hashed(vectors)
    classes = settle(_classes(hashed), "vectors")
    found = settle(near_links(classes, threshold, block), "near")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    joined = settle(components(found, "id", "root"), "groups")
    known = settle(
        classes.select("h1", "h2", "id", "copies")
        .join(links, "id", "left")
        .join(joined.withColumnRenamed("node", "id"), "id", "left")
        .select(
            "h1",
            "h2",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
        ),
        "classes",
    )
    # The slim table is written, so that vectors aren't read for every pass over it.
    slim = settle(hashed.select("id", "h1", "h2"), "vector-ids")
    named = join_side(slim, known, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "id")
    return named.select(
        F.col("id").alias("vec_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
