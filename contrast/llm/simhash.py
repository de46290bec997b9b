"""SimHash near-duplicates, joined by fuzzy Golay keys.

Two fingerprints of 64 bits link if at most four bits differ. The bits are cut into
segments of 22, 21 and 21. Four errors over three segments leave only two cases:

* a segment has no error: the exact segment is a key;
* every segment has an error: then at least two segments have exactly one. Each of
  these two is decoded with the perfect binary Golay code [23, 12, 7]. A vector has
  one codeword within distance three (its home) and about five within distance four.
  One error flips the parity of a segment. So the fingerprint with even parity gives
  the index of its home, the one with odd parity gives the indices of all codewords
  within four, and the home of the one is among those of the other. Both indices
  together are a key of 24 bits, and only rows of opposite parity meet.

A fingerprint has 3 exact keys and about 30 fuzzy ones; no pair within four bits is
lost. Equal fingerprints are one row in the join. Before it, neighbours in the order
of an exact bucket are linked and contracted, so that in a dense bucket only pairs of
different components are left to emit. The join itself verifies every pair.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Window
from pyspark.sql import functions as F

from contrast.llm.common import settle, whole_texts
from contrast.llm.components import components

SEED = 42
WORDS = 4
BITS = 4
SEGMENTS = (22, 21, 21)
# Fixed value: a generator polynomial of the binary Golay code of length 23.
GOLAY = 0b110001110101
_BLOCK = 1 << 16


# --- fingerprints -----------------------------------------------------------------


def fingerprint(raw, words=WORDS):
    """64-bit SimHash of UTF-8 bytes; a long text is hashed block by block."""
    tokens = raw.lower().split()
    if not tokens:
        return 0
    text = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(tokens) - words + 1)
    ends = ends[-n:].tolist()
    starts = starts[:n].tolist()
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _BLOCK):
        hashes = np.array(
            [
                digest(text[a:b], SEED)
                for a, b in zip(starts[at : at + _BLOCK], ends[at : at + _BLOCK], strict=True)
            ],
            np.uint64,
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs, words=WORDS):
    """``doc_id``, ``fp`` (signed 64 bits) of every whole text.

    Bytes are read as they are, so no text is decoded in Python. A null text counts as
    empty; a text without words has fingerprint zero.
    """

    def run(batches):
        for batch in batches:
            values = [fingerprint(raw, words) for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(values, np.uint64).view(np.int64))],
                names=["doc_id", "fp"],
            )

    raw = whole_texts(docs).withColumn("text", F.col("text").cast("binary"))
    return raw.mapInArrow(run, "doc_id long, fp long")


# --- Golay keys -------------------------------------------------------------------


class Golay:
    """Indices of the codewords around 23-bit vectors, by syndrome."""

    def __init__(self):
        self.low = self._syndromes(np.arange(1 << 12))
        self.high = self._syndromes(np.arange(1 << 11) << 12)
        single = 1 << np.arange(23)
        layers = [np.zeros(1, np.int64)]
        for weight in range(1, 5):
            top = layers[-1]
            grown = (top[:, None] | single[None, :])[top[:, None] < single[None, :]]
            layers.append(grown)
        errors = np.concatenate(layers)
        order = np.argsort(self.syndrome(errors), kind="stable")
        self.errors = errors[order]
        self.at = np.searchsorted(self.syndrome(self.errors), np.arange(2049))

    @staticmethod
    def _syndromes(vectors):
        rest = vectors.astype(np.int64)
        for bit in range(22, 10, -1):
            rest = np.where(rest >> bit & 1, rest ^ (GOLAY << (bit - 11)), rest)
        return rest

    def syndrome(self, vectors):
        return self.low[vectors & 0xFFF] ^ self.high[vectors >> 12]

    def home(self, vector):
        """(row, index): the codeword within three, one for every vector."""
        first = self.at[self.syndrome(vector)]
        return np.arange(len(vector)), (vector ^ self.errors[first]) >> 11

    def near(self, vector):
        """(row, index): the codewords within four, one or more for every vector."""
        s = self.syndrome(vector)
        n = self.at[s + 1] - self.at[s]
        row = np.repeat(np.arange(len(vector)), n)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return row, (vector[row] ^ self.errors[self.at[s][row] + nth]) >> 11


def golay_keys(fps):
    """(row, key, side) of fingerprints; side 2: exact key, 0 and 1: even and odd parity."""
    golay = Golay()
    fps = fps.astype(np.uint64)
    segments, at = [], 0
    for width in SEGMENTS:
        segments.append((fps >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64))
        at += width
    rows, keys, sides = [], [], []

    def add(row, kind, key, side):
        rows.append(row)
        keys.append(np.int64(kind) << 32 | key)
        sides.append(np.full(len(row), side, np.int8))

    for i, segment in enumerate(segments):
        add(np.arange(len(fps)), i, segment, 2)
    parity = [np.bitwise_count(segment) & 1 for segment in segments]
    for kind, (i, j) in enumerate(((0, 1), (0, 2), (1, 2)), len(segments)):
        for p in (0, 1):
            for q in (0, 1):
                own = np.flatnonzero((parity[i] == p) & (parity[j] == q))
                a_row, a = (golay.near if p else golay.home)(segments[i][own])
                b_row, b = (golay.near if q else golay.home)(segments[j][own])
                # All pairs of an index from either segment, row by row.
                n = np.bincount(b_row, minlength=len(own))
                begin = np.cumsum(n) - n
                times = n[a_row]
                nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                row = np.repeat(a_row, times)
                pair = np.repeat(a, times) << 12 | b[begin[row] + nth]
                add(own[row], kind, np.int64(p ^ q) << 24 | pair, p)
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(sides)


def keyed(nodes):
    """``key``, ``side``, ``fp``, ``node`` for each key of each fingerprint."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                fps = part.column(0).to_numpy(zero_copy_only=False)
                node = part.column(1).to_numpy(zero_copy_only=False)
                row, key, side = golay_keys(fps.view(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(side), pa.array(fps[row]), pa.array(node[row])],
                    names=["key", "side", "fp", "node"],
                )

    return nodes.select("fp", "node").mapInArrow(run, "key long, side byte, fp long, node long")


# --- groups -----------------------------------------------------------------------


def _close(a, b, bits):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= bits


def near_links(nodes, bits=BITS):
    """Links (a, b) that connect all nodes within ``bits`` of each other.

    A pair that an earlier link already connects isn't emitted again.
    """
    if bits > BITS:
        raise ValueError(f"the segments find pairs of at most {BITS} bits")
    keys = settle(keyed(nodes), "golay")
    order = Window.partitionBy("key").orderBy("fp")
    chain = settle(
        keys.where("side = 2")
        .select("fp", "node", F.lag("fp").over(order).alias("fp2"), F.lag("node").over(order).alias("node2"))
        .where(_close("fp", "fp2", bits))
        .select(F.col("node").alias("a"), F.col("node2").alias("b"))
        .distinct(),
        "chain",
    )
    label = settle(components(chain, "a", "b"), "label")
    named = settle(
        keys.join(label, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component"),
        "named",
    )
    x = named.select("key", *[F.col(c).alias(f"{c}1") for c in ("side", "fp", "label")])
    y = named.select("key", *[F.col(c).alias(f"{c}2") for c in ("side", "fp", "label")])
    meets = (F.col("side1") * 4 + F.col("side2")).isin(1, 10)
    apart = (F.col("label1") != F.col("label2")) & (
        (F.col("side1") * 4 + F.col("side2") == 1) | (F.col("fp1") < F.col("fp2"))
    )
    crossed = (
        x.join(y, (x["key"] == y["key"]) & meets & apart & _close("fp1", "fp2", bits))
        .select(F.col("label1").alias("a"), F.col("label2").alias("b"))
        .distinct()
    )
    return chain.unionByName(crossed)


def near_groups(docs, words=WORDS, bits=BITS):
    """``doc_id``, ``fp``, ``component_id`` of every document.

    Documents of one id are one node. A document without an id takes part with its
    text, and its group is named by the ids of the others (null if there are none).
    """
    own = settle(fingerprints(docs, words), "fingerprints")
    nodes = settle(own.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    named = nodes.where("node is not null")
    same_id = own.join(named, "fp").where("doc_id <> node").select("fp", F.col("doc_id").alias("a"), F.col("node").alias("b"))
    again = (
        own.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x <> y").select(F.col("doc_id").alias("a"))
    )
    links = settle(near_links(named, bits), "near")
    # An id that has several texts ties the groups of these texts together.
    tied = same_id.join(again, "a", "left_semi").select("a", "b")
    found = settle(components(links.unionByName(tied), "a", "b"), "groups")
    groups = settle(
        nodes.join(found, "node", "left").select(
            "fp", F.coalesce("component", "node").alias("component_id")
        ),
        "components",
    )
    return own.join(groups, "fp").select("doc_id", "fp", "component_id")


def simhash_report(docs):
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return near_groups(docs).select("doc_id", hexed.alias("fingerprint"), "component_id")


def keep_one(docs, words=WORDS, bits=BITS):
    """``docs`` with one document of each near-duplicate group, the one of least id.

    Rows without an id stay, as nothing names them. Repeated rows of a kept id stay
    as they are one document.
    """
    gone = near_groups(docs, words, bits).where("doc_id <> component_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
