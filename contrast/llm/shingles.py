"""Near-duplicate groups: SimHash and Golay keys propose, five-word shingles decide.

Two texts link if their sets of five-word shingles have a Jaccard similarity of ``SIMILAR``
or more. At 0.8 a 64-bit SimHash of these shingles differs in about ten bits, which four-bit
keys can't find. The set of a text's words changes five times less: one edit touches five
shingles but one word. So the first candidates come from fingerprints of the different words.

1. A text has ``PRINTS`` independent fingerprints of its words. The Golay keys of
   ``llm/simhash.py`` bring together all texts within four bits; neighbours in a bucket are
   proposed, what they join is contracted, and of the pairs that still lie in different parts
   one for each two parts is proposed. Neighbours in the buckets of step 3 are proposed too.
   So the number of pairs grows with the number of texts, in a group of copies as well.
2. Every proposed pair is verified by its exact similarity. A sketch of both sets first tells
   pairs that can't be similar: it bounds the shingles that only one of them has from below, so
   no link goes with them. All others are verified with whole texts, a bounded volume at a time:
   if there is more, every group meets one other first, and pairs that lie in one group by then
   are left out. Only verified pairs link; what they link is contracted.
3. Step 1 proposes few of a group's pairs, so the links it misses are found by an exact join.
   Under any one order of all shingles, two similar texts share one of their first fifth (and
   one more): these are the buckets. Of every two groups that step 2 left apart and that share a
   bucket, the few most promising pairs are verified and contracted. Then all pairs in a bucket
   whose texts are still apart, and whose places in the order leave room for the similarity,
   are verified as well. So a text beside a large group joins it by a few pairs, not by all. The
   order puts frequent shingles last; it decides how many pairs there are, not which links are
   found.

Equal texts are one node, named by a 64-bit hash. Texts without words have equal (empty)
sets; a text of fewer words is one shingle. Rows without an id link nothing.
"""

from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contrast.llm.common import batches_of, settle, whole_texts
from contrast.llm.components import components
from contrast.llm.simhash import BITS, keyed
from contrast.plans.settle import BROADCAST_LIMIT, join_side, measured_bytes, tidied

SEED = 42
WORDS = 5
SIMILAR = 0.8
PRINTS = 2
SALTS = 64
# Shingles met this often in one of so many texts go last in the order, up to a number.
SAMPLED, FREQUENT, LATE = 16, 4, 1 << 20
_BLOCK = 1 << 12
# Texts of a group that a bucket gives, and pairs of two groups, that are tried before all are.
LEADING, TRIED = 4, 16
# Rows of an Arrow batch, which may hold two texts each.
ROWS = 2048
# Bytes of texts that are joined to pairs at a time: this share of all texts, or so many if that
# is more. And pairs that are sent to the tasks at a time, as ``measured_bytes`` has them.
SHARE, BATCH, SENT = 2, 1 << 28, BROADCAST_LIMIT // 64
# Parts of the buckets that meet their groups one after the other, if these can't be broadcast.
CUTS = 4


def shingle_set(raw, words=WORDS):
    """Sorted 64-bit hashes of the different shingles of UTF-8 bytes."""
    tokens = raw.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    text = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(tokens) - words + 1)
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)
    return np.unique(np.fromiter((digest(text[a:b], SEED) for a, b in pairs), np.uint64, n))


def similar(left, right, least=SIMILAR):
    """Whether two shingle sets have a Jaccard similarity of ``least`` or more."""
    both = len(np.intersect1d(left, right, assume_unique=True))
    return both >= least * (len(left) + len(right) - both)


def sketch(shingles):
    """Parities of a set: a bit for each remainder of its shingles by a power of two.

    The power is no less than the number of shingles.
    """
    bits = max(64, 1 << (len(shingles) - 1).bit_length())
    counts = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def may_be_similar(left, right, n_left, n_right, least=SIMILAR):
    """Whether two sets of these sketches and sizes may have a similarity of ``least``.

    A bit that differs stands for a shingle at least that only one of them has, in a sketch
    folded to half its bits as well.
    """
    few, many = sorted((left, right), key=len)
    least_bits, bits = 8 * len(few), 8 * len(many)
    few, many = int.from_bytes(few, "little"), int.from_bytes(many, "little")
    while bits > least_bits:
        bits //= 2
        many = (many >> bits) ^ (many & ((1 << bits) - 1))
    alone = max((few ^ many).bit_count(), abs(n_left - n_right))
    return alone * (1 + least) <= (n_left + n_right) * (1 - least) + 1e-6


def prefix(shingles, late, least=SIMILAR):
    """The shingles of a sorted set of which similar sets share one, in their order.

    ``late`` is a sorted array of shingles that go last. Without words it is a zero, as all
    such texts are alike.
    """
    if not len(shingles):
        return np.zeros(1, np.uint64)
    n = len(shingles) - int(np.ceil(len(shingles) * least - 1e-9)) + 1
    if not len(late):
        return shingles[:n]
    at = np.minimum(np.searchsorted(late, shingles), len(late) - 1)
    return shingles[np.argsort(late[at] == shingles, kind="stable")[:n]]


def word_prints(raw, prints=PRINTS):
    """Fingerprints of the different words of UTF-8 bytes; zeros without words."""
    words = list(set(raw.lower().split()))
    counts = np.zeros(64 * prints, np.int64)
    if not words:
        return np.zeros(prints, np.int64)
    digest = xxhash.xxh3_128_digest
    for at in range(0, len(words), _BLOCK):
        part = words[at : at + _BLOCK]
        hashes = b"".join(digest(w, seed) for w in part for seed in range(-(-prints // 2)))
        bits = np.frombuffer(hashes, np.uint8).reshape(len(part), -1)[:, : 8 * prints]
        counts += np.unpackbits(bits, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(words)).view(np.int64)


# --- on Spark ---------------------------------------------------------------------


def _coded(docs):
    text = F.col("text").cast("binary")
    return whole_texts(docs).where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("code"), text.alias("raw"))


def printed(docs):
    """``doc_id``, ``code`` (names the text), ``prints``, ``n`` (shingles), ``size`` (bytes) and
    ``sketch`` (of the shingles) of every row with an id."""

    def run(batches):
        for batch in batches:
            found = []
            for scalar in batch.column(2):
                raw = scalar.as_py()
                shingles = shingle_set(raw)
                found.append((word_prints(raw), len(shingles), len(raw), sketch(shingles)))
            kinds = pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.binary()
            more = [pa.array([row[i] for row in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *more], names=["doc_id", "code", "prints", "n", "size", "sketch"]
            )

    return _coded(docs).mapInArrow(
        run, "doc_id long, code long, prints array<long>, n int, size long, sketch binary"
    )


def _close(a, b):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= BITS


def _same_print(texts):
    """Pairs that chain the texts of one fingerprint; a frequent one is spread over salts."""
    salted = texts.withColumn("salt", F.pmod(F.xxhash64("code"), F.lit(SALTS)))
    within = Window.partitionBy("print", "fp", "salt").orderBy("code")
    chained = salted.select("print", "fp", "salt", "code", F.lag("code").over(within).alias("before"))
    # At most SALTS first ones of a fingerprint.
    across = Window.partitionBy("print", "fp").orderBy("salt")
    first = chained.where("before is null").select("code", F.lag("code").over(across).alias("before"))
    return chained.select("code", "before").unionByName(first).where("before is not null").select(
        F.col("before").alias("a"), F.col("code").alias("b")
    )


def _least_first(a, b):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def proposed(own):
    """Pairs (a, b) of codes that connect texts (``prints``, ``code``) within four bits."""
    texts = own.select(F.posexplode("prints").alias("print", "fp"), "code").distinct()
    nodes = settle(texts.groupBy("print", "fp").agg(F.min("code").alias("node")), "nodes")
    keys = [keyed(nodes.where(F.col("print") == i)).withColumn("print", F.lit(i)) for i in range(PRINTS)]
    keys = settle(reduce(DataFrame.unionByName, keys), "golay")
    order = Window.partitionBy("print", "key").orderBy("fp")
    before = [F.lag(c).over(order).alias(f"{c}2") for c in ("fp", "node")]
    chain = keys.where("side = 2").select("fp", "node", *before).where(_close("fp", "fp2"))
    chain = settle(chain.select(F.col("node").alias("a"), F.col("node2").alias("b")).distinct(), "chain")
    spark = own.sparkSession
    label = tidied(spark, lambda: components(chain, "a", "b"), "label")
    named = join_side(keys, label, ["node"], "left").withColumn("label", F.coalesce("component", "node"))
    # The shuffles of the keys go before they are joined with each other.
    named = tidied(spark, lambda: named.select("print", "key", "side", "fp", "node", "label"), "named")
    x, y = (named.select("print", "key", *[F.col(c).alias(c + i) for c in ("side", "fp", "node", "label")]) for i in "12")
    sides = F.col("side1") * 4 + F.col("side2")
    meets = (sides == 1) | ((sides == 10) & (F.col("fp1") < F.col("fp2")))
    apart = F.col("label1") != F.col("label2")
    same = (x["print"] == y["print"]) & (x["key"] == y["key"])
    crossed = (
        x.join(y, same & meets & apart & _close("fp1", "fp2"))
        .groupBy(F.least("label1", "label2").alias("p"), F.greatest("label1", "label2").alias("q"))
        .agg(F.min(F.struct(*_least_first("node1", "node2"))).alias("pair"))
        .select("pair.a", "pair.b")
    )
    return chain.unionByName(crossed).unionByName(_same_print(texts))


def frequent(docs):
    """Sorted array of at most ``LATE`` shingles that many texts have, from a part of them."""

    def run(batches):
        for batch in batches:
            for raw in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(raw.as_py()).view(np.int64))], names=["shingle"])

    texts = _coded(docs).where(F.pmod(F.xxhash64("code"), F.lit(SAMPLED)) == 0).select("raw", "code")
    counts = texts.dropDuplicates(["code"]).select("raw").mapInArrow(run, "shingle long").groupBy("shingle").count()
    most = counts.where(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "shingle").limit(LATE)
    late = settle(most.select("shingle"), "late").toArrow().column(0).to_numpy()
    return np.sort(late.astype(np.int64).view(np.uint64))


def prefixed(docs):
    """``shingle``, ``code``, ``n`` (shingles of the text), ``place`` (in their order) of the
    shingles of every text's prefix that another text's prefix has as well.

    ``n2``, ``place2`` and ``code2`` are those of a neighbour in the bucket, in one of four orders.
    """
    late = frequent(docs)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingle_set(raw.as_py()) for raw in part.column(1)]
                firsts = [prefix(s, late) for s in sets]
                lengths = np.fromiter(map(len, firsts), np.int64, len(firsts))
                place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                n = np.repeat(np.fromiter(map(len, sets), np.int64, len(sets)), lengths)
                code = part.column(0).take(pa.array(np.repeat(np.arange(len(sets)), lengths)))
                shingle = np.concatenate(firsts).view(np.int64)
                columns = [pa.array(shingle), code, pa.array(n, pa.int32()), pa.array(place, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["shingle", "code", "n", "place"])

    rows = _coded(docs).select("code", "raw").mapInArrow(run, "shingle long, code long, n int, place int")
    # Both steps after it find the rows of a shingle together.
    rows = rows.repartition("shingle").dropDuplicates(["shingle", "code"])
    order = Window.partitionBy("shingle").orderBy(F.xxhash64("code", F.pmod("shingle", F.lit(4))), "code")
    beside = [F.lag(c).over(order).alias(f"{c}2") for c in ("code", "n", "place")]
    rows = rows.select("*", *beside, F.lead("code").over(order).alias("after"))
    return rows.where("code2 is not null or after is not null").drop("after")


def _room(n, n2, place, place2, least, least2):
    """Whether sets may be similar that first meet at these places of their order."""
    both = F.least(F.col(n) - F.col(place), F.col(n2) - F.col(place2))
    return both * (1 + SIMILAR) >= (F.col(least) + F.col(least2)) * SIMILAR - 1e-6


def beside(buckets):
    """Pairs (a, b) of neighbours in the buckets of ``prefixed``."""
    return buckets.where(_room("n", "n2", "place", "place2", "n", "n2")).select(*_least_first("code", "code2"))


def _mixed(buckets, found):
    """Rows of the buckets that several groups (``part``) share; settled.

    If there are too many groups to be broadcast, the buckets are shuffled twice; then a part of
    them goes at a time.
    """
    groups = found.withColumnRenamed("node", "code")
    cuts = 1 if measured_bytes(groups) <= BROADCAST_LIMIT else CUTS
    whole = Window.partitionBy("shingle")

    def shared(rows):
        rows = join_side(rows, groups, ["code"], "left")
        rows = rows.withColumn("part", F.coalesce("component", "code")).drop("component")
        rows = rows.withColumn("lo", F.min("part").over(whole)).withColumn("hi", F.max("part").over(whole))
        return rows.where("lo < hi").drop("lo", "hi")

    rows = buckets.select("shingle", "code", "n", "place")
    at = F.pmod(F.xxhash64("shingle"), F.lit(cuts))
    parts = [rows.where(at == i) if cuts > 1 else rows for i in range(cuts)]
    return reduce(DataFrame.unionByName, [tidied(rows.sparkSession, lambda: shared(x), "mixed") for x in parts])  # noqa: B023


def _meeting(rows, some):
    """Pairs of ``some`` of the rows that share a bucket, of two groups that may hold a link there.

    Groups meet first and their texts then, so the texts of one group are never paired.
    """
    parts = rows.groupBy("shingle", "part").agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.min("place").alias("place")
    )
    x, y = (parts.select("shingle", *[F.col(c).alias(c + i) for c in ("part", "least", "most", "place")]) for i in "12")
    met = x.join(y, "shingle").where("part1 < part2")
    met = met.where(_room("most1", "most2", "place1", "place2", "least1", "least2")).select("shingle", "part1", "part2")
    x, y = (some.select("shingle", *[F.col(c).alias(c + i) for c in ("part", "code", "n", "place")]) for i in "12")
    pairs = met.join(x, ["shingle", "part1"]).join(y, ["shingle", "part2"])
    return pairs.where(_room("n1", "n2", "place1", "place2", "n1", "n2"))


def nearest(buckets, found):
    """For every two groups that share a bucket, at most ``TRIED`` pairs (a, b) of their texts.

    A bucket gives those texts of a group that have least before the shingle, and of all these
    pairs the ones go first that leave most room for shared shingles. They decide which pairs
    are left for ``apart`` and not which links are found.
    """
    rows = _mixed(buckets, found)
    early = Window.partitionBy("shingle", "part").orderBy(F.try_divide("place", "n"), "code")
    first = rows.withColumn("nth", F.row_number().over(early)).where(F.col("nth") <= LEADING)
    room = F.try_divide(F.expr("n1 - place1 + n2 - place2"), F.expr("n1 + n2"))
    pairs = _meeting(rows, first).groupBy("part1", "part2", *_least_first("code1", "code2"))
    pairs = pairs.agg(F.max(room).alias("room"), F.count("*").alias("shared"))
    best = Window.partitionBy("part1", "part2").orderBy(F.desc("room"), F.desc("shared"), "a", "b")
    return pairs.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= TRIED).select("a", "b")


def apart(buckets, found):
    """All pairs (a, b) that share a bucket and lie in different groups (``node``, ``component``)."""
    rows = _mixed(buckets, found)
    return _meeting(rows, rows).select(*_least_first("code1", "code2")).distinct()


def likely(sketches, pairs):
    """``a``, ``b``, ``size`` (bytes of both texts) of the pairs that may be similar by their sketches."""

    def run(batches):
        for batch in batches:
            sides = zip(*batch.columns[3:], strict=True)
            keep = pa.array([may_be_similar(*(v.as_py() for v in side)) for side in sides], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in range(3)], names=["a", "b", "size"])

    of = lambda end, i: sketches.select(F.col("code").alias(end), *[F.col(c).alias(c + i) for c in ("n", "size", "sketch")])
    wide = pairs.join(of("a", "1").hint("merge"), "a").join(of("b", "2").hint("merge"), "b")
    wide = wide.select("a", "b", F.expr("size1 + size2").alias("size"), "sketch1", "sketch2", "n1", "n2")
    return wide.mapInArrow(run, "a long, b long, size long")


def _texts_of(docs, pairs):
    """``code``, ``raw`` of the texts of the pairs, each once."""
    used = settle(pairs.select(F.col("a").alias("code")).union(pairs.select("b")).distinct(), "used")
    texts = _coded(docs).select("code", "raw")
    if measured_bytes(used) <= BROADCAST_LIMIT:
        return texts.join(F.broadcast(used), "code", "left_semi").dropDuplicates(["code"])
    # The texts are shuffled once: a task sends each one once, so none is hot.
    return texts.dropDuplicates(["code"]).join(used.hint("merge"), "code", "left_semi")


def verified(texts, pairs):
    """The pairs (a, b) whose ``texts`` have a similarity of ``SIMILAR`` or more.

    The pairs are sent to every task, so there should be no more than ``SENT``.
    """

    def run(batches):
        for batch in batches:
            # One pair of texts at a time leaves Arrow's buffers.
            sides = zip(batch.column(2), batch.column(3), strict=True)
            keep = [similar(shingle_set(x.as_py()), shingle_set(y.as_py())) for x, y in sides]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], names=["a", "b"]
            )

    pairs = F.broadcast(pairs.select("a", "b"))
    left, right = (
        texts.select(F.col("code").alias(end), F.col("raw").alias(raw)).join(pairs, end).select("a", "b", raw)
        for end, raw in (("a", "x"), ("b", "y"))
    )
    return left.join(right.hint("merge"), ["a", "b"]).select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _volume(pairs):
    """Number of pairs and bytes of their texts."""
    row = pairs.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    return row["n"], row["size"]


def _between(pairs, found):
    """The pairs whose groups (``p``, ``q``) are different ones."""
    for end, part in ("a", "p"), ("b", "q"):
        groups = found.select(F.col("node").alias(end), F.col("component").alias(part))
        pairs = join_side(pairs, groups, [end], "left").withColumn(part, F.coalesce(part, end))
    return pairs.where("p <> q").select("a", "b", "size", "p", "q")


def _chosen(pairs, size, most):
    """One pair of every group with the least group beside it; others if these are few."""
    ends = [F.struct(F.col(own).alias("own"), F.col(other).alias("other")) for own, other in ("pq", "qp")]
    ends = pairs.select("a", "b", "size", F.explode(F.array(*ends)).alias("end"))
    first = ends.groupBy("end.own").agg(F.min(F.struct("end.other", "a", "b", "size")).alias("pair"))
    first = settle(first.select("pair.a", "pair.b", "pair.size").distinct(), "first")
    taken = _volume(first)[1]
    if 2 * taken >= most:
        return first
    share = int(1000 * (most - taken) / max(1, size - taken)) + 1
    more = pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(1000)) < share).select("a", "b", "size")
    return first.unionByName(more).distinct()


def joined(docs, sketches, pairs, found):
    """``found`` (``node``, ``component``) and what pairs (a, b) of similar texts link besides.

    At most a share of all texts is joined to pairs at a time. Every round takes at least a half of
    that, and pairs that it leaves in one group need not be verified.
    """
    spark = docs.sparkSession
    rest = tidied(spark, lambda: likely(sketches, pairs), "near")
    texts, most, labelled = None, max(BATCH, _volume(sketches)[1] // SHARE), False
    while True:
        n, size = _volume(rest)
        if not n:
            return found
        last = size <= most and n <= SENT
        if not last and not labelled:
            rest, labelled = tidied(spark, lambda: _between(rest, found), "rest"), True  # noqa: B023
            continue
        if texts is None:
            texts = tidied(spark, lambda: _texts_of(docs, rest), "texts")  # noqa: B023
        batch = rest if last else tidied(spark, lambda: _chosen(rest, size, most), "batch")  # noqa: B023
        n, size = (n, size) if last else _volume(batch)
        cuts = max(1, ceil(size / most), ceil(n / SENT))
        links = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
        for i in range(cuts):
            cut = batch if cuts == 1 else batch.where(F.pmod(F.xxhash64("b", "a"), F.lit(cuts)) == i)
            links = links.unionByName(tidied(spark, lambda: verified(texts, cut), "verified"))  # noqa: B023
        found = tidied(spark, lambda: components(links, "a", "b"), "groups")  # noqa: B023
        if last:
            return found
        left = rest.select("a", "b", "size").join(batch.select("a", "b"), ["a", "b"], "left_anti")
        rest = tidied(spark, lambda: _between(left, found), "rest")  # noqa: B023


def similar_groups(docs):
    """``doc_id``, ``component_id`` (least id of its group) of every row that has an id."""
    spark = docs.sparkSession
    own = settle(printed(docs), "printed")
    sketches = tidied(spark, lambda: own.select("code", "n", "size", "sketch").dropDuplicates(["code"]), "sketches")
    buckets = tidied(spark, lambda: prefixed(docs), "prefixed")
    # What the proposals were made of goes before the buckets give theirs.
    pairs = tidied(spark, lambda: proposed(own).select(*_least_first("a", "b")), "proposed")
    pairs = tidied(spark, lambda: pairs.unionByName(beside(buckets)).distinct(), "pairs")
    ids = own.select("doc_id", "code").distinct()
    # An id that has several texts ties the groups of these texts together.
    again = ids.groupBy("doc_id").agg(F.min("code").alias("a"), F.max("code").alias("z")).where("a <> z")
    tied = ids.join(again, "doc_id").select("a", F.col("code").alias("b"))
    found = tidied(spark, lambda: components(tied, "a", "b"), "groups")
    found = tidied(spark, lambda: joined(docs, sketches, pairs, found), "groups")
    tried = pairs
    for step in nearest, apart:
        rest = tidied(spark, lambda: step(buckets, found).join(tried, ["a", "b"], "left_anti"), "rest")  # noqa: B023
        found = tidied(spark, lambda: joined(docs, sketches, rest, found), "groups")  # noqa: B023
        tried = tried.unionByName(rest)
    named = ids.join(found.withColumnRenamed("node", "code"), "code", "left")
    named = named.select("doc_id", F.coalesce("component", "code").alias("component"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return join_side(named, settle(least, "least"), ["component"]).select("doc_id", "component_id")


def keep_one(docs):
    """``docs`` with one document of each group, the one of least id.

    Rows without an id stay, as nothing names them. Repeated rows of a kept id stay
    as they are one document. What is written on the way is deleted.
    """
    spark = docs.sparkSession
    with batches_of(spark, ROWS):
        gone = tidied(
            spark,
            lambda: similar_groups(docs).where("doc_id <> component_id").select("doc_id").distinct(),
            "gone",
        )
    # The columns of the table stay in one, so that none has the name of a helper.
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("doc_id"))
    return join_side(rows, gone, ["doc_id"], "left_anti").select("row.*")
