"""Document fingerprints: a homomorphic multiset hash over paragraphs.

Every paragraph (line) of a text is hashed to a wide vector, and the fingerprint is the
sum of these vectors, lane by lane, modulo a power of two. So it doesn't depend on the
order of paragraphs, and a paragraph is inserted or deleted by adding or subtracting its
own fingerprint (``combine``). A vector has three parts:

* 16 lanes of 32 bits cut from the SHA-512 of the paragraph: equality,
* one lane of 32 bits that counts the word pairs of the paragraph (one word: itself),
* 64 lanes of 32 bits; lane i counts the word pairs of the paragraph whose hash has
  bit i set: likeness.

With the count, a likeness lane is a sum of random signs. Its mean square is an unbiased
estimate of the squared norm of the text's word-pair counts, and so it is for the
difference of two fingerprints (relative standard error about 18 %). Likeness is one
minus the squared distance over the sum of both squared norms, kept in 0 to 1; 1 for
equal fingerprints. For texts without repeats that is the share of common word pairs.

Column expressions only. Texts are shuffled once, into ranges of ids, where each row also
sees the next text; the words are then exploded and summed in the same task.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from contrast.llm.common import whole_texts

PARAGRAPH = "\n"
EQUALITY = 16
LIKENESS = 64
LANE = 0xFFFFFFFF
_PAIR = 0x0000000100000001
_LEAST = -(1 << 63)


def _equality_lanes(text):
    """Sums of the SHA-512 lanes of all paragraphs, modulo 2**32."""
    digests = F.transform(F.split(text, PARAGRAPH, -1), lambda p: F.sha2(p, 512))

    def lanes(digest):
        return [
            F.conv(F.substr(digest, F.lit(8 * i + 1), F.lit(8)), 16, 10).cast("long")
            for i in range(EQUALITY)
        ]

    def add(acc, digest):
        return F.struct(
            *[
                (acc[f"e{i}"] + lane).bitwiseAND(F.lit(LANE)).alias(f"e{i}")
                for i, lane in enumerate(lanes(digest))
            ]
        )

    zero = F.struct(*[F.lit(0).cast("long").alias(f"e{i}") for i in range(EQUALITY)])
    return F.aggregate(digests, zero, add)


def _pair_hashes(text):
    """Hashes of neighbouring words within each paragraph; one word stands alone."""

    def of(words):
        return F.when(F.size(words) == 1, F.array(F.xxhash64(words[0]))).otherwise(
            F.transform(
                F.slice(words, 1, F.size(words) - 1),
                lambda w, i: F.xxhash64(w, F.get(words, i + 1)),
            )
        )

    # Words are bound once per paragraph, before they are looked up by place.
    words = F.transform(F.split(text, PARAGRAPH, -1), lambda p: F.split(p, " ", -1))
    return F.flatten(F.transform(words, of))


def _hex(lane):
    return F.lower(F.lpad(F.hex(lane), 8, "0"))


def sums(texts, text, *keys):
    """``keys``, ``equal`` (struct), ``n`` and ``h0..h31``: the summed vectors per row.

    ``keys`` must identify a row. ``h{j}`` holds likeness lane j in its low and lane
    j + 32 in its high half.
    """
    # The equality lanes come first, or they would be computed for every word pair.
    equal = texts.select(*keys, F.col(text).alias("_text"), _equality_lanes(F.col(text)).alias("equal"))
    each = equal.select(*keys, "equal", F.explode(_pair_hashes(F.col("_text"))).alias("h"))
    return each.groupBy(*keys, "equal").agg(
        F.count("*").alias("n"),
        *[
            F.sum(F.shiftright("h", j).bitwiseAND(F.lit(_PAIR))).alias(f"h{j}")
            for j in range(LIKENESS // 2)
        ],
    )


def _lanes():
    low = [F.col(f"h{j}").bitwiseAND(F.lit(LANE)) for j in range(LIKENESS // 2)]
    high = [F.shiftrightunsigned(f"h{j}", 32) for j in range(LIKENESS // 2)]
    return low + high


def lanes_array():
    """All lanes of a row of ``sums`` as one array: equality, count, likeness."""
    equal = [F.col("equal")[f"e{i}"] for i in range(EQUALITY)]
    return F.array(*equal, F.col("n").bitwiseAND(F.lit(LANE)), *_lanes())


def to_hex(lanes):
    return F.array_join(F.transform(lanes, _hex), "")


def from_hex(fingerprint):
    """The lanes of a fingerprint string."""
    at = F.sequence(F.lit(0), F.lit(EQUALITY + LIKENESS))
    return F.transform(
        at, lambda i: F.conv(F.substr(fingerprint, i * 8 + 1, F.lit(8)), 16, 10).cast("long")
    )


def combine(a, b, sign=1):
    """Fingerprint of two texts' paragraphs together (sign 1), or of a without b (-1)."""
    return to_hex(
        F.zip_with(
            from_hex(a), from_hex(b), lambda x, y: (x + sign * y).bitwiseAND(F.lit(LANE))
        )
    )


def likeness(a, b):
    """Likeness (0 to 1) of two arrays of lanes."""

    def signs(lanes):
        n = F.get(lanes, F.lit(EQUALITY))
        return F.transform(F.slice(lanes, EQUALITY + 2, LIKENESS), lambda bits: 2.0 * bits - n)

    def square(values):
        return F.aggregate(values, F.lit(0.0), lambda s, v: s + v * v)

    x, y = signs(a), signs(b)
    both = square(x) + square(y)
    apart = square(F.zip_with(x, y, lambda u, v: u - v))
    return F.when(a == b, F.lit(1.0)).otherwise(
        F.coalesce(
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - apart / F.nullif(both, F.lit(0.0)))),
            F.lit(0.0),
        )
    )


def fingerprints(docs, text="text"):
    """``doc_id``, ``fingerprint`` of every whole text (null: empty).

    Rows that repeat an id and a text have one result row; equal paragraphs in another
    order give the same fingerprint.
    """
    return sums(whole_texts(docs), text, "doc_id", "text").select(
        "doc_id", to_hex(lanes_array()).alias("fingerprint")
    )


def _in_ranges(texts):
    """Rows in ranges of ids (``bucket``), and the first row of the range below each.

    Only the bounds of the ranges, as many as there are shuffle partitions times four,
    are in the driver. The copied rows are marked ``extra`` and sort last.
    """
    spark = texts.sparkSession
    key = F.coalesce("doc_id", F.lit(_LEAST)).alias("key")
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = texts.select("*", key)
    cuts = keyed.agg(F.percentile_approx("key", [i / n for i in range(1, n)], 100 * n)).first()[0]
    cuts = sorted(set(cuts or []))
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    placed = keyed.withColumn("bucket", F.size(F.filter(bounds, lambda b: b < F.col("key"))))
    tops = dict(placed.groupBy("bucket").agg(F.max("key")).collect())
    order = sorted(tops, reverse=True)
    above = {low: high for high, low in zip(order, order[1:], strict=False)}
    if order:
        above[order[0]] = order[-1]
    target = F.array(*[F.lit(above.get(b, 0)) for b in range(len(cuts) + 1)])
    copies = placed.where(F.col("key").isin(list(tops.values()))).withColumn(
        "bucket", F.get(target, F.col("bucket"))
    )
    return placed.withColumn("extra", F.lit(0)).unionByName(copies.withColumn("extra", F.lit(1)))


def fingerprint_report(docs):
    """Fingerprints of every text and of its edited text, and their likeness.

    The next document is the one of the next smaller id; documents without an id come
    last, in the order of their texts, as do the texts of a repeated id.
    """
    order = Window.partitionBy("bucket").orderBy("extra", F.col("key").desc(), "text")
    n_chars = F.char_length("text")
    k = F.floor(n_chars / 3).cast("int")
    rows = (
        _in_ranges(whole_texts(docs))
        .select(
            "*",
            F.row_number().over(order).alias("row"),
            F.lead("text").over(order).alias("after"),
        )
        .select(
            "bucket",
            "row",
            "extra",
            "doc_id",
            n_chars.cast("long").alias("n_chars"),
            "text",
            F.concat(
                F.substr("text", F.lit(1), n_chars - k), F.substr(F.coalesce("after", F.lit("")), F.lit(1), k)
            ).alias("edited"),
        )
        .withColumn("edited_sha256", F.sha2("edited", 256))
    )
    both = rows.select(
        "bucket",
        "row",
        "extra",
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("which"), F.col("text").alias("version")),
                F.struct(F.lit(1).alias("which"), F.col("edited").alias("version")),
            )
        ).alias("v"),
    ).select("*", "v.which", "v.version")
    keys = ("bucket", "row", "extra", "doc_id", "n_chars", "edited_sha256", "which")
    vectors = sums(both, "version", *keys).select(*keys, lanes_array().alias("lanes"))
    # Both versions of a row and the own version of the next one are neighbours.
    line = Window.partitionBy("bucket").orderBy("row", F.col("which").desc())
    seen = vectors.select(
        "*", F.lag("lanes").over(line).alias("edited"), F.lead("lanes", 2).over(line).alias("next")
    ).where("which = 0 and extra = 0")
    return seen.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        to_hex("lanes").alias("fingerprint"),
        to_hex("edited").alias("edited_fingerprint"),
        likeness(F.col("lanes"), F.col("edited")).alias("near_edited"),
        likeness(F.col("lanes"), F.col("next")).alias("near_next"),
    )
