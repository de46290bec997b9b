"""Quality classifier by importance resampling.

A text is a bag of hashed n-grams: words and word pairs, and pairs and triples of word
shapes (case, marks, whether a word repeats the one before). Two generative models count
them: one over the labelled documents of good quality (target), one over all documents
(raw). The importance of a document is the log ratio of its probability under both: the
sum of the log ratios of its n-grams. Its log weight is the importance over the root of
the number of n-grams: they overlap, so a sum counts the evidence of long texts too often.

Gumbel top-k draws ``k`` documents without replacement in proportion to these weights:
noise from a hash of the row is added to the log weight over the temperature, and the k
largest stay, by a distributed rank. Labels of bad quality have no part in the weights.
They only set ``k``, where none is given: a logistic curve through the log weights of the
labelled rows tells how many documents of the table are likelier good than not.

The models are two arrays of fixed length. Target and curve use at most ``LABELLED``
labelled rows, taken by hash; the raw model counts every document.

A null text counts as empty. A text without words has no n-grams, and importance and log
weight 0. Long texts are read in blocks of tokens, and n-grams run on from one to the
next. Rows are judged one by one, also those that share an id or have none; equal rows
share their fate up to ties at the end of the k, where all rows of equal noise and id are
in the order of their texts' hashes. Without labels, or with good ones only, all stay.
"""

import re
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from contrast.llm.common import settle, whole_texts
from contrast.plans.ordered import place, rank

BUCKETS = 1 << 14
LABELLED = 20_000
TEMPERATURE = 1.0
SEED = 7
SMOOTHING = 1.0
MEMO = 300_000
BATCH = 512
LONG_TEXT = 1 << 20
TOKENS = 1 << 18

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_MARKS = 8


def _shape(token):
    """A small number: kind of word, or the first mark and whether it is repeated."""
    if token[0].isalnum() or token[0] == "_":
        if token.isdigit():
            return 1
        if token.islower():
            return 2
        if len(token) > 1 and token.isupper():
            return 3
        return 4 if token[0].isupper() else 5
    return _MARKS + (ord(token[0]) % 64) * 4 + min(len(token), 4) - 1


class _Words(dict):
    """Hash (32 bits) and shape of words, in a table of bounded size."""

    def __missing__(self, token):
        if len(self) >= MEMO:
            self.clear()
        value = zlib.crc32(token.lower().encode("utf-8", "replace")) | _shape(token) << 32
        self[token] = value
        return value


# Emptied at the end of a task, as an idle worker keeps its memory.
_words = _Words()


def _mixed(kind, *parts):
    h = np.zeros(len(parts[0]), np.uint64)
    for part in (np.full(len(parts[0]), kind, np.uint64), *parts):
        h = (h ^ part) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return ((h >> np.uint64(20)) % np.uint64(BUCKETS)).astype(np.int64)


def _token_blocks(text):
    """Lists of tokens: one, or several of bounded length if the text is long."""
    if len(text) <= LONG_TEXT:
        yield _TOKEN.findall(text)
        return
    found = (match.group() for match in _TOKEN.finditer(text))
    while block := list(islice(found, TOKENS)):
        yield block


def ngrams(text):
    """Buckets of the n-grams of a text, as an array."""
    out = [np.zeros(0, np.int64)]
    words = shapes = np.zeros(0, np.uint64)
    for block in _token_blocks(text):
        # The last two tokens before the block, whose own n-grams are out already.
        words, shapes = words[-2:], shapes[-2:]
        at = len(words)
        codes = np.fromiter(map(_words.__getitem__, block), np.uint64, len(block))
        words = np.concatenate([words, codes & np.uint64(0xFFFFFFFF)])
        same = np.zeros(len(words), np.uint64)
        same[1:] = words[1:] == words[:-1]
        shapes = np.concatenate([shapes, (codes >> np.uint64(32)) * np.uint64(2) + same[at:]])
        out.append(_mixed(1, words[at:]))
        two, three = max(at, 1), max(at, 2)
        if len(words) > 1:
            out.append(_mixed(2, words[two - 1 : -1], words[two:]))
            out.append(_mixed(3, shapes[two - 1 : -1], shapes[two:]))
        if len(words) > 2:
            out.append(_mixed(4, shapes[three - 2 : -2], shapes[three - 1 : -1], shapes[three:]))
    return np.concatenate(out)


# --- models -----------------------------------------------------------------------


def labelled_sample(labels, column="quality", limit=LABELLED):
    """At most ``limit`` rows (doc_id, label), the ones of least hash; one for each id."""
    rows = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
        .where("doc_id is not null and label is not null")
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    return rows.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(limit)


def _marked(docs, sample):
    """Whole texts with the label of the sample (null: none); the sample is bounded."""
    return whole_texts(docs).join(F.broadcast(sample), "doc_id", "left")


def count_ngrams(marked):
    """``bucket``, ``raw``, ``target``: counts over all texts and over good ones."""

    def run(batches):
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                label = part.column(2).fill_null(-1).to_numpy(zero_copy_only=False)
                grams = [ngrams(text) for text in part.column(1).to_pylist()]
                raw += np.bincount(np.concatenate(grams), minlength=BUCKETS)
                for row in np.flatnonzero(label == 1):
                    target += np.bincount(grams[row], minlength=BUCKETS)
        _words.clear()
        bucket = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket), pa.array(raw[bucket]), pa.array(target[bucket])],
            names=["bucket", "raw", "target"],
        )

    each = marked.select("doc_id", "text", "label").mapInArrow(
        run, "bucket long, raw long, target long"
    )
    return each.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts):
    """Log of target over raw probability by bucket; the table has ``BUCKETS`` rows."""
    raw, target = np.full(BUCKETS, SMOOTHING), np.full(BUCKETS, SMOOTHING)
    for row in counts.collect():
        raw[row["bucket"]] += row["raw"]
        target[row["bucket"]] += row["target"]
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def importances(marked, ratios):
    """``doc_id``, ``text_hash``, ``label``, ``importance``, ``log_weight`` of every row."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                grams = [ngrams(text) for text in part.column(1).to_pylist()]
                sums = np.array([ratios[g].sum() for g in grams])
                sizes = np.array([max(len(g), 1) for g in grams])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(3),
                        part.column(2),
                        pa.array(sums),
                        pa.array(sums / np.sqrt(sizes)),
                    ],
                    names=["doc_id", "text_hash", "label", "importance", "log_weight"],
                )
        _words.clear()

    return marked.select("doc_id", "text", "label", F.xxhash64("text").alias("text_hash")).mapInArrow(
        run, "doc_id long, text_hash long, label int, importance double, log_weight double"
    )


def logistic_curve(x, y, steps=200, decay=1e-3):
    """(slope, offset) of the log-odds of y over x, each class with half the weight.

    ``decay`` keeps the slope finite if x parts the classes. With labels of one class
    only, or none, every row is as likely to be good: (0, large).
    """
    if len(set(y)) < 2:
        return 0.0, 30.0 if not len(y) or y[0] == 1 else 0.0
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    scale = x.std() or 1.0
    z = np.stack([x / scale, np.ones(len(x))], axis=1)
    theta = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ theta, -500, 500)))
        gradient = z.T @ (weight * (p - y)) + decay * np.array([theta[0], 0])
        hessian = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag([decay, 1e-9])
        step = np.linalg.solve(hessian, gradient)
        theta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0] / scale), float(theta[1])


def likely_good(scored):
    """How many of the scored rows are likelier good than not, by the labelled ones."""
    # At most one row per sampled id, unless ids repeat; then any of them will do.
    seen = (
        scored.where("label is not null")
        .groupBy("doc_id")
        .agg(F.min(F.struct("text_hash", "log_weight", "label")).alias("r"))
        .select("r.log_weight", "r.label")
        .collect()
    )
    x = np.array([row[0] for row in seen], float)
    y = np.array([row[1] == 1 for row in seen], float)
    order = np.lexsort((y, x))
    slope, offset = logistic_curve(x[order], y[order])
    return scored.where(F.col("log_weight") * slope + offset > 0).count()


def resample(docs, labels, temperature=TEMPERATURE, k=None):
    """``doc_id``, ``text_hash``, ``importance``, ``log_weight``, ``key``, ``kept`` of every row.

    The ``k`` rows of largest key stay; by default as many as are likely to be good.
    """
    sample = settle(labelled_sample(labels), "labelled")
    marked = _marked(docs, sample)
    ratios = log_ratios(count_ngrams(marked))
    scored = settle(importances(marked, ratios), "importance")
    k = likely_good(scored) if k is None else k
    noise = (F.shiftrightunsigned(F.xxhash64("doc_id", "text_hash", F.lit(SEED)), 11) + 0.5) / float(1 << 53)
    keyed = scored.drop("label").withColumn("key", F.col("log_weight") / temperature - F.log(-F.log(noise)))
    order = [F.col("key").desc(), F.col("doc_id"), F.col("text_hash")]
    ranked = rank(place(keyed, [], order), [], order)
    return ranked.select(
        "doc_id", "text_hash", "importance", "log_weight", "key", (F.col("rank") <= k).alias("kept")
    )


def quality_report(docs, labels):
    return resample(docs, labels).select("doc_id", "importance", "log_weight", "kept")


def keep_good(docs, labels, temperature=TEMPERATURE):
    """``docs`` without the rows that the resampling leaves out."""
    gone = (
        resample(docs, labels, temperature)
        .where("not kept")
        .select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"))
        .distinct()
    )
    text = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    same = (text == gone["gone_hash"]) & docs["doc_id"].cast("long").eqNullSafe(gone["gone_id"])
    return docs.join(gone, same, "left_anti")
