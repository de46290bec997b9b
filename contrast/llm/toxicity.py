"""Toxicity: bags of subwords, embedded, averaged and classified by a linear softmax.

A word is the mean of the vectors of its character n-grams (3 to 5, with marks for its
ends) and of the word itself. A text is the mean of its distinct words and of ``PADDING``
zero vectors, so that a text of few words is no stronger evidence than a long one.
Embeddings and softmax are trained jointly, in numpy, by full-batch Adam; after each step
the rows of the embedding shrink by a fixed length, which sets n-grams that no class needs
to zero. Misspellings and unseen forms of a word share most n-grams with it and so its
vectors. A logistic curve through the training rows, shifted to the share of toxic labels,
makes scores of the softmax's log-odds.

The forward pass sums a text's n-grams as one sparse row. With two classes only the
difference of the softmax's columns matters, so a step costs one pass over the non-zero
cells and not one for each dimension.

Training uses at most ``LABELLED`` labelled rows of each class, taken by hash, whose
texts are counted on the executors; a sparse row has at most ``BUCKETS`` cells. Every text
is scored whole. Labels, language, source and id are no inputs of a score; the id only
decides which rows are held out. Null texts count as empty; a text without words has the
score of the bias alone. Rows that share an id are scored one by one; a row without an
id is not held out. Without labels of both classes every score is 1 if all are toxic,
else 0.
"""

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from contrast.llm.common import settle, whole_texts
from contrast.llm.quality import logistic_curve

BUCKETS = 1 << 17
DIMENSIONS = 8
LABELLED = 1_500
PADDING = 50
EPOCHS = 60
RATE = 1.0
SOFTMAX_RATE = 0.1
# Gradients below this size move a weight less than in full steps.
FLOOR = 1e-4
SHRINK = 0.1
SEED = 5
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
MEMO = 300_000
BATCH = 512
LONG_TEXT = 1 << 20

_WORD = re.compile(r"\w+")
_SPACE = re.compile(r"\s")


def subwords(word):
    """Buckets of the n-grams of a lower-case word, and of the word itself."""
    marked = f"<{word}>"
    grams = [marked]
    grams += [marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1) if n < len(marked)]
    return [zlib.crc32(g.encode("utf-8", "replace")) & (BUCKETS - 1) for g in grams]


class _Memo(dict):
    """A function of words, remembered in a table of bounded size."""

    def __init__(self, function):
        super().__init__()
        self.function = function

    def __missing__(self, word):
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = self.function(word)
        return value


def words_of(text):
    """Lower-case words, a block of the text at a time; blocks end at white space."""
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > LONG_TEXT:
            space = _SPACE.search(text, at + LONG_TEXT)
            end = space.start() if space else end
        yield _WORD.findall(text[at:end].lower())
        at = end


def distinct_words(text):
    words = set()
    for block in words_of(text):
        words.update(block)
    return words


def sparse_row(text, memo):
    """(buckets, weights) of a text; with the padding the weights add up to one."""
    words = distinct_words(text)
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    grams = [memo[word] for word in words]
    lengths = np.fromiter(map(len, grams), np.int64, len(grams))
    bucket, where = np.unique(np.concatenate(grams), return_inverse=True)
    row = np.bincount(where, weights=np.repeat(1.0 / lengths, lengths))
    return bucket.astype(np.int32), (row / (len(words) + PADDING)).astype(np.float32)


class Model:
    """Weight of every bucket (embedding times softmax difference), and the score's curve."""

    def __init__(self, weights, slope, offset):
        self.weights, self.slope, self.offset = weights, slope, offset

    def memo(self):
        """Weights of words, remembered."""
        weights = self.weights
        return _Memo(lambda word: float(weights[subwords(word)].mean()))

    def score(self, text, memo):
        # Sorted, so that the sum doesn't depend on the order of a set.
        words = sorted(distinct_words(text))
        mean = sum(map(memo.__getitem__, words)) / (len(words) + PADDING)
        z = min(max(self.slope * mean + self.offset, -60.0), 60.0)
        return float(1 / (1 + np.exp(-z)))


def _adam(state, gradient, t):
    m, v = state
    m *= 0.9
    m += 0.1 * gradient
    v *= 0.999
    v += 0.001 * gradient * gradient
    return (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + FLOOR)


def _chance(z):
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def train(rows, labels, share=None, epochs=EPOCHS):
    """Model of sparse rows [(buckets, weights)] and labels 0/1.

    ``share`` is the share of toxic rows that scores are meant for (none: of ``labels``).
    """
    y = np.asarray(labels, float)
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS), 0.0, 60.0 if y.any() else -60.0)
    lengths = np.array([len(b) for b, _ in rows])
    doc = np.repeat(np.arange(len(rows)), lengths)
    bucket = np.concatenate([b for b, _ in rows]).astype(np.int64)
    cell = np.concatenate([w for _, w in rows]).astype(float)
    each = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    rng = np.random.default_rng(SEED)
    embedding = rng.normal(0, 0.01, (BUCKETS, DIMENSIONS))
    softmax = rng.normal(0, 1, DIMENSIONS)
    bias = np.zeros(1)
    states = [[np.zeros_like(p), np.zeros_like(p)] for p in (embedding, softmax, bias)]

    def forward():
        weights = embedding @ softmax
        return np.bincount(doc, weights=cell * weights[bucket], minlength=len(rows)) + bias[0]

    for t in range(1, epochs + 1):
        error = each * (_chance(forward()) - y)
        pull = np.bincount(bucket, weights=cell * error[doc], minlength=BUCKETS)
        by_embedding = _adam(states[0], pull[:, None] * softmax, t)
        by_softmax = _adam(states[1], embedding.T @ pull, t)
        bias -= RATE * _adam(states[2], np.array([error.sum()]), t)
        embedding -= RATE * by_embedding
        softmax -= SOFTMAX_RATE * by_softmax
        length = np.sqrt((embedding * embedding).sum(axis=1))
        embedding *= np.maximum(0, 1 - SHRINK / np.maximum(length, 1e-12))[:, None]
    slope, offset = logistic_curve(forward(), y)
    share = min(max(y.mean() if share is None else share, 1e-3), 1 - 1e-3)
    offset += np.log(share / (1 - share))
    return Model(embedding @ softmax, slope, slope * bias[0] + offset)


# --- on Spark ---------------------------------------------------------------------


def held_out(doc_id):
    """Whether a row is kept from training, by the CRC-32 of its id as text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % FOLDS == HELD_OUT


def training_sample(labels, limit=LABELLED):
    """(rows, share): at most ``limit`` rows of each class, of least hash, and the share
    of toxic labels, both without held-out rows."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id is not null and toxic is not null")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    share = known.agg(F.avg("toxic")).first()[0]
    order = (F.xxhash64("doc_id", F.lit(SEED)), "doc_id")
    parts = [known.where(F.col("toxic") == c).orderBy(*order).limit(limit) for c in (0, 1)]
    return parts[0].unionByName(parts[1]), share


def fit(docs, labels, limit=LABELLED):
    """Train on a bounded sample of labelled rows; the sample's ids are broadcast."""
    sample, share = training_sample(labels, limit)
    sample = settle(sample, "toxic-sample")

    def run(batches):
        memo = _Memo(lambda word: np.array(subwords(word)))
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                rows = [sparse_row(text, memo) for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(2),
                        pa.array([b for b, _ in rows], pa.list_(pa.int32())),
                        pa.array([w for _, w in rows], pa.list_(pa.float32())),
                    ],
                    names=["doc_id", "toxic", "buckets", "weights"],
                )

    counted = (
        whole_texts(docs)
        .join(F.broadcast(sample), "doc_id")
        .mapInArrow(run, "doc_id long, toxic int, buckets array<int>, weights array<float>")
    )
    # One row of each id; an id that repeats gives the row of its least buckets.
    table = settle(counted, "toxic-rows").dropDuplicates(["doc_id"]).orderBy("doc_id").toArrow()
    rows = list(
        zip(
            (b.values.to_numpy() for b in table["buckets"]),
            (w.values.to_numpy() for w in table["weights"]),
            strict=True,
        )
    )
    return train(rows, table["toxic"].to_pylist(), share)


def score(docs, model):
    """``doc_id``, ``score`` of every whole text."""

    def run(batches):
        memo = model.memo()
        for batch in batches:
            scores = [model.score(text, memo) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"]
            )

    return whole_texts(docs).mapInArrow(run, "doc_id long, score double")


def toxicity_report(docs, labels):
    return score(docs, fit(docs, labels)).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
