"""Spelling variants: words one edit apart, by dynamic programming over sorted lists.

1. Words are counted in the tasks that read the texts, then over all of them.
2. Two words one edit apart are equal before the place where they first differ and after
   the edit. Let ``s`` be the length of the shorter one. The places 0..s are cut into two
   intervals [lo, hi); words of length s and s + 1 that agree in the ``lo`` first and the
   ``s - hi`` last code points meet under one key. A pair counts only under the interval
   that holds its first difference, so it counts once.
3. The interval of a key with more than ``BLOCK`` words is halved again. An interval of
   one place is never halved: its words agree in all but two code points, so the alphabet
   bounds their number. So a hot beginning or ending is no large group, and no pair is lost.
4. The words of a key are a sorted list. For each word it is scanned once: the edit matrix
   is kept in a band of three cells a row, and the next word of the list goes on from the
   rows of what it shares with the one before (their LCP). Where every cell of a row exceeds
   one edit, all further words that share this prefix are skipped.

A scan gives one row a word, with the number of its near words and the best of them.
Forms grow at least tenfold in their count along a chain, so a chain is short; roots are
found by doubling the steps.

A null text has no words, a null id counts as an empty string in the hash. Repeated rows
and rows of one id are counted one by one; ties go to the smaller word in code-point
order. A text is searched whole, in one task. An empty table gives an empty table.
"""

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from contrast.llm.common import settle, whole_texts
from contrast.plans.settle import join_side

# Fixed values of the contract: letters (after lower-casing A-Z), least length and count,
# the share of runs that lose a code point, and how much more frequent a form is.
RUN = r"[a-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT = 7, 2
NOISE = 31
TIMES = 10
BLOCK = 64
_HELD = 1 << 17


# --- words ------------------------------------------------------------------------


def noisy(run, seed, noise=NOISE):
    """The run, without one of its code points where its hash has it so."""
    h = zlib.crc32(run.encode(), seed)
    if h % noise:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(docs, least_length=LEAST_LENGTH, least_count=LEAST_COUNT, noise=NOISE):
    """``word``, ``n``: the words of all texts, counted in the tasks first."""
    long = re.compile(RUN.replace("+", "{%d,}" % least_length))

    def run(batches):
        held = Counter()

        def given():
            rows = pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"]
            )
            held.clear()
            return rows

        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seed = zlib.crc32(b"%d:" % key if key is not None else b":")
                found = Counter(long.findall(raw.lower().decode("utf-8", "replace")))
                for word, n in found.items():
                    word = noisy(word, seed, noise)
                    if len(word) >= least_length:
                        held[word] += n
                if len(held) >= _HELD:
                    yield given()
        yield given()

    raw = whole_texts(docs).withColumn("text", F.col("text").cast("binary"))
    counted = raw.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return settle(counted.where(F.col("n") >= least_count), "words")


# --- one list ---------------------------------------------------------------------


def shared(a, b):
    """Number of code points that two words share from the start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 8:
        middle = (low + high) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle)
    while a[low] == b[low]:
        low += 1
    return low


def near_pairs(words, s, lo, hi):
    """Pairs of places (i, j) in a sorted list of different words that are one edit apart.

    ``i`` has length ``s`` and ``j`` has length ``s`` (then i < j) or ``s + 1``; their first
    difference lies in [lo, hi).
    """
    count = len(words)
    if count < 2:
        return
    # No word differs from another before this place, so every scan starts behind it.
    start = shared(words[0], words[-1])
    lcp = [start] + [shared(words[k - 1], words[k]) for k in range(1, count)]
    for i, query in enumerate(words):
        if len(query) != s:
            continue
        # rows[d]: cells j = d-1, d, d+1 of the matrix after d code points of the list's word.
        rows = {start: (1 if start else 9, 0, 1)}
        known, k = start, 0
        while k < count:
            word, length = words[k], len(words[k])
            known = min(known, lcp[k])
            x, y, z = rows[known]
            d = known
            while d < length:
                c = word[d]
                d += 1
                left = min(x + (d < 2 or d - 2 >= s or query[d - 2] != c), y + 1)
                middle = min(y + (d > s or query[d - 1] != c), z + 1, left + 1)
                right = min(z + (d >= s or query[d] != c), middle + 1)
                x, y, z = left, middle, right
                rows[d] = (x, y, z)
                if x > 1 and y > 1 and z > 1:
                    break
            known = d
            if x > 1 and y > 1 and z > 1:
                # Every word that shares these d code points is too far as well.
                k += 1
                while k < count and lcp[k] >= d:
                    k += 1
                continue
            if (length == s and y == 1 and k > i) or (length == s + 1 and x == 1):
                if lo <= shared(query, word) < hi:
                    yield i, k
            k += 1


# --- on Spark ---------------------------------------------------------------------


def _key(rows):
    before = F.substr("word", F.lit(1), F.col("lo"))
    last = F.greatest(F.col("s") - F.col("hi"), F.lit(0))
    behind = F.substr("word", F.char_length("word") - last + 1, last)
    return rows.withColumn("key", F.xxhash64("s", "lo", "hi", before, behind))


def _halved(rows):
    """Every row twice, with either half of its interval."""
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    halves = F.array(
        F.struct(F.col("lo").alias("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi").alias("hi"))
    )
    halved = rows.select("word", "n", "s", F.explode(halves).alias("half"))
    return _key(halved.select("word", "n", "s", "half.lo", "half.hi"))


def _lists(words, least_length, block):
    """``key, s, lo, hi, word, n`` of all lists, none of them larger than its bound."""
    length = F.char_length("word")
    role = F.explode(F.array(length - 1, length)).alias("s")
    roles = words.select("word", "n", role).where(F.col("s") >= least_length)
    rows = settle(_halved(roles.withColumns({"lo": F.lit(0), "hi": F.col("s") + 1})), "lists")
    parts = []
    while True:
        large = rows.where("hi - lo > 1").groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > block)
        large = settle(large.select("key"), "large")
        if large.isEmpty():
            parts.append(rows)
            break
        parts.append(join_side(rows, large, ["key"], "left_anti"))
        rows = settle(_halved(join_side(rows, large, ["key"], "left_semi")), "lists")
    lists = parts[0]
    for part in parts[1:]:
        lists = lists.unionByName(part)
    return lists.select("key", "s", "lo", "hi", "word", "n")


def near_words(words, least_length=LEAST_LENGTH, block=BLOCK):
    """``word``, ``n_near``, ``best`` (count and word) of every word that has a near one."""
    group = ["key", "s", "lo", "hi"]
    lists = _lists(words, least_length, block)
    width = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lists.repartition(width, *group).sortWithinPartitions(*group, "word")

    def run(batches):
        out = ([], [], [], [])

        def done(names, counts, s, lo, hi):
            near, best = Counter(), {}
            for pair in near_pairs(names, s, lo, hi):
                for own, other in (pair, pair[::-1]):
                    near[own] += 1
                    offer = (-counts[other], names[other])
                    best[own] = min(best.get(own, offer), offer)
            for own, (n, name) in best.items():
                for column, value in zip(out, (names[own], near[own], -n, name), strict=True):
                    column.append(value)

        def given():
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            batch = pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(out, kinds, strict=True)],
                names=["word", "near", "best_n", "best"],
            )
            for column in out:
                column.clear()
            return batch

        current, names, counts = None, [], []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            for *mark, word, n in zip(*columns, strict=True):
                if mark != current:
                    if len(names) > 1:
                        done(names, counts, *current[1:])
                    current, names, counts = mark, [], []
                names.append(word)
                counts.append(n)
            if len(out[0]) > 1 << 14:
                yield given()
        if len(names) > 1:
            done(names, counts, *current[1:])
        yield given()

    found = dealt.mapInArrow(run, "word string, near long, best_n long, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best").alias("name"))).alias("first")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), first)


def roots(forms):
    """``word``, ``root`` of every ``word`` that has a ``form``: the end of its chain."""
    steps = settle(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = steps.join(onward, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
        )
        moved = settle(moved, "roots")
        steps = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return steps


def spelling_groups(docs, least_length=LEAST_LENGTH, least_count=LEAST_COUNT, noise=NOISE, times=TIMES, block=BLOCK):
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of every word."""
    words = vocabulary(docs, least_length, least_count, noise)
    near = near_words(words, least_length, block)
    best_n = -F.col("first.minus")
    known = best_n >= F.col("n") * times
    formed = settle(
        words.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(known, F.col("first.name")).alias("form"),
            F.when(known, best_n).alias("form_n"),
        ),
        "forms",
    )
    ends = roots(formed.where("form is not null"))
    return formed.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
