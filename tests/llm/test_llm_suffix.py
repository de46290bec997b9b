import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from contrast.llm import suffix as X


def plain(rows):
    """Brute force: first id of every string, and what it removes."""
    first = {}
    raws = [(key, (text or "").encode()) for key, text in rows]
    for key, raw in raws:
        for p in range(len(raw) - X.MATCH + 1) if key is not None else ():
            s = raw[p : p + X.MATCH]
            first[s] = min(first.get(s, key), key)
    out = []
    for key, raw in raws:
        gone = np.zeros(len(raw) + 2, int)
        for p in range(len(raw) - X.MATCH + 1) if key is not None else ():
            if first[raw[p : p + X.MATCH]] < key:
                gone[p + 1 : p + 1 + X.MATCH] = 1
        kept = bytes(b for b, g in zip(raw, gone[1:], strict=False) if not g)
        spans = int((np.diff(gone) == 1).sum())
        out.append((key, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def reported(df):
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def corpus():
    rng = random.Random(3)
    base = ["".join(rng.choice("abcd é\n") for _ in range(rng.randint(0, 400))) for _ in range(30)]
    rows = []
    for i in range(150):
        b, c = rng.choice(base), rng.choice(base)
        k, j = rng.randint(0, len(b)), rng.randint(0, len(c))
        rows.append((i, rng.choice([b, b[k:] + c[:j], b[:k] + "x" + b[k:], c + b, "ab" * rng.randint(0, 90)])))
    return [*rows, (5, base[0]), (5, base[0]), (None, base[1]), (200, base[2] * 3 + "q" + base[3])]


def test_removed_bytes_equal_brute_force(documents, odd):
    rows = corpus() + [(300 + i, text) for i, (_, text) in enumerate(odd) if text is None or len(text) < 99]
    assert reported(X.repeats_report(documents(rows))) == plain(rows)


def test_odd_rows(documents, odd):
    """Rows of one id leave each other alone; a text without an id keeps all."""
    assert reported(X.repeats_report(documents(odd + odd))) == plain(odd + odd)


def test_texts_of_one_id_whose_hashes_share_bits(spark, documents):
    """Of two texts of one id only the copied one goes, though 16 bits of their hashes agree."""
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdefgh") for _ in range(100)) for _ in range(1500)]
    table = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    seen, pairs = {}, []
    for r in table.select("i", F.xxhash64("t").bitwiseAND(F.lit(0xFFFF)).alias("h")).collect():
        if r["h"] in seen:
            pairs.append((texts[seen[r["h"]]], texts[r["i"]]))
        seen[r["h"]] = r["i"]
    assert pairs
    rows = []
    for n, (a, b) in enumerate(pairs):
        rows += [(10 * n + 1, a), (10 * n + 5, a), (10 * n + 5, b)]
    assert reported(X.repeats_report(documents(rows))) == plain(rows)


def test_exactly_fifty_bytes_at_the_edges(documents):
    s = "".join(chr(97 + i * 7 % 26) for i in range(50))
    rows = [(1, s), (2, s), (3, s[:49]), (4, "x" + s), (5, s + "y"), (6, s[1:] + s), (7, s[:49] + "é"), (0, s[10:] + "z" * 60)]
    assert reported(X.repeats_report(documents(rows))) == plain(rows)


def test_every_string_has_one_sampled_place(monkeypatch):
    """Equal strings sample the same place, in whole texts and across the seams of pieces."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 900))).encode() for _ in range(20)]
    texts.append(texts[3] * 2 + texts[4])
    for size in (1 << 20, 257):
        monkeypatch.setattr(X, "PIECE", size)
        row, at, first, count, gram, _ = X._sampled_texts(texts)
        seen, place = {}, {}
        for r, a, f, c, g in zip(row, at, first, count, gram, strict=True):
            for start in range(f, f + c):
                assert (r, start) not in seen
                seen[r, start] = a
                s = texts[r][start : start + X.MATCH]
                assert len(s) == X.MATCH and place.setdefault(s, (a - start, g)) == (a - start, g)
        assert len(seen) == sum(max(0, len(t) - X.MATCH + 1) for t in texts)


def test_sample_is_sparse():
    data = np.random.default_rng(1).integers(0, 256, 200_000).astype(np.uint8)
    at = X._sampled(data, np.array([len(data)]))[0]
    assert len(at) < 2.1 * len(data) / (X.WIDTH + 1)


def test_planes_round_trip():
    a, b = np.arange(7, dtype=np.uint64) << np.uint64(40), np.arange(7, dtype=np.uint16)
    x, y = X._unpack(X._pack(a, b), np.uint64, np.uint16)
    assert (x == a).all() and (y == b).all()


class Local:
    """Stands for a table; its mapInArrow hands out the function."""

    def where(self, *_):
        return self

    select = where

    def mapInArrow(self, run, _):  # noqa: N802
        return run


def test_contexts_count_in_all_their_bits(spark, monkeypatch):
    """Contexts of one gram that agree in half their bits are different strings."""

    def sampled(texts, *_):
        n = len(texts)
        zero = np.zeros(n, np.int64)
        return np.arange(n), zero, zero, zero + 1, np.full(n, 7 << 40, np.uint64), np.array([int(t) for t in texts], np.uint64)

    monkeypatch.setattr(X, "_sampled_texts", sampled)
    send, rank = X.suffix_records(Local(), 1, 1), X.rank_buckets(Local(), 1)

    def answers(*contexts):
        sent = []
        for i, context in enumerate(contexts):
            columns = [pa.array([i]), pa.array([str(context).encode()]), pa.array([0])]
            sent += send([pa.RecordBatch.from_arrays(columns, names=["doc_id", "raw", "mark"])])
        found = [X._unpack(load, *X._ANSWER) for batch in rank(sent) for load in batch.column(1).to_pylist()]
        return {int(i): int(flag) for ids, _, _, flags in found for i, flag in zip(ids, flags, strict=True)}

    for other in (5 | 1 << 40, 5 | 1 << 20):
        assert answers(5, other) == {0: X.OPEN, 1: X.OPEN}
    assert answers(5, 5) == {1: X.RESOLVED}


def seams():
    """Long copies with edits beside the seams of pieces of 257 bytes, and copies that end there."""
    rng = random.Random(11)
    rows, step = [], 257 - X.MATCH + 1
    for n in range(12):
        text = "".join(rng.choice("abcdefgh") for _ in range(257 + 6 * step))
        rows.append((1000 * n, text))
        for j in range(30):
            copy = list(text)
            for seam in range(step, len(text), step):
                copy[min(len(copy) - 1, max(0, seam + rng.randint(-60, 110)))] = "x"
            end = rng.choice([len(copy), step * rng.randint(2, 6) + rng.randint(-5, 60)])
            rows.append((1000 * n + 1 + j, "".join(copy[:end])))
    return rows


def test_edits_at_the_seams_of_long_texts(documents):
    rows = seams()
    assert reported(X.repeats_report(documents(rows), 257)) == plain(rows)


def test_empty_table(documents):
    assert X.repeats_report(documents([(1, "x")]).where(F.lit(False))).count() == 0
