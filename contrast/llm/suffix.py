"""Removal of repeated byte strings by content sampling and hash grouping.

A byte goes if it lies in a string of ``MATCH`` bytes that also starts in a document of
smaller id. So equal strings of ``MATCH`` bytes have to be brought together, and the least
id of each found. No suffix is ordered and no rank is made: strings are grouped by hash.

A difference cover is a sample of positions such that any two equal strings have a sampled
position at equal distance from their starts. A cover by residues samples about a fifth of all positions. Here the cover goes by
content: of the grams in every string of ``MATCH`` bytes the one of least hash is
sampled (the first, if it repeats). Equal strings sample the same place, so the
property holds, with about one position in sixteen. Each string belongs to exactly one sampled position, and the strings of a
position are a run of neighbouring starts: its context is what they cover together.

1. The sampled suffixes are dealt to buckets by their gram and grouped by gram and
   context hash one bucket at a time. The least id of a group decides for all its strings
   at once.
2. Suffixes whose gram is shared but whose context isn't (edges of repeated passages)
   send their contexts, at most ``2 * MATCH`` bytes, to buckets again. There every string
   is grouped by the hash of its whole ``MATCH`` bytes.
3. The runs of removed starts go back to the texts.

Before the first shuffle a task answers what it can: of equal contexts in a part of
its input only those of the smallest id are sent. So copies and frequent passages send
one record per part. All that is held at a time is a part, a bucket or a group of texts;
their number follows the shuffle partitions. Strings are compared by 64-bit hashes
under a second key.

Null texts count as empty. Rows that share an id don't remove each other's bytes. A row
without an id loses nothing and removes nothing. Longer texts are read in pieces that
overlap, so no string is lost at a seam.
"""

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

from contrast.llm.common import settle, whole_texts
from contrast.plans.settle import join_side

MATCH = 50
GRAM = 20
WIDTH = MATCH - GRAM + 1
PIECE = 1 << 18
RECORDS = 1 << 19
PLACES = np.uint64((1 << 24) - 1)
# Buckets and text groups for each shuffle partition.
BUCKETS, GROUPS = 8, 4

_STEP = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n):
    """Powers of the step and of its inverse modulo 2**64, at least n of each."""
    if len(_POWERS.get("up", ())) < n:
        n = max(n, PIECE + MATCH)
        for name, base in (("up", _STEP), ("down", pow(_STEP, -1, 1 << 64))):
            out = np.full(n, base, np.uint64)
            out[0] = 1
            _POWERS[name] = np.multiply.accumulate(out)
        _POWERS["byte"] = np.random.default_rng(17).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    return _POWERS


def _prefix(data):
    """Prefix sums whose differences are polynomial hashes of any stretch."""
    p = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(p["byte"][data] * p["up"][: len(data)], out=sums[1:])
    return sums


def _mix(h):
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _stretch(sums, start, end):
    """Hashes of data[start:end] (arrays) from prefix sums."""
    return _mix((sums[end] - sums[start]) * _powers(len(sums))["down"][start])


def _sampled(data, ends):
    """Sampled positions of a piece: (at, first, count, gram, context).

    ``ends`` are the ends of the texts in ``data``. ``first`` is the first string start
    that belongs to the position, ``count`` the number of them.
    """
    empty = np.zeros(0, np.int64)
    if len(data) < MATCH:
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    sums = _prefix(data)
    n = len(data) - GRAM + 1
    starts = np.arange(n)
    gram = _stretch(sums, starts, starts + GRAM)
    # Least hash first, then the earlier place; sliding minimum by blocks of the width.
    value = (gram & ~PLACES) | starts.astype(np.uint64)
    padded = np.full(-(-n // WIDTH) * WIDTH, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = value
    blocks = padded.reshape(-1, WIDTH)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - WIDTH + 1
    least = np.minimum(back[:windows], forward[WIDTH - 1 : WIDTH - 1 + windows])
    at = (least & PLACES).astype(np.int64)
    # Strings that reach over the end of their text are none.
    begin = np.concatenate(([0], ends[:-1]))
    inside = np.zeros(len(data) + 1, np.int64)
    long = ends - begin >= MATCH
    np.add.at(inside, begin[long], 1)
    np.add.at(inside, ends[long] - MATCH + 1, -1)
    start = np.flatnonzero(np.cumsum(inside[:windows]))
    if not len(start):
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    at = at[start]
    fresh = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (np.diff(start) != 1))))
    first = start[fresh]
    last = start[np.concatenate((fresh[1:], [len(start)])) - 1]
    at = at[fresh]
    shape = ((at - first) * 64 + (last - first)).astype(np.uint64)
    context = _mix(_stretch(sums, first, last + MATCH) + shape * np.uint64(_STEP))
    return at, first, last - first + 1, gram[at], context


def _pieces(texts, piece=None):
    """Texts in pieces: (row, offset, bytes) lists; long texts overlap themselves."""
    most = piece or PIECE
    held, size = [], 0
    for row, text in enumerate(texts):
        at = 0
        while True:
            part = text[at : at + most]
            if held and size + len(part) > most:
                yield held
                held, size = [], 0
            held.append((row, at, part))
            size += len(part)
            if at + most >= len(text):
                break
            at += most - MATCH + 1
    if held:
        yield held


def _sampled_texts(texts, piece=None):
    """Arrays over all texts: row, at (in the text), first, count, gram, context.

    A place whose strings lie on both sides of a seam comes twice, with its own strings
    and context on either side; ``first`` tells the two apart.
    """
    parts = []
    for held in _pieces(texts, piece):
        lengths = np.array([len(part) for _, _, part in held])
        ends = np.cumsum(lengths)
        data = np.frombuffer(b"".join(part for _, _, part in held), np.uint8)
        at, first, count, gram, context = _sampled(data, ends)
        which = np.searchsorted(ends, first, "right")
        shift = np.array([offset for _, offset, _ in held]) - (ends - lengths)
        row = np.array([row for row, _, _ in held])
        parts.append((row[which], at + shift[which], first + shift[which], count, gram, context))
    return [np.concatenate(column) for column in zip(*parts, strict=True)]


# --- records ----------------------------------------------------------------------


def _pack(*columns):
    """Columns of numbers as bytes, plane by plane, so that equal high bytes compress."""
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns]
    return b"".join(planes)


def _unpack(raw, *types):
    width = sum(np.dtype(t).itemsize for t in types)
    n, at, out = len(raw) // width, 0, []
    for t in types:
        size = np.dtype(t).itemsize
        plane = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(plane.T).view(t).ravel())
        at += n * size
    return out


def _grouped(key, n):
    """(group, rows of it) for numbers below n that occur in ``key``."""
    order = np.argsort(key, kind="stable")
    cuts = np.searchsorted(key[order], np.arange(n + 1))
    return [(g, order[cuts[g] : cuts[g + 1]]) for g in range(n) if cuts[g] < cuts[g + 1]]


def _group_of(ids, n):
    return (_mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(n)).astype(np.int64)


# Of a gram 32 bits are sent besides its bucket: grams that agree in these are told apart
# by their contexts, which are sent whole. Ids are sent as differences. A suffix is named
# by the first of its strings, as no string belongs to two.
_SUFFIX = (np.uint32, np.uint64, np.int64, np.uint64, np.uint32)
_ANSWER = (np.int64, np.uint64, np.uint32, np.uint8)
_RUNS = (np.int64, np.uint64, np.uint32, np.uint32)
_EDGE = (np.uint64, np.int64, np.uint64, np.uint32, np.uint8, np.uint8)
_TEXT = (np.int64, np.uint64, np.int64)
RESOLVED, OPEN = 1, 2


def _least_by(keys, ids):
    """(least id of each row's key group, group number of each row)."""
    order = np.lexsort(keys[::-1])
    fresh = np.zeros(len(order), bool)
    fresh[:1] = True
    for key in keys:
        k = key[order]
        fresh[1:] |= k[1:] != k[:-1]
    starts = np.flatnonzero(fresh)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(fresh) - 1
    least = np.minimum.reduceat(ids[order], starts) if len(starts) else ids[:0]
    return least, number


def suffix_records(raws, buckets, groups, piece=None):
    """``kind``, ``part``, ``payload``: sampled suffixes by bucket, and local answers.

    Kind 0: suffixes for bucket ``part``. Kind 1: answers for text group ``part`` that
    need no other part of the input.
    """

    def run(batches):
        held, size = [], 0

        def out():
            gram, context, ids, mark, first = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            kinds, parts, loads = [], [], []
            least, number = _least_by((gram, context), ids)
            known = least[number] < ids
            for group, rows in _grouped(_group_of(ids[known], groups), groups):
                flag = np.full(len(rows), RESOLVED, np.uint8)
                kinds.append(1)
                parts.append(group)
                loads.append(_pack(ids[known][rows], mark[known][rows], first[known][rows], flag))
            keep = np.flatnonzero(~known)
            bucket = (gram[keep] % np.uint64(buckets)).astype(np.int64)
            for b, rows in _grouped(bucket, buckets):
                own = keep[rows]
                kinds.append(0)
                parts.append(b)
                high = (gram[own] >> np.uint64(32)).astype(np.uint32)
                loads.append(_pack(high, context[own], np.diff(ids[own], prepend=np.int64(0)), mark[own], first[own]))
            return pa.RecordBatch.from_arrays(
                [pa.array(kinds, pa.int32()), pa.array(parts, pa.int32()), pa.array(loads, pa.binary())],
                names=["kind", "part", "payload"],
            )

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            marks = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            for start in range(0, batch.num_rows, 512):
                texts = batch.column(1).slice(start, 512).to_pylist()
                row, _, first, _, gram, context = _sampled_texts(texts, piece)
                row = row + start
                held.append((gram, context, ids[row], marks[row], first.astype(np.uint32)))
                size += len(row)
                if size >= RECORDS:
                    yield out()
                    size = 0
        if held:
            yield out()

    return raws.mapInArrow(run, "kind int, part int, payload binary")


def _marked(docs):
    """Texts with an id as bytes, and a mark of 64 bits that tells texts of one id apart.

    The mark is 0 where the id has one row, so that nearly all marks compress away.
    """
    rows = whole_texts(docs).where("doc_id is not null")
    again = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    again = settle(again.select("doc_id", F.lit(True).alias("again")), "again")
    mark = F.when(F.col("again"), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    return join_side(rows, again, ["doc_id"], "left").select(
        "doc_id", F.col("text").cast("binary").alias("raw"), mark.alias("mark")
    )


def _by_part(frame, width):
    return frame.repartition(width, "kind", "part").sortWithinPartitions("kind", "part")


def _per_part(batches, work):
    """Calls work(kind, part, payloads) for each part of sorted rows; yields its batches."""
    mark, held = None, []
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(3)]
        for kind, part, payload in zip(*columns, strict=True):
            if (kind, part) != mark:
                if held:
                    yield from work(*mark, held)
                mark, held = (kind, part), []
            held.append(payload)
    if held:
        yield from work(*mark, held)


class _Answers:
    """Records for text groups, gathered over the buckets of a task."""

    def __init__(self, groups):
        self.groups, self.held, self.size = groups, [], 0

    def add(self, *columns):
        self.held.append(columns)
        self.size += len(columns[0])

    def batch(self):
        columns = [np.concatenate(c) for c in zip(*self.held, strict=True)]
        self.held, self.size = [], 0
        found = _grouped(_group_of(columns[0], self.groups), self.groups)
        loads = [_pack(*(c[rows] for c in columns)) for _, rows in found]
        return _group_batch([g for g, _ in found], loads)


def _group_batch(groups, loads):
    return pa.RecordBatch.from_arrays(
        [pa.array(groups, pa.int32()), pa.array(loads, pa.binary())], names=["part", "payload"]
    )


def rank_buckets(records, groups):
    """``part``, ``payload``: what grouping the buckets says of the suffixes (``_ANSWER``).

    Resolved: all strings of the suffix start in a smaller id. Open: its gram is shared,
    and its strings have to be looked at. Suffixes with neither are left out.
    """

    def run(batches):
        answers = _Answers(groups)

        def work(kind, part, payloads):
            if kind == 1:
                yield _group_batch([part] * len(payloads), payloads)
                return
            loads = [_unpack(p, *_SUFFIX) for p in payloads]
            gram, context, _, mark, first = (np.concatenate(c) for c in zip(*loads, strict=True))
            ids = np.concatenate([np.cumsum(load[2]) for load in loads])
            low, by_gram = _least_by((gram,), ids)
            high = -_least_by((gram,), -ids)[0]
            least, by_context = _least_by((gram, context), ids)
            # Number of contexts of each gram.
            pairs = np.unique(np.stack((by_gram, by_context), axis=1), axis=0)
            contexts = np.bincount(pairs[:, 0], minlength=len(low))
            shared = (low != high)[by_gram]
            resolved = least[by_context] < ids
            is_open = shared & ~resolved & (contexts > 1)[by_gram]
            keep = resolved | is_open
            flag = np.where(resolved, RESOLVED, OPEN).astype(np.uint8)
            answers.add(ids[keep], mark[keep], first[keep], flag[keep])
            if answers.size > RECORDS:
                yield answers.batch()

        yield from _per_part(batches, work)
        if answers.held:
            yield answers.batch()

    return records.mapInArrow(run, "part int, payload binary")


# --- texts ------------------------------------------------------------------------


def _keyed(columns, types):
    """Payloads as one array for each column, and the row ranges of each (id, mark)."""
    payloads = columns.to_pylist()
    if not payloads:
        return [np.zeros(0, t) for t in types], {}
    data = [np.concatenate(c) for c in zip(*(_unpack(p, *types) for p in payloads), strict=True)]
    order = np.lexsort(tuple(data[i] for i in range(len(types) - 1, -1, -1)))
    data = [c[order] for c in data]
    ids, mark = data[0], data[1]
    cut = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (mark[1:] != mark[:-1]))))
    stop = np.append(cut[1:], len(ids))
    return data, {(int(ids[a]), int(mark[a])): (a, b) for a, b in zip(cut, stop, strict=True)}


def _merged(start, end):
    """Runs (start, end) joined where they touch or overlap."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    fresh = np.concatenate(([True], start[1:] > end[:-1]))
    first = np.flatnonzero(fresh)
    return start[first], end[np.append(first[1:], len(start)) - 1]


def _grouped_texts(raws, groups):
    """``part``, ``payload``: the texts of a part of the input by text group, compressed.

    Texts are shuffled twice, so they are packed together and compressed before.
    """

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            marks = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            parts, loads = [], []
            for part, rows in _grouped(_group_of(ids, groups), groups):
                texts = batch.column(1).take(pa.array(rows)).to_pylist()
                lengths = np.array([len(t) for t in texts], np.int64)
                head = len(rows).to_bytes(4, "little") + _pack(ids[rows], marks[rows], lengths)
                parts.append(part)
                loads.append(pack.compress(head + b"".join(texts)))
            yield _group_batch(parts, loads)

    return raws.mapInArrow(run, "part int, payload binary")


def _texts_of(column):
    """(ids, marks, texts) of a group's payloads."""
    unpack = zstandard.ZstdDecompressor()
    ids, marks, texts = [], [], []
    for payload in column.to_pylist():
        raw = unpack.decompress(payload)
        n = int.from_bytes(raw[:4], "little")
        at = 4 + n * sum(np.dtype(t).itemsize for t in _TEXT)
        own, mark, lengths = _unpack(raw[4:at], *_TEXT)
        ids += own.tolist()
        marks += mark.tolist()
        for length in lengths.tolist():
            texts.append(raw[at : at + length])
            at += length
    return ids, marks, texts


def edges(raws, answers, buckets, groups, piece=None):
    """``kind``, ``part``, ``payload`` from the texts and the answers about them.

    Kind 0: contexts of open suffixes, by bucket of their gram. Kind 1: removed runs, by
    text group.
    """

    def run(left, right):
        data, where = _keyed(right["payload"], _ANSWER)
        ids, marks, texts = _texts_of(left["payload"])
        known = [i for i, key in enumerate(zip(ids, marks, strict=True)) if key in where]
        runs, open_ = [], []
        row, at, first, count, gram, _ = (
            _sampled_texts([texts[i] for i in known], piece) if known else [np.zeros(0, np.int64)] * 6
        )
        cuts = np.searchsorted(row, np.arange(len(known) + 1))
        for k, i in enumerate(known):
            a, b = where[ids[i], marks[i]]
            own = slice(cuts[k], cuts[k + 1])
            place = np.searchsorted(data[2][a:b], first[own])
            place = np.minimum(place, b - a - 1)
            flag = np.where(data[2][a:b][place] == first[own], data[3][a:b][place], 0)
            done = flag == RESOLVED
            start, end = _merged(first[own][done], first[own][done] + count[own][done] - 1 + MATCH)
            runs.append((np.full(len(start), ids[i]), np.full(len(start), marks[i], np.uint64), start, end))
            rest = np.flatnonzero(flag == OPEN)
            text = texts[i]
            for j in rest + cuts[k]:
                f, c = int(first[j]), int(count[j])
                open_.append((int(gram[j]), ids[i], marks[i], int(at[j]), int(at[j]) - f, c, text[f : f + c - 1 + MATCH]))
        kinds, parts, loads = [], [], []
        if runs:
            columns = [np.concatenate(c).astype(t) for c, t in zip(zip(*runs, strict=True), _RUNS, strict=True)]
            if len(columns[0]):
                kinds, parts, loads = [1], [left["part"][0].as_py()], [_pack(*columns)]
        if open_:
            grams = np.array([o[0] for o in open_], np.uint64)
            for b, rows in _grouped((grams % np.uint64(buckets)).astype(np.int64), buckets):
                own = [open_[r] for r in rows]
                fixed = _pack(*(np.array([o[c] for o in own], t) for c, t in enumerate(_EDGE)))
                kinds.append(0)
                parts.append(b)
                loads.append(len(own).to_bytes(4, "little") + fixed + b"".join(o[6] for o in own))
        return pa.table(
            [pa.array(kinds, pa.int32()), pa.array(parts, pa.int32()), pa.array(loads, pa.binary())],
            names=["kind", "part", "payload"],
        )

    texts = _grouped_texts(raws, groups)
    return (
        texts.groupBy("part")
        .cogroup(answers.groupBy("part"))
        .applyInArrow(run, "kind int, part int, payload binary")
    )


def rank_edges(contexts, groups):
    """``part``, ``payload``: runs that the open suffixes' own strings remove (``_RUNS``)."""

    def run(batches):
        answers = _Answers(groups)

        def work(_, part, payloads):
            fixed, texts = [], []
            width = sum(np.dtype(t).itemsize for t in _EDGE)
            for payload in payloads:
                n = int.from_bytes(payload[:4], "little")
                fixed.append(_unpack(payload[4 : 4 + n * width], *_EDGE))
                texts.append(payload[4 + n * width :])
            gram, ids, mark, at, before, count = (np.concatenate(c) for c in zip(*fixed, strict=True))
            data = np.frombuffer(b"".join(texts), np.uint8)
            count = count.astype(np.int64)
            length = count - 1 + MATCH
            begin = np.cumsum(length) - length
            # Every string of every suffix.
            owner = np.repeat(np.arange(len(count)), count)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            start = begin[owner] + nth
            sums = _prefix(data)
            string = _stretch(sums, start, start + MATCH)
            least, number = _least_by((string, gram[owner]), ids[owner])
            gone = least[number] < ids[owner]
            owner, nth = owner[gone], nth[gone]
            if not len(owner):
                return
            fresh = np.concatenate(([True], (owner[1:] != owner[:-1]) | (np.diff(nth) != 1)))
            first = np.flatnonzero(fresh)
            last = np.append(first[1:], len(owner)) - 1
            own = owner[first]
            base = at[own].astype(np.int64) - before[own]
            answers.add(
                ids[own],
                mark[own],
                (base + nth[first]).astype(np.uint32),
                (base + nth[last] + MATCH).astype(np.uint32),
            )
            if answers.size > RECORDS:
                yield answers.batch()

        yield from _per_part(batches, work)
        if answers.held:
            yield answers.batch()

    return contexts.mapInArrow(run, "part int, payload binary")


def removed_runs(raws, piece=None):
    """``part``, ``payload`` (``_RUNS``): removed runs by text group, and the group count."""
    width = int(raws.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets, groups = BUCKETS * width, GROUPS * width
    records = _by_part(suffix_records(raws, buckets, groups, piece), width)
    answers = rank_buckets(records, groups)
    found = settle(edges(raws, answers, buckets, groups, piece), "edges")
    late = rank_edges(_by_part(found.where("kind = 0"), width), groups)
    return found.where("kind = 1").select("part", "payload").unionByName(late), groups


def remove_repeats(docs, piece=None):
    """``doc_id``, ``raw`` (whole bytes), ``kept`` (remaining bytes), ``n_removed``, ``n_spans``."""
    raws = _marked(docs)
    runs, groups = removed_runs(raws, piece)

    def run(left, right):
        data, where = _keyed(right["payload"], _RUNS)
        kept, removed, spans = [], [], []
        ids, marks, texts = _texts_of(left["payload"])
        for doc, mark, text in zip(ids, marks, texts, strict=True):
            a, b = where.get((doc, mark), (0, 0))
            start, end = _merged(data[2][a:b].astype(np.int64), data[3][a:b].astype(np.int64))
            removed.append(int((end - start).sum()))
            spans.append(len(start))
            cuts = [0, *np.stack((start, end), axis=1).ravel().tolist(), len(text)]
            kept.append(b"".join(text[x:y] for x, y in zip(cuts[::2], cuts[1::2], strict=True)))
        return pa.table(
            [
                pa.array(ids, pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array(kept, pa.binary()),
                pa.array(removed, pa.int64()),
                pa.array(spans, pa.int64()),
            ],
            names=["doc_id", "n_bytes", "kept", "n_removed", "n_spans"],
        )

    named = (
        _grouped_texts(raws, groups)
        .groupBy("part")
        .cogroup(runs.groupBy("part"))
        .applyInArrow(run, "doc_id long, n_bytes long, kept binary, n_removed long, n_spans long")
    )
    # Rows without an id lose nothing, so they need no group.
    raw, none = F.col("text").cast("binary"), F.lit(0).cast("long")
    nameless = whole_texts(docs).where("doc_id is null").select(
        "doc_id", F.octet_length(raw).cast("long"), raw, none.alias("n_removed"), none.alias("n_spans")
    )
    return named.union(nameless)


def repeats_report(docs, piece=None):
    """Removed bytes of every row; texts of over ``piece`` bytes are read in pieces."""
    return remove_repeats(docs, piece).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )

