"""Token ids in grammar-compressed blocks, with random access.

Texts are encoded with a tokenizer of the ``tokenizers`` library, an end id closes each
document, and the ids of all documents stand one after the other in ascending order of
ids. They are cut into shards (ranges of document ids, a few for each shuffle partition)
and these into blocks of about a million ids, at document ends.

A block is compressed by Re-Pair: frequent pairs of neighbouring symbols are replaced by
a new symbol, again and again. A round counts all pairs and replaces many of them at
once; where chosen pairs overlap, the more frequent one goes first. A rule that is used
less than ``LEAST`` times isn't made. Rounds go on until no pair makes a rule or the
numbers run out: symbols stay below 65,536, so a block is 16-bit numbers. The rules of a
round stand for at most 1 / ``LEAST`` of the block's ids, which bounds what decoding lays
out.

File format: one row per block, in Parquet files written by Spark, so that a lost task
is written again and no half block is read.

=========  ===========================================================================
shard      number of the range of document ids
block      number of the block within its shard
base       first number that isn't an id: rule i has symbol base + i
rules      left and right symbol of each rule, 16-bit little endian
lengths    number of ids that each rule stands for, 32-bit little endian
symbols    the compressed ids, 16-bit little endian
docs       document ids, in order (null for a document without one)
counts     number of ids of each document, with its end id
n_ids      sum of counts
=========  ===========================================================================

``decode`` reads any range of a block's ids: the lengths find the symbols that cover it.

Null texts count as empty and have the end id only. Documents without an id come first,
rows that share an id are in the order of their ids' bytes. An empty table has no blocks.
"""

from array import array
from functools import lru_cache
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F

from contrast.llm.common import settle, whole_texts
from contrast.plans.settle import join_side

VOCABULARY = "word_bpe_49k.json"
END = 2
SHARDS = 4
BLOCK = 1 << 20
LEAST = 16
RULES = 4096
SYMBOLS = 1 << 16
MEMO = 700_000
BATCH = 256
TEXTS = 4096

BLOCK_SCHEMA = (
    "shard int, block int, base int, rules binary, lengths binary, symbols binary, "
    "docs array<long>, counts array<long>, n_ids long"
)


# --- ids --------------------------------------------------------------------------


class WordIds(dict):
    """Packed ids of what stands between spaces, in a table of bounded size.

    This tokenizer drops white space and never joins what it parts, so the ids of a text
    are those of its words. Letters of Latin-1 go straight to the library's merges,
    marks behind them apart; all else goes through its whole encoder.
    """

    def __init__(self, path, limit=MEMO):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        if self.tokenizer.get_vocab_size() > SYMBOLS:
            raise ValueError(f"ids must be below {SYMBOLS}")
        # The visible character that stands for each byte.
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.visible = {
            b: level.pre_tokenize_str(chr(b))[0][0] for b in range(33, 127)
        } | {c: v for o in range(0xC0, 0x100) for c, v in self._two(level, chr(o))}
        self[""] = b""

    @staticmethod
    def _two(level, letter):
        return zip(letter.encode(), level.pre_tokenize_str(letter)[0][0], strict=True)

    def encode(self, text):
        return array("H", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def merge(self, letters):
        seen = letters.lower()
        if not seen.isascii():
            seen = seen.encode().decode("latin-1").translate(self.visible)
        return array("H", [t.id for t in self.tokenizer.model.tokenize(seen)]).tobytes()

    def __missing__(self, word):
        core = word.rstrip(punctuation)
        last = core[-1:]
        if len(core) < len(word) and last.isalpha() and last <= "ÿ" and ">" not in word:
            # Marks behind a letter are parted anyway, so they are not worth a place.
            packed = self.get(core) or (self[core] if _plain(core) else None)
            if packed:
                return packed + self[word[len(core) :]]
        if len(self) >= self.limit:
            self.clear()
            self[""] = b""
        packed = self[word] = self.merge(word) if _plain(word) else self.encode(word)
        return packed

    def packed(self, texts):
        """Ids and the end id of each text, as little-endian unsigned 16-bit integers.

        The words of all texts are numbered by Arrow, so that each different word is
        looked up once and its ids are laid out by its number.
        """
        texts = pa.array(texts, pa.string())
        # Letter case is dropped; this can be done at once where every letter has one
        # lower-case letter and no special token may be.
        odd = pc.match_substring_regex(texts, r"[^\x{00}-\x{FF}]|<\|")
        texts = pc.if_else(odd, texts, pc.utf8_lower(texts))
        parted = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        words = parted.flatten().dictionary_encode()
        # By way of numpy, as Arrow's own list makes an object more for each word.
        packed = [self[word] for word in words.dictionary.to_numpy(zero_copy_only=False).tolist()]
        flat = np.frombuffer(b"".join(packed), "<u2")
        size = np.fromiter(map(len, packed), np.int64, len(packed)) // 2
        at = np.cumsum(size) - size
        number = words.indices.to_numpy()
        n = size[number]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat(at[number] - (ends - n), n) + np.arange(total)]
        cuts = np.concatenate(([0], ends))[parted.offsets.to_numpy()].tolist()
        end = END.to_bytes(2, "little")
        return [ids[x:y].tobytes() + end for x, y in zip(cuts, cuts[1:], strict=False)]


# Letters of Latin-1 that have another class or form than the others.
_ORDINALS = {"ª", "º", "µ"}


def _plain(word):
    """Letters of Latin-1: one lower-case letter each, and no accents to compose."""
    return word.isalpha() and (word.isascii() or (max(word) <= "ÿ" and not _ORDINALS & set(word)))


@lru_cache(2)
def word_ids(path=None):
    import public_tokenizers

    return WordIds(path or public_tokenizers.path(VOCABULARY))


def encode(docs, path=None):
    """``doc_id``, ``ids`` (packed 16-bit ids with the end id) of every whole text."""

    def run(batches):
        ids = word_ids(path)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                packed = pa.array(ids.packed(part.column(1)), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), packed], names=["doc_id", "ids"])

    return whole_texts(docs).mapInArrow(run, "doc_id long, ids binary")


# --- grammar ----------------------------------------------------------------------


def _frequent(keys, least, most):
    """The ``most`` most frequent values that occur ``least`` times, most frequent first."""
    ordered = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    counts = np.diff(np.append(first, len(ordered)))
    enough = np.flatnonzero(counts >= least)
    best = enough[np.argsort(-counts[enough], kind="stable")[:most]]
    return ordered[first[best]]


_SLOTS = 1 << 20
_COUNTED = 1 << 18


def _often(keys, least):
    """Positions of all keys that occur ``least`` times, and of a few others.

    Keys are counted by slots that they share, so no count is too small.
    """
    slots = (keys * np.uint32(2654435761)) >> np.uint32(14)
    return np.flatnonzero((np.bincount(slots, minlength=_COUNTED) >= least)[slots])


def _slot(keys):
    return (keys * np.uint32(2654435761)) >> np.uint32(12)


def _ranks(keys, chosen):
    """Rank of each key among ``chosen`` (len(chosen): none), by a hash table.

    Of chosen keys with one slot the first keeps it; the others wait for a later round.
    """
    none = len(chosen)
    table = np.full(_SLOTS, none, np.uint16)
    table[_slot(chosen[::-1])] = np.arange(none - 1, -1, -1, dtype=np.uint16)
    rank = table[_slot(keys)]
    held = np.append(chosen, np.uint32(0))[rank]
    rank[held != keys] = none
    return rank


def _replace(keys, places, chosen):
    """(positions, ranks) of pairs to replace; no two overlap. ``places`` are those of the keys."""
    rank = _ranks(keys, chosen)
    some = np.flatnonzero(rank < len(chosen))
    if not len(some):
        return some, some
    at, r = places[some], rank[some].astype(np.int64)
    # A pair goes if it beats its neighbours; of equal neighbours in a row every other.
    touches = np.diff(at) == 1
    start = np.concatenate(([True], ~touches | (r[1:] != r[:-1])))
    began = np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
    even = (np.arange(len(at)) - began) % 2 == 0
    left = np.concatenate(([True], ~touches | (r[1:] <= r[:-1])))
    right = np.concatenate((~touches | (r[:-1] <= r[1:]), [True]))
    take = left & right & even
    # An even end of a run may still touch the start of a better pair: the left one stays.
    at, r = at[take], r[take]
    clash = np.concatenate(([False], np.diff(at) == 1))
    clash[1:] &= ~clash[:-1]
    return at[~clash], r[~clash]


def _round(keys, places, chosen, least):
    """(pairs used ``least`` times, positions, their pairs' numbers) among ``chosen``.

    If the more frequent pairs take so much from each other that none is left with
    enough, fewer are tried; the most frequent one alone loses to itself only.
    """
    while len(chosen):
        at, rank = _replace(keys, places, chosen)
        good = np.bincount(rank, minlength=len(chosen)) >= least
        if good.any():
            keep = good[rank]
            return chosen[good], at[keep], (np.cumsum(good) - 1)[rank[keep]]
        chosen = chosen[: len(chosen) // 2]
    return chosen, np.zeros(0, np.int64), np.zeros(0, np.int64)


def compress(ids, base, least=LEAST):
    """(rules, lengths, symbols) of an array of ids below ``base``."""
    symbols = ids.astype(np.uint16)
    left, right = [np.zeros(0, np.uint16)], [np.zeros(0, np.uint16)]
    size = np.ones(base, np.uint32)
    while len(symbols) >= 2 * least and len(size) < SYMBOLS:
        keys = symbols[:-1].astype(np.uint32) << np.uint32(16) | symbols[1:]
        places = _often(keys, least)
        keys = keys[places]
        chosen = _frequent(keys, least, min(RULES, SYMBOLS - len(size)))
        chosen, at, rank = _round(keys, places, chosen, least)
        if not len(chosen):
            break
        a, b = (chosen >> np.uint32(16)).astype(np.uint16), (chosen & np.uint32(0xFFFF)).astype(np.uint16)
        symbols = symbols.copy()
        symbols[at] = len(size) + rank
        stays = np.ones(len(symbols), bool)
        stays[at + 1] = False
        symbols = symbols[stays]
        left.append(a)
        right.append(b)
        size = np.concatenate((size, size[a] + size[b]))
    rules = np.stack((np.concatenate(left), np.concatenate(right)), axis=1)
    return rules, size[base:], symbols


class Block:
    """A block as read from its row."""

    def __init__(self, base, rules, lengths, symbols):
        self.base = base
        self.rules = np.frombuffer(rules, "<u2").reshape(-1, 2).astype(np.int64)
        self.lengths = np.frombuffer(lengths, "<u4").astype(np.int64)
        self.symbols = np.frombuffer(symbols, "<u2").astype(np.int64)
        # What each rule stands for, laid end to end; a rule only uses earlier ones.
        self.flat = self._laid_out()
        self.size = np.concatenate((np.ones(base, np.int64), self.lengths))
        self.at = np.cumsum(self.size) - self.size
        self.ends = np.cumsum(self.size[self.symbols])

    def _laid_out(self):
        """Ids and, behind them, what each rule stands for, end to end.

        Every sweep replaces all rule symbols by their two sides.
        """
        flat = np.arange(self.base + len(self.rules))
        while True:
            deep = flat >= self.base
            if not deep.any():
                return flat.astype(np.uint16)
            at = np.cumsum(1 + deep) - 1 - deep
            wide = np.empty(len(flat) + deep.sum(), np.int64)
            wide[at] = flat
            wide[at[deep]] = self.rules[flat[deep] - self.base, 0]
            wide[at[deep] + 1] = self.rules[flat[deep] - self.base, 1]
            flat = wide

    def decode(self, start=0, stop=None):
        """Ids ``start`` to ``stop`` (exclusive) of the block."""
        total = int(self.ends[-1]) if len(self.ends) else 0
        start, stop = max(start, 0), total if stop is None else min(stop, total)
        if start >= stop:
            return np.zeros(0, np.uint16)
        first = int(np.searchsorted(self.ends, start, "right"))
        last = int(np.searchsorted(self.ends, stop, "left"))
        some = self.symbols[first : last + 1]
        n = self.size[some]
        ends = np.cumsum(n)
        skip = np.repeat(self.at[some] - (ends - n), n)
        ids = self.flat[skip + np.arange(ends[-1])]
        begin = int(self.ends[first] - self.size[self.symbols[first]])
        return ids[start - begin : stop - begin]


# --- files ------------------------------------------------------------------------


def _in_shards(encoded, shards):
    cuts = encoded.agg(
        F.percentile_approx("doc_id", [i / shards for i in range(1, shards)], 100 * shards)
    ).first()[0] if shards > 1 else None
    return sorted(set(cuts or []))


def blocks(docs, path=None, block=BLOCK):
    """The blocks of all documents (see the file format); lazily, not yet written."""
    spark = docs.sparkSession
    shards = SHARDS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = _in_shards(docs.select(F.col("doc_id").cast("long").alias("doc_id")), shards)
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    number = F.size(F.filter(bounds, lambda b: b < F.coalesce("doc_id", F.lit(-(1 << 63)))))
    placed = (
        encode(docs, path)
        .withColumn("shard", number)
        .repartition(shards, "shard")
        .sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "ids")
        .select("shard", "doc_id", "ids")
    )

    def run(batches):
        base = word_ids(path).tokenizer.get_vocab_size()
        shard, nth, ids, counts, held = None, 0, [], [], []

        def packed():
            every = np.frombuffer(b"".join(ids), "<u2")
            rules, lengths, symbols = compress(every, base)
            return pa.RecordBatch.from_pylist(
                [
                    {
                        "shard": shard,
                        "block": nth,
                        "base": base,
                        "rules": rules.astype("<u2").tobytes(),
                        "lengths": lengths.astype("<u4").tobytes(),
                        "symbols": symbols.astype("<u2").tobytes(),
                        "docs": held,
                        "counts": counts,
                        "n_ids": len(every),
                    }
                ],
                schema=_ARROW,
            )

        size = 0
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(3)]
            for s, doc, own in zip(*columns, strict=True):
                if held and (s != shard or size + len(own) // 2 > block):
                    yield packed()
                    nth = nth + 1 if s == shard else 0
                    ids, counts, held, size = [], [], [], 0
                shard = s
                ids.append(own)
                counts.append(len(own) // 2)
                held.append(doc)
                size += len(own) // 2
        if held:
            yield packed()

    return placed.mapInArrow(run, BLOCK_SCHEMA)


_ARROW = pa.schema(
    [
        ("shard", pa.int32()),
        ("block", pa.int32()),
        ("base", pa.int32()),
        ("rules", pa.binary()),
        ("lengths", pa.binary()),
        ("symbols", pa.binary()),
        ("docs", pa.list_(pa.int64())),
        ("counts", pa.list_(pa.int64())),
        ("n_ids", pa.int64()),
    ]
)


def block_starts(written):
    """``shard``, ``block``, ``start``: number of ids before each block.

    Sums of whole shards go first; their number is set by the shuffle partitions.
    """
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sizes = written.select("shard", "block", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    offsets = shards.select(
        "shard", F.coalesce(F.sum("n").over(before(Window.orderBy("shard"))), F.lit(0)).alias("offset")
    )
    within = F.coalesce(
        F.sum("n_ids").over(before(Window.partitionBy("shard").orderBy("block"))), F.lit(0)
    )
    return sizes.join(offsets, "shard").select(
        "shard", "block", (F.col("offset") + within).alias("start")
    )


def read_documents(written):
    """``doc_id``, ``start``, ``n_tokens``, ``ids`` (packed 32-bit) of every document."""
    starts = settle(block_starts(written), "starts")
    placed = join_side(written, starts, ["shard", "block"]).select(
        "start", "base", "rules", "lengths", "symbols", "docs", "counts"
    )

    def run(batches):
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                block = Block(row["base"], row["rules"], row["lengths"], row["symbols"])
                ids = block.decode().astype("<u4")
                ends = np.cumsum(row["counts"])
                for at in range(0, len(ends), BATCH):
                    stop = ends[at : at + BATCH]
                    n = np.array(row["counts"][at : at + BATCH])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(row["docs"][at : at + BATCH], pa.int64()),
                            pa.array(row["start"] + stop - n),
                            pa.array(n, pa.int64()),
                            pa.array([ids[e - k : e].tobytes() for e, k in zip(stop, n, strict=True)], pa.binary()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def read_range(written, start, stop):
    """Ids ``start`` to ``stop`` of the whole corpus, from the blocks that hold them.

    Rows (``at``, ``ids``): a packed run of 32-bit ids and its place. Blocks outside the
    range are filtered out before any is decoded.
    """
    starts = settle(block_starts(written), "starts")
    placed = join_side(written, starts, ["shard", "block"]).where(
        (F.col("start") < stop) & (F.col("start") + F.col("n_ids") > start)
    ).select("start", "base", "rules", "lengths", "symbols")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row["base"], row["rules"], row["lengths"], row["symbols"])
                begin = max(start - row["start"], 0)
                ids = block.decode(begin, stop - row["start"]).astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["start"] + begin]), pa.array([ids.tobytes()], pa.binary())],
                    names=["at", "ids"],
                )

    return placed.mapInArrow(run, "at long, ids binary")


def repair_report(docs, path=None):
    """What the files say of each document, with the CRC-32 of its ids."""
    written = settle(blocks(docs, path), "blocks")
    return read_documents(written).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )
