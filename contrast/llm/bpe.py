"""Byte-level BPE by longest matches and backtracking, and decoding.

The bytes of a piece are read as Latin-1, so that one pass of an Aho-Corasick
automaton over all tokens finds the longest token at every place. The encoder takes
longest tokens from the left. A token may follow another if the two next to each
other are what the merges make of their joined bytes; this answer depends on the two
tokens only and is memoised. If no token fits, the place is marked and the last token
is given back for its longest shorter prefix. A place is marked once, so the work is
linear in the piece. A sequence whose neighbours are all compatible is the result of
the merges.

Pieces repeat a lot, so each worker remembers the ids of pieces in a table of bounded
size. Null texts count as empty, an empty text has no ids. Long texts are cut into
pieces a block at a time.
"""

from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from contrast.llm.common import whole_texts

VOCABULARY = "byte_bpe_50k.tiktoken"
MEMO = 400_000
PAIRS = 1 << 18
LONG_TEXT = 1 << 20
BLOCK_PIECES = 1 << 16
BATCH = 256


def merged(raw, ranks):
    """Ids of bytes by the merges themselves: always the pair of least rank."""
    parts = [raw[i : i + 1] for i in range(len(raw))]
    while len(parts) > 1:
        best, at = min(
            (ranks.get(parts[i] + parts[i + 1], len(ranks)), i) for i in range(len(parts) - 1)
        )
        if best == len(ranks):
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[part] for part in parts]


class _Memo(dict):
    """Packed ids of pieces; it starts again when it is full."""

    def __init__(self, encode, limit):
        super().__init__()
        self.encode, self.limit = encode, limit

    def __missing__(self, piece):
        if len(self) >= self.limit:
            self.clear()
        packed = np.array(self.encode(piece.encode()), "<u4").tobytes()
        self[piece] = packed
        return packed


class ByteBpe:
    """Encoder and decoder over a table of ranks (token bytes to id)."""

    def __init__(self, ranks, pattern, memo=MEMO):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.pieces = regex.compile(pattern)
        # A token that the merges never make is only met as a whole piece.
        made = {rank: token for token, rank in ranks.items() if merged(token, ranks) == [rank]}
        self.length = {rank: len(token) for rank, token in made.items()}
        self.automaton = ahocorasick.Automaton()
        for rank, token in made.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.shorter = {}
        for rank, token in made.items():
            prefixes = (token[:n] for n in range(len(token) - 1, 0, -1))
            self.shorter[rank] = next((ranks[p] for p in prefixes if ranks.get(p) in made), None)
        self.compatible = lru_cache(PAIRS)(self._compatible)
        self.memo = _Memo(self.encode_piece, memo)

    def _compatible(self, left, right):
        return merged(self.tokens[left] + self.tokens[right], self.ranks) == [left, right]

    def encode_piece(self, raw):
        """Ids of one piece."""
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        length, shorter, compatible = self.length, self.shorter, self.compatible
        n = len(raw)
        longest = [None] * n
        # Ends come in ascending order, so the last token seen at a start is the longest.
        for end, rank in self.automaton.iter(raw.decode("latin-1")):
            longest[end + 1 - length[rank]] = rank
        dead = bytearray(n + 1)
        out, at, token = [], 0, longest[0]
        while at < n:
            end = at + length[token]
            if not dead[end] and (not out or compatible(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < n else None
                continue
            token = shorter[token]
            while token is None:
                dead[at] = 1
                given_back = out.pop()
                at -= length[given_back]
                token = shorter[given_back]
        return out

    def packed(self, text):
        """Ids of a text as little-endian unsigned 32-bit integers."""
        take = self.memo.__getitem__
        if len(text) <= LONG_TEXT:
            return b"".join(map(take, self.pieces.findall(text)))
        found = (match[0] for match in self.pieces.finditer(text))
        blocks = iter(lambda: b"".join(map(take, islice(found, BLOCK_PIECES))), b"")
        return b"".join(blocks)

    def decode(self, packed):
        """Bytes of packed ids."""
        token = self.tokens.__getitem__
        return b"".join(map(token, np.frombuffer(packed, "<u4").tolist()))


@lru_cache(2)
def load(path=None, pattern=None):
    """The coder of a rank file, once per worker. Without a path: the public vocabulary."""
    import base64

    import public_tokenizers

    with open(path or public_tokenizers.path(VOCABULARY), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return ByteBpe(ranks, pattern or public_tokenizers.PATTERN)


def encode(docs, path=None, pattern=None):
    """``doc_id``, ``ids``: the packed ids of every whole text.

    ``path`` names a rank file that every executor has.
    """

    def run(batches):
        coder = load(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                ids = [coder.packed(text) for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"]
                )
        # An idle worker keeps its memory.
        coder.memo.clear()

    return whole_texts(docs).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded, path=None, pattern=None):
    """``doc_id``, ``ids``, ``raw``: the bytes that the ids stand for."""

    def run(batches):
        coder = load(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                raw = [coder.decode(ids) for ids in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(raw, pa.binary())],
                    names=["doc_id", "ids", "raw"],
                )

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, raw binary")


def bpe_report(docs, path=None):
    """Number of ids, and digests of the ids and of the decoded bytes."""
    return decode(encode(docs, path), path).select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("raw", 256).alias("decoded_sha256"),
    )


def encoded_documents(docs, path=None):
    """``doc_id``, ``n_tokens``, ``ids``, ``exact`` (the ids decode to the text) of every row.

    Repeated rows are encoded each.
    """

    def run(batches):
        coder = load(path, None)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                texts = part.column(1).to_pylist()
                ids = [coder.packed(text) for text in texts]
                exact = [
                    coder.decode(own) == text.encode() for own, text in zip(ids, texts, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(own) // 4 for own in ids], pa.int64()),
                        pa.array(ids, pa.binary()),
                        pa.array(exact),
                    ],
                    names=["doc_id", "n_tokens", "ids", "exact"],
                )
        coder.memo.clear()

    return whole_texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary, exact boolean")
