"""Secret scan: patterns, and sliding-window entropy for what no pattern knows.

Column expressions only. A text is touched by the costly expressions only if a
cheap test of the same pattern hits; no row is shuffled.

* Patterns give the base spans (``assign``, ``access``, ``hex``): leftmost,
  non-overlapping per kind, and then dropped if too short.
* Entropy gives further spans per character class (``entropy_hex``,
  ``entropy_base64``). A window moves over each candidate string. The counts of its
  characters and the sum of ``c * log2(c)`` are carried along; one step changes the
  count of the character that leaves and of the one that enters, so a step costs the
  alphabet and not the window. Windows above the class's threshold are joined to
  spans. The sum is in integer micro-bits, so that a result doesn't depend on the
  order of floating-point additions.
* The allow list: a candidate that is a UUID as a whole is not scanned. Any other one is
  divided into parts at ``/``, ``=``, ``_`` and ``-``; a part that holds one of the listed
  alphabets or placeholder words is left out. What lies between such parts, with the
  separators, is scanned as candidates of their own, so no window reaches over a part left
  out, and a key beside a placeholder is found. The list never removes a base span.

Null and empty texts have no spans. Rows with equal ids are scanned one by one.
Positions are code points, the end is exclusive.
"""

import math

from pyspark.sql import functions as F

from contrast.llm.common import whole_texts

# The patterns and the least lengths of the base spans.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}
# Runs of one class: every match that is too short ends where its run ends, so asking
# for the length in the pattern finds the same matches and skips the short ones.
ACCESS_LONG = r"AKIA[A-Z0-9]{14,}"
HEX_LONG = r"[0-9a-f]{16,}"

# Fixed values of the entropy scan: class, candidate pattern, alphabet, least bits.
WINDOW = 20
CLASSES = (
    ("entropy_hex", r"[0-9A-Fa-f]{20,}", "0123456789abcdef", 3.0),
    (
        "entropy_base64",
        r"[A-Za-z0-9+/_=-]{20,}",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-",
        3.8,
    ),
)
# What looks random by nature or is meant to be seen.
ALLOWED = r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"
ALLOWED_PART = r"(?i)(0123456789|abcdefghij|qwertyuiop|example|sample|dummy|placeholder|changeme)"
SEPARATOR = r"[/=_-]"
# Elements of a block of hits, and windows of a part of a long candidate.
PART = 256
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")

_MICRO = 1_000_000


def micro_bits(window=WINDOW):
    """``c * log2(c)`` in micro-bits for every count a window can hold."""
    return [round(c * math.log2(c) * _MICRO) if c else 0 for c in range(window + 1)]


def micro_limit(bits, window=WINDOW):
    """The largest sum of ``c * log2(c)`` at which a window has ``bits`` of entropy."""
    return round(window * (math.log2(window) - bits) * _MICRO)


def _span(kind, start, end):
    return F.struct(
        start.cast("int").alias("start"),
        F.lit(KINDS.index(kind)).alias("rank"),
        end.cast("int").alias("end"),
    )


_NO_SPANS = "array<struct<start:int,rank:int,end:int>>"


def _let(value, body):
    """``body`` of a value that is computed once, also where lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _blocks(values):
    """An array cut into arrays of ``PART`` elements."""
    last = F.floor((F.size(values) + (PART - 1)) / PART).cast("int")
    starts = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda b: F.slice(values, (b - 1) * PART + 1, F.lit(PART)))


def _before(values, op):
    """``op`` (sum or maximum) over the elements before each one, from 0 on.

    Block by block, and then over the blocks: appending to an array copies it, so no array
    of all elements grows step by step.
    """
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(acc, v):
        return F.struct(op(acc["at"], v).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))

    def joined(parts):
        tops = F.transform(parts, lambda x: x["at"])
        return _let(
            F.aggregate(tops, start, step, lambda acc: acc["out"]),
            lambda offsets: F.flatten(
                F.zip_with(parts, offsets, lambda x, b: F.transform(x["out"], lambda o: op(b, o)))
            ),
        )

    return _let(F.transform(_blocks(values), lambda block: F.aggregate(block, start, step)), joined)


def _located(text, pattern):
    """Array of (start, hit): the hits of a pattern with their places.

    The pieces between the hits and the hits themselves are laid end to end.
    """
    both = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit")
    )

    def placed(found):
        lengths = F.transform(found, lambda x: F.char_length(x["gap"]) + F.char_length(x["hit"]))
        return F.zip_with(
            found,
            _let(lengths, lambda own: _before(own, lambda a, b: a + b)),
            lambda x, at: F.struct((at + F.char_length(x["gap"])).alias("start"), x["hit"].alias("hit")),
        )

    # The last piece follows the last hit.
    return _let(both, lambda x: _let(F.filter(x, lambda y: y["hit"].isNotNull()), placed))


def _where(test, spans):
    return F.when(test, spans).otherwise(F.array().cast(_NO_SPANS))


def _runs(text, kind, pattern):
    return F.transform(
        _located(text, pattern),
        lambda x: _span(kind, x["start"], x["start"] + F.char_length(x["hit"])),
    )


def _assignments(text):
    """All hits are taken first; those with a short value are dropped afterwards."""
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    both = F.arrays_zip(_located(text, ASSIGN).alias("found"), values.alias("value"))
    return F.transform(
        F.filter(both, lambda x: F.char_length(x["value"]) >= LEAST["assign"]),
        lambda x: _span(
            "assign",
            x["found"]["start"],
            x["found"]["start"] + F.char_length(x["found"]["hit"]),
        ),
    )


def _touching(spans):
    """Sorted spans (start, end) joined where they touch or overlap; ends must ascend too."""

    def joined(own):
        n = F.size(own)
        fresh = F.transform(
            own, lambda x, i: F.struct((F.coalesce(F.get(own, i - 1)["end"], F.lit(-1)) < x["start"]).alias("new"), x.alias("x"))
        )
        last = F.filter(own, lambda x, i: F.coalesce(F.get(own, i + 1)["start"] > x["end"], i == n - 1))
        first = F.filter(fresh, lambda x: x["new"])
        return F.zip_with(first, last, lambda a, z: F.struct(a["x"]["start"].alias("start"), z["end"].alias("end")))

    return _let(spans, joined)


def entropy_spans(word, alphabet, bits, window=WINDOW, pieces=None):
    """Spans (start, end) of a candidate string whose windows reach ``bits``.

    ``pieces`` are the ranges (start, end) to scan, by default the whole string; no window
    reaches over their ends. Characters become places in the alphabet once. A long piece is
    scanned in parts of ``PART`` windows, each with its own counts.
    """
    limit = micro_limit(bits, window)
    costs = F.array(*[F.lit(v).cast("long") for v in micro_bits(window)])

    def scanned(places, table, offset):
        def step(acc, place, j):
            # ``j`` is the number of characters so far, with this one.
            leaves = F.when(j > window, F.get(places, j - window - 1)).otherwise(F.lit(0))

            def moved(move):
                enters, leaves = move["enters"], move["leaves"]
                counts = F.transform(
                    acc["counts"], lambda c, i: c - (i + 1 == leaves).cast("int") + (i + 1 == enters).cast("int")
                )
                gone = F.when(leaves > 0, F.get(acc["counts"], leaves - 1)).otherwise(F.lit(0))
                before = F.get(acc["counts"], enters - 1) - (enters == leaves).cast("int")
                total = (
                    acc["total"]
                    - F.when(leaves > 0, F.get(table, gone) - F.get(table, gone - 1)).otherwise(F.lit(0))
                    + F.get(table, before + 1)
                    - F.get(table, before)
                )
                return F.struct(counts.alias("counts"), total.alias("total"))

            def spanned(next_):
                hit = (j >= window) & (next_["total"] <= limit)
                joins = hit & (acc["end"] >= j - window)
                closes = hit & ~joins & (acc["end"] >= 0)
                closed = F.struct((acc["start"] + offset).alias("start"), (acc["end"] + offset).alias("end"))
                return F.struct(
                    next_["counts"].alias("counts"),
                    next_["total"].alias("total"),
                    j.alias("n"),
                    F.when(hit & ~joins, j - window).otherwise(acc["start"]).alias("start"),
                    F.when(hit, j).otherwise(acc["end"]).alias("end"),
                    F.when(closes, F.array_append(acc["spans"], closed)).otherwise(acc["spans"]).alias("spans"),
                )

            return _let(_let(F.struct(place.alias("enters"), leaves.alias("leaves")), moved), spanned)

        start = F.struct(
            F.array_repeat(F.lit(0), len(alphabet)).alias("counts"),
            F.lit(0).cast("long").alias("total"),
            F.lit(0).alias("n"),
            F.lit(-1).alias("start"),
            F.lit(-1).alias("end"),
            F.array().cast("array<struct<start:int,end:int>>").alias("spans"),
        )

        def finished(acc):
            last = F.struct((acc["start"] + offset).alias("start"), (acc["end"] + offset).alias("end"))
            return F.when(acc["end"] >= 0, F.array_append(acc["spans"], last)).otherwise(acc["spans"])

        return F.aggregate(places, start, lambda acc, place: step(acc, place, acc["n"] + 1), finished)

    def parts(places):
        # Parts overlap by a window less one character, so that every window lies in one.
        last = F.greatest(F.floor((F.size(places) - window) / PART), F.lit(0)).cast("int")
        return _touching(
            _let(
                costs,
                lambda table: F.flatten(
                    F.transform(
                        F.sequence(F.lit(0), last),
                        lambda b: _let(
                            F.slice(places, b * PART + 1, F.lit(PART + window - 1)),
                            lambda own: scanned(own, table, b * PART),
                        ),
                    )
                ),
            )
        )

    def scan(places):
        if pieces is None:
            return parts(places)
        return F.flatten(
            F.transform(
                pieces,
                lambda p: F.transform(
                    _let(F.slice(places, p["start"] + 1, p["end"] - p["start"]), parts),
                    lambda s: F.struct((s["start"] + p["start"]).alias("start"), (s["end"] + p["start"]).alias("end")),
                ),
            )
        )

    letters = F.filter(F.split(word, ""), lambda c: c != "")
    return _let(F.transform(letters, lambda c: F.instr(F.lit(alphabet), c)), scan)


def _unlisted(hit):
    """Ranges (start, end) of a candidate between the parts that the allow list leaves out."""
    end = F.char_length(hit)

    def ranged(start, stop):
        return F.struct(start.alias("start"), stop.alias("end"))

    def between(parts):
        sizes = F.transform(parts, lambda p: F.char_length(p) + 1)
        placed = F.zip_with(
            parts,
            _let(sizes, lambda own: _before(own, lambda a, b: a + b)),
            lambda p, at: F.struct(at.alias("start"), (at + F.char_length(p)).alias("end"), p.alias("part")),
        )
        return _let(
            F.filter(placed, lambda x: F.rlike(x["part"], F.lit(ALLOWED_PART))),
            lambda out: F.transform(
                F.sequence(F.lit(0), F.size(out)),
                lambda i: ranged(
                    F.coalesce(F.get(out, i - 1)["end"], F.lit(0)), F.coalesce(F.get(out, i)["start"], end)
                ),
            ),
        )

    listed = F.rlike(hit, F.lit(ALLOWED_PART))
    return F.when(listed, _let(F.split(hit, SEPARATOR, -1), between)).otherwise(F.array(ranged(F.lit(0), end)))


def _entropies(text, kind, pattern, alphabet, bits):
    def spans(x):
        word = F.lower(x["hit"]) if kind == "entropy_hex" else x["hit"]
        found = _let(_unlisted(x["hit"]), lambda pieces: entropy_spans(word, alphabet, bits, pieces=pieces))
        return F.transform(found, lambda s: _span(kind, x["start"] + s["start"], x["start"] + s["end"]))

    candidates = F.filter(_located(text, pattern), lambda x: ~F.rlike(x["hit"], F.lit(ALLOWED)))
    return F.flatten(F.transform(candidates, spans))


def secrets_in(text):
    """Array of (start, rank of the kind, end), sorted, of a text column."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    found = [
        _where(F.rlike(t, F.lit(ASSIGN)), _assignments(t)),
        _where(F.contains(t, F.lit("AKIA")), _runs(t, "access", ACCESS_LONG)),
        _where(F.rlike(t, F.lit(HEX_LONG)), _runs(t, "hex", HEX_LONG)),
    ]
    candidates = F.rlike(t, F.lit(CLASSES[-1][1]))
    found += [_where(candidates, _entropies(t, *rest)) for rest in CLASSES]
    return F.array_sort(F.concat(*found))


def _joined(spans):
    names = F.array(*[F.lit(kind) for kind in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )


def secret_report(docs):
    """One row per document: counts of the base kinds, their digest, all spans."""

    def count(kind):
        rank = KINDS.index(kind)
        return F.size(F.filter("secrets", lambda s: s["rank"] == rank)).cast("long")

    base = F.filter("secrets", lambda s: s["rank"] < len(LEAST))
    entropy = F.filter("secrets", lambda s: s["rank"] >= len(LEAST))
    return whole_texts(docs).withColumn("secrets", secrets_in(F.col("text"))).select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("secrets")).alias("spans"),
        F.size(entropy).cast("long").alias("n_entropy"),
    )


def _apart(spans):
    """Sorted spans as (start, end) that don't overlap; those that only touch stay apart."""

    def grouped(own):
        def joined(tops):
            marked = F.zip_with(own, tops, lambda x, top: F.struct(x["start"].alias("start"), top.alias("top")))
            first = F.filter(marked, lambda x: x["start"] >= x["top"])
            most = F.array_max(F.transform(own, lambda x: x["end"]))
            return _let(
                first,
                lambda f: F.transform(
                    f, lambda x, i: F.struct(x["start"].alias("start"), F.coalesce(F.get(f, i + 1)["top"], most).alias("end"))
                ),
            )

        ends = F.transform(own, lambda x: x["end"])
        return _let(_let(ends, lambda e: _before(e, F.greatest)), joined)

    return _let(spans, grouped)


def masked(text, spans, mask):
    """A text with its spans replaced by ``mask``; overlapping spans are masked once.

    The text is cut at every ``PART``-th span first, and the short pieces at their spans.
    """

    def cut(own):
        def pieces(b):
            part = F.slice(own, b * PART + 1, F.lit(PART))
            begin = F.get(own, b * PART)["start"]
            stop = F.coalesce(F.get(own, (b + 1) * PART)["start"], F.char_length(text))

            def between(known):
                return F.transform(
                    known["part"],
                    lambda x, i: F.concat(
                        F.lit(mask),
                        F.substr(
                            known["piece"],
                            x["end"] - known["begin"] + 1,
                            F.coalesce(F.get(known["part"], i + 1)["start"], known["stop"]) - x["end"],
                        ),
                    ),
                )

            piece = F.substr(text, begin + 1, stop - begin)
            return _let(
                F.struct(part.alias("part"), begin.alias("begin"), stop.alias("stop"), piece.alias("piece")), between
            )

        last = F.floor((F.size(own) - 1) / PART).cast("int")
        behind = F.flatten(F.transform(F.sequence(F.lit(0), last), pieces))
        return F.when(F.size(own) == 0, text).otherwise(
            F.concat(F.substr(text, F.lit(1), F.get(own, F.lit(0))["start"]), F.array_join(behind, ""))
        )

    return _let(_apart(spans), cut)


def redact(docs, mask="[SECRET]"):
    """``docs`` with every secret in ``text`` replaced by ``mask``; no row goes.

    ``n_chars`` follows the new text where there is a secret. A null text stays null.
    """
    columns = docs.columns
    # Columns of the table stay in one, so that none has the name of a helper.
    found = docs.select(F.struct(*[docs[c] for c in columns]).alias("row")).withColumn(
        "secrets", secrets_in(F.col("row.text"))
    )
    text = F.col("row.text").cast("string")
    some = F.size("secrets") > 0
    new = F.when(some, masked(text, F.col("secrets"), mask)).otherwise(text)
    changed = {"text": new}
    if "n_chars" in columns:
        length = F.char_length(new).cast("long")
        changed["n_chars"] = F.when(some, length).otherwise(F.col("row.n_chars"))
    return found.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in columns])
