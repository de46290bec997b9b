"""Quality rules whose cutoffs are risk-controlled on labelled documents.

Every rule rates a text by an integer, per thousand: the higher, the worse. A rule rejects
a text whose rating reaches the cutoff of its stratum (the language). Cutoffs come from the
labelled documents that pass the base rule, all of them:

1. The cutoffs of a rule are fixed beforehand, from lenient to strict. The share of good
   documents that a cutoff rejects is tested against ``RISK`` divided by the number of
   rules: the exact binomial probability of so few rejections, if the share were that
   large, must not exceed the level.
2. The level is ``DOUBT`` divided by the number of rules and of strata with labels (Bonferroni).
   Within a rule and stratum the cutoffs are tested in order, up to the first that fails, so
   they need no further correction. With a probability of 1 - ``DOUBT`` all cutoffs that
   pass, whichever is chosen, together reject at most ``RISK`` of the good documents of
   every stratum.
3. Of those that pass, the cutoff with the largest gain is taken, that is the share of bad
   documents it catches less the share of good ones it rejects; ties go to the more lenient
   one. A rule that gains nothing rejects nothing, and nor does a stratum with too few labels.

A null text has no words and fails the base rule. A null language is a stratum of its own.
Rows of one id are judged one by one; a document with several labels is good only if all
are, and labels without an id or a value don't count. Texts are read whole. An empty table
gives an empty table.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from contrast.llm.common import settle
from contrast.plans.settle import join_side

# Fixed values of the base rule.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 50
# The share of good documents that all rules together may reject, and the probability of more.
RISK = 0.05
DOUBT = 0.05
# Rule: rating (counted over), cutoffs from lenient to strict; per thousand.
SHARES = [900, 800, 700, 600, 500, 400, 300, 250, 200, 150, 100, 75, 50, 30, 20, 10]
RULES = {
    "symbols": ("n_symbols", "n_words", SHARES),
    "dup_lines": ("n_dup_lines", "n_lines", SHARES),
    "repeat_words": ("n_repeat_words", "n_words", [450, *SHARES[5:]]),
    "long_words": ("word_chars", "n_words", [20000, 15000, 12000, 10000, 9000, 8000, 7500, 7000, 6500]),
    "short_words": ("n_words", "word_chars", [700, 600, 500, 450, 400, 350, 300, 275, 250]),
}
_SPACE = b" \t\n\x0b\x0c\r"
_BETWEEN = bytes(range(0x80, 0xC0)) + _SPACE


def repeated_words(words):
    """Words that lie in a window of three found twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    number = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n + 2)
    _, pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
    _, window, times = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    again = times[window] > 1
    covered = np.zeros(n + 2, bool)
    for shift in range(3):
        covered[shift : shift + n] |= again
    return int(covered.sum())


def counts(raw):
    """Words, code points in words, symbols, repeated lines, repeated words, lines with a word."""
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return (
        len(words),
        len(raw.translate(None, _BETWEEN)),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
    )


def binomial_tail(k, n, p):
    """Probability of at most ``k`` hits in ``n`` draws of probability ``p``.

    From the mode on it is reported as 1, as it is too large to matter.
    """
    if k >= n * p:
        return 1.0
    log = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    term = math.exp(log + k * math.log(p) + (n - k) * math.log1p(-p))
    total = 0.0
    while k >= 0 and term > total * 1e-17:
        total += term
        term *= k * (1 - p) / ((n - k + 1) * p)
        k -= 1
    return total


def chosen(cutoffs, good, bad, risk, level):
    """The cutoff of one rule and stratum, or None.

    ``good`` and ``bad`` have the number of documents by the number of cutoffs they reach:
    from none to all of them.
    """
    n_good, n_bad = sum(good), sum(bad)
    best, gain = None, 0
    for i, cutoff in enumerate(cutoffs):
        rejected, caught = sum(good[len(cutoffs) - i :]), sum(bad[len(cutoffs) - i :])
        if binomial_tail(rejected, n_good, risk) > level:
            break
        # Shares by cross-multiplication, so that ties are exact.
        own = caught * n_good - rejected * n_bad
        if own > gain:
            best, gain = cutoff, own
    return best


# --- on Spark ---------------------------------------------------------------------

_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measured(docs):
    """``doc_id``, ``stratum``, the counts, and the base rule's verdict of every text."""

    def run(batches):
        for batch in batches:
            found = [counts(raw) for raw in batch.column(2).to_pylist()]
            columns = np.array(found, np.int64).reshape(-1, 6).T
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *map(pa.array, columns)],
                names=["doc_id", "stratum", *_BASE, "n_lines"],
            )

    raw = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-")).alias("stratum"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    schema = ", ".join(f"{name} long" for name in [*_BASE, "n_lines"])
    found = raw.mapInArrow(run, f"doc_id long, stratum string, {schema}")
    failed = (F.col("n_words") < LEAST_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED
    )
    return settle(found.withColumn("base_failed", failed), "measured")


def _rating(rule):
    over, under, _ = RULES[rule]
    return F.coalesce(F.floor(F.try_divide(F.col(over) * 1000, F.col(under))), F.lit(0))


def cutoffs(table, labels, risk=RISK, doubt=DOUBT):
    """One row a stratum with labels: the cutoff of each rule, null where it has none."""
    rated = labels.where("doc_id is not null and quality is not null")
    rated = rated.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") > 0).alias("good"))
    reached = [
        F.struct(F.lit(rule).alias("rule"), sum((_rating(rule) >= c).cast("int") for c in cuts).alias("level"))
        for rule, (_, _, cuts) in RULES.items()
    ]
    known = table.where("not base_failed").join(rated, "doc_id")
    cells = known.select("stratum", "good", F.explode(F.array(*reached)).alias("own"))
    # A few hundred rows a stratum at most: rules x levels x two.
    tally = settle(cells.groupBy("stratum", "good", "own.rule", "own.level").agg(F.count("*").alias("n")), "tally")
    strata = tally.select("stratum").distinct().count()
    level = doubt / (len(RULES) * max(strata, 1))

    def choose(rows):
        stratum = rows.column("stratum")[0].as_py()
        own = {rule: ([0] * (len(cuts) + 1), [0] * (len(cuts) + 1)) for rule, (_, _, cuts) in RULES.items()}
        for row in rows.to_pylist():
            own[row["rule"]][0 if row["good"] else 1][row["level"]] += row["n"]
        best = {
            rule: chosen(RULES[rule][2], good, bad, risk / len(RULES), level) for rule, (good, bad) in own.items()
        }
        return pa.table(
            {"stratum": pa.array([stratum]), **{f"cut_{r}": pa.array([c], pa.int32()) for r, c in best.items()}}
        )

    schema = "stratum string, " + ", ".join(f"cut_{rule} int" for rule in RULES)
    return settle(tally.groupBy("stratum").applyInArrow(choose, schema), "cutoffs")


def judged(docs, labels, risk=RISK, doubt=DOUBT):
    """The counts, ``base_failed``, ``failed_rules`` and ``kept`` of every row of ``docs``."""
    table = measured(docs)
    limits = cutoffs(table, labels, risk, doubt)
    failed = [F.when(_rating(rule) >= F.col(f"cut_{rule}"), F.lit(rule)) for rule in RULES]
    known = join_side(table, limits, ["stratum"], "left").withColumn("failed_rules", F.concat_ws(",", *failed))
    kept = ~F.col("base_failed") & (F.col("failed_rules") == "")
    return known.select("doc_id", *_BASE, "base_failed", kept.alias("kept"), "failed_rules")
