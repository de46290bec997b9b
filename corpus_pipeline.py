"""Training-data pipeline: rate, deduplicate, redact, mix and encode documents.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written and read
again before the next one. ``docs`` has the columns of ``documents``; all stages but
the last return these columns. Null and empty texts pass every stage; an empty table
gives an empty result.
"""

from contrast.llm import bpe, mixing, quality, secrets, shingles
from contrast.llm.common import importable, read, settle


def keep_good(spark, docs, sf_dir):
    """Quality: rows that the importance resampling rejects go."""
    importable(spark)
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def keep_one_of_near(spark, docs, sf_dir):
    """Near duplicates: of documents linked by five-word shingle similarity of 0.8 or
    more the one of least id stays."""
    importable(spark)
    return shingles.keep_one(docs)


def redact_secrets(spark, docs, sf_dir):
    """Secrets: every span found is masked in the text; no row goes."""
    return secrets.redact(docs)


def mix_sources(spark, docs, sf_dir):
    """Mixing: rows are repeated until the sources have their target weights.

    The budget passes every source once at least, so no document is lost.
    """
    return mixing.mixed_documents(docs)


def encode_tokens(spark, docs, sf_dir):
    """Byte-level BPE: ids of every text, and whether they decode to it."""
    importable(spark)
    return bpe.encoded_documents(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("simhash near-dedup", keep_one_of_near),
    ("secret scan", redact_secrets),
    ("source mixing", mix_sources),
    ("byte-level BPE", encode_tokens),
]

# A fitted model, fingerprints and merges are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages, one after the other, over the whole table of documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
