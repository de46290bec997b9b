"""One query for each operator, over its whole table."""

from contrast.llm import (
    bpe,
    fingerprint,
    mixing,
    negatives,
    quality,
    repair,
    rotation,
    secrets,
    simhash,
    spelling,
    suffix,
    thresholds,
    toxicity,
)
from contrast.llm.common import importable, read


def _over(table, operator):
    def query(spark, sf_dir):
        importable(spark)
        return operator(read(spark, sf_dir, table))

    return query


def _quality(spark, sf_dir):
    importable(spark)
    return quality.quality_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def _toxicity(spark, sf_dir):
    importable(spark)
    return toxicity.toxicity_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def _thresholds(spark, sf_dir):
    importable(spark)
    return thresholds.judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {
    "op1_secrets": _over("documents", secrets.secret_report),
    "op2_simhash": _over("documents", simhash.simhash_report),
    "op3_fingerprints": _over("documents", fingerprint.fingerprint_report),
    "op4_quality": _quality,
    "op5_suffixes": _over("documents", suffix.repeats_report),
    "op6_byte_bpe": _over("documents", bpe.bpe_report),
    "op7_toxicity": _toxicity,
    "op8_mixing": _over("documents", mixing.mix_report),
    "op9_rotation_codes": _over("embeddings", rotation.vector_groups),
    "op10_repair": _over("documents", repair.repair_report),
    "op11_hard_negatives": _over("embeddings", negatives.negatives_report),
    "op12_spelling": _over("documents", spelling.spelling_groups),
    "op13_thresholds": _thresholds,
}
