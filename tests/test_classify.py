import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from contrast.operators import classify


@pytest.fixture
def pred(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(1500):
        label = float(rng.random() < 0.7)
        # A third of all rows share one score.
        score = 0.5 if rng.random() < 0.34 else round(rng.random() * 0.6 + 0.4 * label, 3)
        rows.append((label, float(score >= 0.5), score))
    return spark.createDataFrame(rows, "label double, prediction double, score double").repartition(5)


def test_metrics_equal_the_evaluators(pred):
    got = {r.metric: r.value for r in classify.classifier_metrics(pred).collect()}
    multi = MulticlassClassificationEvaluator()
    assert got["accuracy"] == pytest.approx(multi.setMetricName("accuracy").evaluate(pred))
    assert got["f1"] == pytest.approx(multi.setMetricName("f1").evaluate(pred))
    binary = BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0)
    assert got["auc"] == pytest.approx(binary.evaluate(pred))
    for row in classify.per_class_metrics(pred).collect():
        multi.setMetricLabel(float(row.label))
        assert row.precision == pytest.approx(multi.setMetricName("precisionByLabel").evaluate(pred))
        assert row.recall == pytest.approx(multi.setMetricName("recallByLabel").evaluate(pred))


def test_auc_does_not_change_under_monotone_transforms(pred):
    moved = pred.withColumn("score", F.exp("score") * 3)
    auc = [
        next(r.value for r in classify.classifier_metrics(p).collect() if r.metric == "auc")
        for p in (pred, moved)
    ]
    assert auc[0] == pytest.approx(auc[1])


def test_confusion_has_zeros_for_empty_cells(spark):
    df = spark.createDataFrame([(1.0, 1.0), (0.0, 1.0)], "label double, prediction double")
    got = {r.label: (r.predicted_0, r.predicted_1) for r in classify.confusion_matrix(df).collect()}
    assert got == {0: (0, 1), 1: (0, 1)}


def test_split_is_stable_and_near_the_fraction(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("sample_id"))
    first = classify.train_test_split(df)
    second = classify.train_test_split(df.repartition(9))
    assert sorted(first.collect()) == sorted(second.collect())
    share = first.where("part = 'train'").count() / 5000
    assert abs(share - 0.7) < 0.03
    assert first.where("part not in ('train', 'test')").count() == 0


def test_forests_learn_and_rank_importances(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        case = i % 2
        rows.append((f"s{i}", [rng.random(), case + rng.random() * 0.3, rng.random()], case))
    df = spark.createDataFrame(rows, "sample_id string, svd array<double>, is_case int")
    pred = classify.rf_reduced(df, depth=3, trees=10)
    got = {r.metric: r.value for r in classify.classifier_metrics(pred).collect()}
    assert got["accuracy"] > 0.95 and got["auc"] > 0.95
    vectors = df.select("sample_id", array_to_vector("svd").alias("features"), "is_case")
    model, _ = classify.rf_features(vectors, depth=3, trees=10)
    features = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "feature_id string, pos int")
    ranked = classify.importances(model, features, k=2).collect()
    assert ranked[0].feature_id == "b" and len(ranked) == 2
