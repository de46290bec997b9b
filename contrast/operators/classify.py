"""Split, tree ensembles and the metrics of a prediction table.

A prediction table has ``label``, ``prediction`` and ``score`` columns.
"""

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from contrast import settings as S
from contrast.plans.ordered import place, running_sum
from contrast.plans.settle import settle


def train_test_split(df, fraction=S.TRAIN_FRACTION, seed=S.SEED, key="sample_id"):
    """Add ``part``: ``train`` or ``test``, from the hash of the sample id alone.

    Independent of partitioning and row order, so it can be recomputed anywhere.
    """
    salted = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key)))
    draw = F.conv(F.substring(salted, 1, 8), 16, 10).cast("long") % 10_000
    return df.withColumn("part", F.when(draw < round(fraction * 10_000), "train").otherwise("test"))


def fit_forest(train, depth, trees=S.TREES, seed=S.SEED):
    """Random forest on ``features`` against ``label``."""
    forest = RandomForestClassifier(
        featuresCol="features",
        labelCol="label",
        numTrees=trees,
        maxDepth=depth,
        seed=seed,
    )
    return forest.fit(train)


def predict(model, test):
    """Prediction table of a fitted forest; the score is the probability of class 1."""
    kept = [name for name in test.columns if name != "features"]
    return model.transform(test).select(
        *kept, "prediction", vector_to_array("probability")[1].alias("score")
    )


def rf_reduced(reduced, depth=S.REDUCED_DEPTH, trees=S.TREES, seed=S.SEED):
    """Forest on the reduced features; predictions for the held-out samples."""
    data = reduced.select(
        "sample_id",
        array_to_vector("svd").alias("features"),
        F.col("is_case").cast("double").alias("label"),
    )
    parts = settle(train_test_split(data, seed=seed), "split")
    model = fit_forest(parts.where("part = 'train'").drop("part"), depth, trees, seed)
    return predict(model, parts.where("part = 'test'").drop("part"))


def rf_features(vectors, depth=S.FEATURE_DEPTH, trees=S.TREES, seed=S.SEED):
    """Forest on the features themselves: the model and the held-out predictions.

    ``vectors`` has ``sample_id, features, is_case``.
    """
    data = vectors.select("sample_id", "features", F.col("is_case").cast("double").alias("label"))
    parts = settle(train_test_split(data, seed=seed), "split")
    model = fit_forest(parts.where("part = 'train'").drop("part"), depth, trees, seed)
    return model, predict(model, parts.where("part = 'test'").drop("part"))


def importances(model, features, k=None):
    """Features ranked by importance; ``features`` holds their positions."""
    spark = features.sparkSession
    values = [(i, float(v)) for i, v in enumerate(model.featureImportances.toArray())]
    table = spark.createDataFrame(values, "pos int, importance double")
    ranked = features.select("feature_id", "pos").join(table, "pos").drop("pos")
    ranked = ranked.orderBy(F.desc("importance"), "feature_id")
    return ranked if k is None else ranked.limit(k)


def _auc(pred):
    """Rank-sum area under the ROC curve; tied scores count half."""
    scores = pred.groupBy("score").agg(
        F.count_if(F.col("label") == 1).alias("_pos"),
        F.count_if(F.col("label") == 0).alias("_neg"),
    )
    below = running_sum(place(scores, [], ["score"]), [], ["score"], F.col("_neg"), "_upto")
    won = F.col("_pos") * (F.col("_upto") - F.col("_neg") / 2.0)
    return below.agg(
        F.try_divide(F.sum(won), F.sum("_pos").cast("double") * F.sum("_neg")).alias("auc")
    )


def _confusion_counts(pred):
    return pred.groupBy("label", "prediction").agg(F.count("*").alias("n"))


def per_class_metrics(pred):
    """Precision, recall and support of every label."""
    cells = _confusion_counts(pred)
    actual = cells.select(
        F.col("label").cast("double").alias("cls"),
        F.col("n").alias("actual"),
        F.lit(0).cast("long").alias("predicted"),
        F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit"),
    )
    predicted = cells.select(
        F.col("prediction").cast("double").alias("cls"),
        F.lit(0).cast("long").alias("actual"),
        F.col("n").alias("predicted"),
        F.lit(0).cast("long").alias("hit"),
    )
    sums = actual.unionByName(predicted).groupBy("cls").agg(
        F.sum("actual").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hit").alias("hit")
    )
    return sums.select(
        F.col("cls").cast("int").alias("label"),
        "support",
        F.coalesce(F.try_divide("hit", "predicted"), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide("hit", "support"), F.lit(0.0)).alias("recall"),
    ).where("support > 0")


def classifier_metrics(pred):
    """Accuracy, support-weighted F1 and ROC AUC as a (metric, value) table."""
    per_class = per_class_metrics(pred)
    both = F.col("precision") + F.col("recall")
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), both), F.lit(0.0))
    total = F.sum("support")
    summary = per_class.agg(
        (F.sum(F.col("recall") * F.col("support")) / total).alias("accuracy"),
        (F.sum(f1 * F.col("support")) / total).alias("f1"),
    )
    basic = summary.unpivot([], ["accuracy", "f1"], "metric", "value")
    return basic.unionByName(_auc(pred).unpivot([], ["auc"], "metric", "value"))


def confusion_matrix(pred, labels=None):
    """Rows are actual labels, columns predicted ones; empty cells are 0.

    Without ``labels`` there is a column for every class that occurs. A list that
    leaves out a predicted class is an error.
    """
    predicted = F.col("prediction").cast("int")
    seen = {row[0] for row in pred.select(predicted).distinct().collect()} - {None}
    if labels is None:
        actual = pred.select(F.col("label").cast("int")).distinct().collect()
        labels = sorted(seen | {row[0] for row in actual} - {None})
    elif seen - set(labels):
        raise ValueError(f"predicted classes without a column: {sorted(seen - set(labels))}")
    columns = [F.count_if(predicted == value).alias(f"predicted_{value}") for value in labels]
    return pred.groupBy(F.col("label").cast("int").alias("label")).agg(*columns)
