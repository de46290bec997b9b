"""End-to-end jobs: from files to files, one Spark job chain each."""

from pyspark.sql import functions as F

from contrast import settings as S
from contrast.operators import classify, diff, matrix, normalize, serving, target
from contrast.plans.settle import settle
from contrast.sources import buckets, tables
from contrast.sources import matrix as text


def ingest(
    spark, matrix_path, labels_path, cohort, out, case=S.CASE_LABEL, control=S.CONTROL_LABEL
):
    """Matrix files and sample labels to the long table of one cohort."""
    cells = text.matrix_to_long(text.read_matrix(spark, matrix_path))
    labels = tables.read_pairs(spark, labels_path, ["sample_id", "sample_type"])
    labelled = text.label_samples(cells, labels, (case, control))
    tables.write_long(text.to_groups(labelled, cohort, case, control), out)
    return tables.audit_long(tables.read_long(spark, out, [cohort]))


def ingest_baseline(spark, matrix_path, cohort, out):
    """Matrix files of an unlabelled baseline cohort to its long table."""
    cells = text.matrix_to_long(text.read_matrix(spark, matrix_path))
    long = cells.select(
        F.lit(cohort).alias("cohort"), F.lit(S.BASELINE).alias("group"), "feature_id", "sample_id", "count"
    )
    tables.write_long(long, out)
    return tables.audit_long(tables.read_long(spark, out, [cohort]))


def _write_sorted(df, order, out, csv):
    tables.write_result(df.orderBy(*order), out)
    back = df.sparkSession.read.parquet(out)
    if csv:
        tables.export_csv(back.orderBy(*order), csv)
    return back


def differential(spark, long_path, out, csv=None, cohorts=None, by_feature=None, **options):
    """Differential results of the cohorts of a long table, sorted by p-value.

    ``options`` are those of ``diff_analysis``: sparse input and the expression filter.
    ``by_feature`` is the path of a second copy in buckets of the feature, for ``score``.
    """
    long = tables.read_long(spark, long_path, cohorts)
    de = _write_sorted(diff.diff_analysis(long, **options), ["cohort", "rank"], out, csv)
    if by_feature:
        buckets.write_bucketed(de, by_feature, target.FEATURE)
    return de


def profile(spark, baseline_path, out, implicit_zeros=False):
    """Baseline profile of a long table, in buckets of the feature."""
    baseline = target.baseline_profile(tables.read_long(spark, baseline_path), implicit_zeros)
    buckets.write_bucketed(baseline, out, target.FEATURE)
    return buckets.read_bucketed(spark, out)


def score(
    spark, diff_path, baseline_path, symbols_path, out, csv=None, implicit_zeros=False, stored=False
):
    """Target scores from differential results and the baseline long table.

    With ``stored`` both are tables in buckets of the feature, the baseline one from
    ``profile``; they are joined where they lie.
    """
    if stored:
        de, baseline = (buckets.read_bucketed(spark, path) for path in (diff_path, baseline_path))
    else:
        de = spark.read.parquet(diff_path)
        baseline = target.baseline_profile(tables.read_long(spark, baseline_path), implicit_zeros)
    symbols = tables.read_pairs(spark, symbols_path, ["feature_id", "symbol"])
    scores = target.target_score(de, baseline, symbols)
    return _write_sorted(scores, ["cohort", F.desc("target_score"), "feature_id"], out, csv)


def publish(spark, scores_path, out, safe_max=None):
    """Profile documents of the scored features."""
    documents = serving.profiles(spark.read.parquet(scores_path), safe_max)
    tables.write_profiles(documents, out)
    return tables.read_profiles(spark, out)


def domain_of(cohort):
    """Domain of a cohort; a cohort that is no known cancer is its own domain."""
    known = F.lit(None).cast("string")
    for name, domain in S.DOMAIN_OF_COHORT.items():
        known = F.when(F.col(cohort) == name, domain).otherwise(known)
    return F.coalesce(known, cohort)


def labelled_union(long, baseline):
    """Contrast and baseline long tables with their domains and case flags."""
    domain = domain_of("cohort")
    return matrix.union_cohorts(
        [
            matrix.label_cohort(long, domain),
            matrix.label_cohort(baseline, domain, control_only=True),
        ]
    )


def feature_vectors(labelled, n_features=S.TOP_FEATURES, implicit_zeros=False):
    """Vectors of the most variable features, those features, and the sample labels.

    With ``implicit_zeros`` the table is sparse and a missing cell is a count of 0.
    """
    names = ["sample_id", "group_label", "domain", "is_case"]
    labels = settle(labelled.select(*names).distinct(), "labels")
    cells = normalize.log_cpm(labelled).select("feature_id", *names, "logcpm")
    cells = normalize.collapse_versions(cells, implicit_zeros=implicit_zeros)
    n_samples = labels.count() if implicit_zeros else None
    features = matrix.top_variable(cells, n_features, n_samples=n_samples)
    everyone = labels if implicit_zeros else None
    vectors = matrix.wide_vectors(cells, features, features.count(), samples=everyone)
    return vectors, features, labels


def reduce_cohorts(
    labelled, n_features=S.TOP_FEATURES, k=S.SVD_COMPONENTS, implicit_zeros=False
):
    """Truncated SVD of the sample by feature matrix, with the labels of each sample."""
    vectors, _, labels = feature_vectors(labelled, n_features, implicit_zeros)
    reduced, sigma = matrix.svd_features(vectors, k)
    return reduced.join(labels, "sample_id"), sigma, labels


def reduce(
    spark, long_path, baseline_path, out, labels_out, n_features, k, implicit_zeros=False
):
    union = labelled_union(
        tables.read_long(spark, long_path), tables.read_long(spark, baseline_path)
    )
    reduced, sigma, labels = reduce_cohorts(union, n_features, k, implicit_zeros)
    tables.write_result(reduced, out)
    tables.write_result(labels, labels_out)
    return spark.read.parquet(out), sigma


def classify_reduced(spark, reduced_path, out):
    """Forest on reduced features; predictions and the metric table."""
    pred = classify.rf_reduced(spark.read.parquet(reduced_path))
    tables.write_result(pred, out)
    return spark.read.parquet(out)


def classify_features(
    spark, long_path, baseline_path, out, importance_out, n_features, implicit_zeros=False
):
    """Forest on the features themselves; predictions and ranked importances."""
    union = labelled_union(
        tables.read_long(spark, long_path), tables.read_long(spark, baseline_path)
    )
    vectors, features, labels = feature_vectors(union, n_features, implicit_zeros)
    data = vectors.join(labels.select("sample_id", "is_case"), "sample_id")
    model, pred = classify.rf_features(data)
    tables.write_result(pred, out)
    tables.write_result(classify.importances(model, features), importance_out)
    return spark.read.parquet(out)
