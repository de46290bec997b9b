"""One query per operator, over the driver tables. Each takes (spark, sf_dir)."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contrast import fixtures as X
from contrast import settings as S
from contrast.functions import columns as C
from contrast.operators import classify, diff, matrix, moments, normalize, scaling, serving, target
from contrast.plans import flows
from contrast.plans.settle import scratch_path, settle
from contrast.sources import buckets, tables
from contrast.sources import matrix as text


def shown(df, digits=6, **special):
    """Comparable output: rounded doubles without negative zero, whole numbers as bigint."""
    columns = []
    for field in df.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, T.DoubleType):
            column = F.round(column, special.get(field.name, digits)) + F.lit(0.0)
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType)):
            column = column.cast("long")
        columns.append(column.alias(field.name))
    return df.select(*columns)


# --- sources and sinks -------------------------------------------------------


def _matrix_files(spark, sf_dir):
    path = scratch_path(spark, "matrix")
    text.write_matrix(X.events(spark, sf_dir), path)
    return text.read_matrix(spark, path)


def src_matrix_text(spark, sf_dir):
    return _matrix_files(spark, sf_dir).select("kind", "value")


def src_matrix_header(spark, sf_dir):
    return shown(text.header_positions(_matrix_files(spark, sf_dir)).select("pos", "sample_id"))


def src_labels_tsv(spark, sf_dir):
    path = scratch_path(spark, "labels")
    tables.write_pairs(X.event_labels(spark, sf_dir), path)
    return tables.read_pairs(spark, path, ["sample_id", "sample_type"])


def matrix_to_long(spark, sf_dir):
    return text.matrix_to_long(_matrix_files(spark, sf_dir))


def label_filter(spark, sf_dir):
    cells = text.matrix_to_long(_matrix_files(spark, sf_dir))
    return text.label_samples(cells, X.event_labels(spark, sf_dir))


def label_distribution(spark, sf_dir):
    return tables.label_distribution(X.terms(spark, sf_dir, by_language=True, packed=True))


def sink_long_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "long")
    tables.write_long(X.retail(spark, sf_dir, by_region=True), path)
    return tables.read_long(spark, path).select(*X.LONG)


def sink_csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "csv")
    tested = diff.diff_core(X.contrast_of(X.terms(spark, sf_dir)), implicit_zeros=True)
    result = tested.select("cohort", "feature_id", "log2fc", "t_stat", "n_case", "n_control")
    tables.export_csv(result.orderBy("cohort", "feature_id"), path)
    return shown(tables.read_csv_result(spark, path, result.schema))


def audit_long(spark, sf_dir):
    return tables.audit_long(X.terms(spark, sf_dir, by_language=True))


def feature_bucket(spark, sf_dir):
    names = X.terms(spark, sf_dir).select("feature_id").distinct()
    return shown(names.withColumn("bucket", C.stable_bucket("feature_id")))


# --- normalisation and differential analysis ---------------------------------


def _contrast(spark, sf_dir, by_language=False):
    return X.contrast_of(X.terms(spark, sf_dir, by_language, packed=True))


def library_size(spark, sf_dir):
    return normalize.library_size(X.terms(spark, sf_dir))


def log_cpm(spark, sf_dir):
    cells = normalize.log_cpm(X.terms(spark, sf_dir))
    return shown(cells.select("feature_id", "sample_id", "lib_size", "cpm", "logcpm"))


def expressed_features(spark, sf_dir):
    return shown(normalize.expressed_features(_contrast(spark, sf_dir, by_language=True)))


def densify(spark, sf_dir):
    return matrix.densify(X.retail(spark, sf_dir, by_region=True))


def group_moments(spark, sf_dir):
    long = X.contrast_of(X.retail(spark, sf_dir, by_region=True))
    return shown(moments.feature_moments(long, implicit_zeros=True))


def welch_t(spark, sf_dir):
    tested = diff.diff_core(_contrast(spark, sf_dir), implicit_zeros=True)
    return shown(tested.select("feature_id", "log2fc", "t_stat", "df"))


def t_pvalue(spark, sf_dir):
    long = X.contrast_of(X.retail(spark, sf_dir, by_region=True))
    tested = moments.with_pvalue(diff.diff_core(long, implicit_zeros=True))
    return shown(tested.select("cohort", "feature_id", "t_stat", "df", "pvalue"))


def bh_fdr(spark, sf_dir):
    """Heavily tied p-values over all order lines: eleven values per cohort."""
    tests = X.table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("cohort"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("feature_id"),
        (F.col("l_discount") / F.lit(0.1)).alias("pvalue"),
    )
    return shown(moments.bh_fdr(tests))


def diff_analysis(spark, sf_dir):
    return shown(diff.diff_analysis(_contrast(spark, sf_dir), implicit_zeros=True))


def _by_language(spark, sf_dir):
    return diff.diff_analysis(_contrast(spark, sf_dir, by_language=True), implicit_zeros=True)


def diff_by_cohort(spark, sf_dir):
    return shown(_by_language(spark, sf_dir))


def de_summary(spark, sf_dir):
    return diff.de_summary(_by_language(spark, sf_dir))


_REPORT = ["cohort", "feature_id", "log2fc", "pvalue", "fdr"]


def de_top_p(spark, sf_dir):
    return shown(diff.top_by_pvalue(_by_language(spark, sf_dir)).select(*_REPORT))


def de_top_up(spark, sf_dir):
    return shown(diff.strongest_up(_by_language(spark, sf_dir)).select(*_REPORT))


def de_top_down(spark, sf_dir):
    return shown(diff.strongest_down(_by_language(spark, sf_dir)).select(*_REPORT))


# --- target side -------------------------------------------------------------


def baseline_profile(spark, sf_dir):
    long = X.baseline_of(X.terms(spark, sf_dir, by_language=True, packed=True))
    return shown(target.baseline_profile(long, implicit_zeros=True))


def effect_baseline_join(spark, sf_dir):
    long = X.terms(spark, sf_dir, by_language=True, packed=True)
    effects = diff.diff_core(X.contrast_of(long), implicit_zeros=True)
    baseline = target.baseline_profile(X.baseline_of(long), implicit_zeros=True)
    joined = target.effect_baseline_join(effects, baseline)
    return shown(
        joined.select(
            "cohort", "feature_id", "log2fc", "baseline_mean_logcpm", "baseline_median_logcpm"
        )
    )


def stored_join(spark, sf_dir):
    """Effects and baseline joined from two tables in buckets of the feature."""
    long = X.terms(spark, sf_dir, by_language=True, packed=True)
    sides = {
        "effects": diff.diff_core(X.contrast_of(long), implicit_zeros=True),
        "profile": target.baseline_profile(X.baseline_of(long), implicit_zeros=True),
    }
    stored = []
    for name, side in sides.items():
        path = scratch_path(spark, name)
        buckets.write_bucketed(side, path, target.FEATURE, buckets=8)
        stored.append(buckets.read_bucketed(spark, path))
    joined = target.effect_baseline_join(*stored)
    return shown(
        joined.select(
            "cohort", "feature_id", "log2fc", "baseline_mean_logcpm", "baseline_median_logcpm"
        )
    )


def attach_symbol(spark, sf_dir):
    customers = X.table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").cast("string").alias("feature_id"), "c_custkey"
    )
    return target.attach_symbol(customers, X.nation_symbols(spark, sf_dir))


def zscore(spark, sf_dir):
    customers = X.table(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("cohort"), "c_custkey", "c_acctbal"
    )
    return shown(target.zscore(customers, {"c_acctbal": "z_acctbal"}))


def _scores(spark, sf_dir, halves=False, safe_quantile=None):
    """One sample table serves both sides: a document is in one of the groups only."""
    long = X.terms(spark, sf_dir, by_language=True, halves=halves, packed=True)
    samples = normalize.sample_table(long)
    effects = diff.diff_analysis(X.contrast_of(long), implicit_zeros=True, samples=X.contrast_of(samples))
    baseline = target.baseline_profile(X.baseline_of(long), implicit_zeros=True, samples=X.baseline_of(samples))
    return target.target_score(effects, baseline, X.term_symbols(spark, sf_dir), safe_quantile)


def target_score(spark, sf_dir):
    return shown(_scores(spark, sf_dir))


def volcano_points(spark, sf_dir):
    points = target.volcano_points(_by_language(spark, sf_dir), X.term_symbols(spark, sf_dir))
    return shown(points, neglog10p=3)


def volcano_labels(spark, sf_dir):
    de = settle(_by_language(spark, sf_dir), "de")
    labels = target.volcano_labels(target.volcano_points(de, X.term_symbols(spark, sf_dir)))
    return labels.select("cohort", "feature_id", "symbol", "side")


def quadrant(spark, sf_dir):
    zoned = target.quadrant(_scores(spark, sf_dir, safe_quantile=S.SAFE_QUANTILE))
    return shown(
        zoned.select(
            "cohort", "feature_id", "log2fc", "fdr", "baseline_mean_logcpm", "safe_max", "zone"
        )
    )


def quadrant_labels(spark, sf_dir):
    zoned = target.quadrant(_scores(spark, sf_dir, safe_quantile=S.SAFE_QUANTILE))
    labels = target.quadrant_labels(zoned)
    return shown(
        labels.select("cohort", "feature_id", "symbol", "zone", "log2fc", "baseline_mean_logcpm")
    )


def verdict(spark, sf_dir):
    judged = target.verdict(_scores(spark, sf_dir, safe_quantile=S.SAFE_QUANTILE))
    return shown(judged.select("cohort", "feature_id", "symbol", "target_score", "verdict"))


_TARGETS = ["cohort", "symbol", "log2fc", "baseline_mean_logcpm", "target_score"]


def top_candidates(spark, sf_dir):
    return shown(target.top_candidates(_scores(spark, sf_dir)).select(*_TARGETS))


def top_danger(spark, sf_dir):
    return shown(target.top_danger(_scores(spark, sf_dir)).select(*_TARGETS))


def recurrence(spark, sf_dir):
    """Candidates that recur in both halves of a language, or in several languages."""
    judged = target.verdict(_scores(spark, sf_dir, halves=True), X.RECURRENCE_LIMIT)
    return shown(target.recurrence(judged, min_cohorts=2))


# --- serving -----------------------------------------------------------------


def _documents(spark, sf_dir):
    path = scratch_path(spark, "profiles")
    scores = _scores(spark, sf_dir, safe_quantile=S.SAFE_QUANTILE)
    tables.write_profiles(serving.profiles(scores), path)
    return tables.read_profiles(spark, path)


def serve_profiles(spark, sf_dir):
    return shown(
        _documents(spark, sf_dir).select(
            "cohort",
            "feature_id",
            "symbol",
            F.col("efficacy.log2fc").alias("efficacy_log2fc"),
            F.col("efficacy.fdr").alias("efficacy_fdr"),
            F.col("safety.baseline_mean_logcpm").alias("safety_baseline"),
            "target_score",
            "verdict",
        )
    )


def serve_lookup(spark, sf_dir):
    """Looks up every word of the part names, in mixed case; most are unknown."""
    words = X.table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word"))
    known = X.table(spark, sf_dir, "benchmark").select(
        F.explode(F.split("text", X.WORD_BREAK)).alias("word")
    )
    keys = words.unionByName(known).where("word <> ''").distinct()
    found = serving.lookup(_documents(spark, sf_dir), keys.select(F.col("word").alias("symbol")))
    return shown(found)


def serve_top_candidates(spark, sf_dir):
    best = serving.top_candidates(_documents(spark, sf_dir))
    return shown(best.select("cohort", "symbol", "target_score", F.col("efficacy.log2fc").alias("log2fc")))


def serve_top_danger(spark, sf_dir):
    worst = serving.top_danger(_documents(spark, sf_dir))
    baseline = F.col("safety.baseline_mean_logcpm").alias("baseline_mean_logcpm")
    return shown(worst.select("cohort", "symbol", "target_score", baseline))


def serve_stats(spark, sf_dir):
    return serving.serve_stats(_documents(spark, sf_dir))


# --- matrix ------------------------------------------------------------------


def _union(spark, sf_dir):
    """Contrast and baseline frames of fixture B, one domain per region."""
    long = X.retail(spark, sf_dir, by_region=True, features=X.BRAND_TYPE)
    return matrix.union_cohorts(
        [
            matrix.label_cohort(X.contrast_of(long), F.col("cohort")),
            matrix.label_cohort(X.baseline_of(long), F.col("cohort"), control_only=True),
        ]
    )


def union_cohorts(spark, sf_dir):
    return shown(_union(spark, sf_dir).drop("cohort", "group"))


def samples_per_group(spark, sf_dir):
    return matrix.samples_per_group(_union(spark, sf_dir))


def _collapsed(spark, sf_dir):
    """Sparse log-CPM cells of fixture B with brand and type merged to the brand."""
    long = X.retail(spark, sf_dir, features=X.BRAND_TYPE)
    cells = normalize.log_cpm(long).select("feature_id", "sample_id", "group", "logcpm")
    return long, normalize.collapse_versions(cells, implicit_zeros=True)


def strip_version_collapse(spark, sf_dir):
    return shown(_collapsed(spark, sf_dir)[1])


def top_variable(spark, sf_dir):
    long, cells = _collapsed(spark, sf_dir)
    n_samples = long.select("sample_id").distinct().count()
    return shown(matrix.top_variable(cells, n=10, n_samples=n_samples))


def pivot_matrix(spark, sf_dir):
    wide = matrix.pivot_matrix(X.events(spark, sf_dir), X.EVENT_TYPES)
    return shown(wide)


def wide_vectors(spark, sf_dir):
    """Vectors of fixture C, told by their size, sum and position-weighted sum."""
    cells = X.vectors(spark, sf_dir)
    vectors = matrix.wide_vectors(cells, X.vector_positions(cells), n=64, value="value")
    values = vector_to_array("features")
    weighted = F.transform(values, lambda value, i: value * (i + 1))
    add = (F.lit(0.0), lambda left, right: left + right)
    return shown(
        vectors.select(
            "sample_id",
            F.size(values).alias("n_features"),
            F.aggregate(values, *add).alias("total"),
            F.aggregate(weighted, *add).alias("weighted"),
        )
    )


def standardize_long(spark, sf_dir):
    cells = X.vectors(spark, sf_dir)
    scaled = matrix.standardize_long(cells, value="value")
    return shown(scaled.select("sample_id", "feature_id", "z"))


def _reduced(spark, sf_dir, k=S.SVD_COMPONENTS):
    cells = X.vectors(spark, sf_dir)
    vectors = matrix.wide_vectors(cells, X.vector_positions(cells), n=64, value="value")
    reduced, _ = matrix.svd_features(vectors, k)
    labels = cells.select("sample_id", "domain", "is_case").distinct()
    return reduced.join(labels, "sample_id")


def svd_features(spark, sf_dir):
    return shown(matrix.flatten_components(_reduced(spark, sf_dir), S.SVD_COMPONENTS))


def svd_scores_norm(spark, sf_dir):
    """With all components, the scaled scores hold the variance of every position."""
    cells = X.vectors(spark, sf_dir)
    vectors = matrix.wide_vectors(cells, X.vector_positions(cells), n=64, value="value")
    reduced, sigma = matrix.svd_features(vectors, 64)
    scales = spark.createDataFrame(list(enumerate(sigma)), "component int, sigma double")
    parts = reduced.select(F.posexplode("svd").alias("component", "u")).join(F.broadcast(scales), "component")
    energy = F.sum(F.col("u") * F.col("u") * F.col("sigma") * F.col("sigma"))
    return shown(
        parts.agg(F.count_distinct("component").alias("n_components"), energy.alias("energy"))
    )


def svd_gramian(spark, sf_dir):
    """V, squared singular values and V again give the correlations of the positions."""
    cells = X.vectors(spark, sf_dir)
    vectors = matrix.wide_vectors(cells, X.vector_positions(cells), n=64, value="value")
    loadings = settle(matrix.svd_loadings(vectors, 64), "loadings")
    one = loadings.select("component", F.col("pos").alias("i"), (F.col("loading") * F.col("sigma")).alias("a"))
    two = loadings.select("component", F.col("pos").alias("j"), (F.col("loading") * F.col("sigma")).alias("b"))
    together = one.join(two, "component").groupBy("i", "j")
    return shown(together.agg(F.sum(F.col("a") * F.col("b")).alias("value")))


def svd_row_energy(spark, sf_dir):
    """With all components, the scaled scores of a sample have the length of its row."""
    cells = X.vectors(spark, sf_dir)
    vectors = matrix.wide_vectors(cells, X.vector_positions(cells), n=64, value="value")
    reduced, sigma = matrix.svd_features(vectors, 64)
    scales = F.array(*(F.lit(value) for value in sigma))
    scaled = F.zip_with("svd", scales, lambda u, s: u * u * s * s)
    energy = F.aggregate(scaled, F.lit(0.0), lambda left, right: left + right)
    return shown(reduced.select("sample_id", energy.alias("energy")))


def projection(spark, sf_dir):
    return shown(matrix.projection(_reduced(spark, sf_dir), 0, 2))


def reduced_cohorts(spark, sf_dir):
    """Fixture B through union, collapse, variable features, vectors and SVD."""
    long = X.retail(spark, sf_dir, by_region=True, features=X.BRAND_TYPE).where("group <> 'other'")
    labelled = flows.labelled_union(X.contrast_of(long), X.baseline_of(long))
    reduced, _, _ = flows.reduce_cohorts(labelled, n_features=20, k=10, implicit_zeros=True)
    return shown(matrix.flatten_components(reduced, 10))


def reduced_labels(spark, sf_dir):
    """Every sample of the reduced cohorts with its labels."""
    return shown(reduced_cohorts(spark, sf_dir).select("sample_id", "domain", "is_case", "group_label"))


# --- models ------------------------------------------------------------------


def train_test_split(spark, sf_dir):
    samples = X.vectors(spark, sf_dir).select("sample_id").distinct()
    return classify.train_test_split(samples)


def rf_reduced(spark, sf_dir):
    return classify.rf_reduced(_reduced(spark, sf_dir))


def rf_importance(spark, sf_dir):
    cells = X.vectors(spark, sf_dir)
    features = X.vector_positions(cells)
    vectors = matrix.wide_vectors(cells, features, n=64, value="value")
    labelled = vectors.join(cells.select("sample_id", "is_case").distinct(), "sample_id")
    model, _ = classify.rf_features(labelled)
    return classify.importances(model, features)


def rf_held_out(spark, sf_dir):
    """Held-out samples of the forest, and whether class and score of each agree."""
    pred = rf_reduced(spark, sf_dir)
    agrees = F.col("prediction") == (F.col("score") > 0.5).cast("double")
    sound = (F.col("score") >= 0) & (F.col("score") <= 1)
    # An exact half may go to either class.
    return shown(
        pred.select(
            "sample_id", F.col("label").cast("long").alias("label"), (sound & (agrees | (F.col("score") == 0.5))).alias("sound")
        )
    )


def rf_importance_total(spark, sf_dir):
    """Importances are shares: one for each position, none below 0, 1 in total."""
    ranked = rf_importance(spark, sf_dir)
    return shown(
        ranked.agg(
            F.count("*").alias("n_features"),
            F.sum("importance").alias("total"),
            F.count_if(F.col("importance") < 0).alias("n_negative"),
        )
    )


def classifier_metrics(spark, sf_dir):
    return shown(classify.classifier_metrics(X.predictions(spark, sf_dir)))


def per_class_metrics(spark, sf_dir):
    return shown(classify.per_class_metrics(X.predictions(spark, sf_dir)))


def confusion_matrix(spark, sf_dir):
    return shown(classify.confusion_matrix(X.predictions(spark, sf_dir)))


# --- scaling -----------------------------------------------------------------


def subsample_samples(spark, sf_dir):
    return scaling.subsample_samples(X.retail(spark, sf_dir, by_region=True), 0.25)


def subsample_diff(spark, sf_dir):
    long = X.contrast_of(X.retail(spark, sf_dir))
    return shown(scaling.subsample_diff(long, implicit_zeros=True))


def scaling_fit(spark, sf_dir):
    """Line through the nested subsamples, with the summed counts in place of seconds."""
    nested = scaling.subsample_nested(X.retail(spark, sf_dir))
    points = nested.groupBy("fraction").agg(
        F.count("*").alias("n_rows"), (F.sum("count") / F.lit(1000.0)).alias("seconds")
    )
    return shown(scaling.scaling_fit(settle(points, "points")))


QUERIES = {
    function.__name__: function
    for function in (
        src_matrix_text,
        src_matrix_header,
        src_labels_tsv,
        matrix_to_long,
        label_filter,
        label_distribution,
        sink_long_roundtrip,
        sink_csv_roundtrip,
        audit_long,
        feature_bucket,
        library_size,
        log_cpm,
        expressed_features,
        densify,
        group_moments,
        welch_t,
        t_pvalue,
        bh_fdr,
        diff_analysis,
        diff_by_cohort,
        de_summary,
        de_top_p,
        de_top_up,
        de_top_down,
        baseline_profile,
        effect_baseline_join,
        stored_join,
        attach_symbol,
        zscore,
        target_score,
        volcano_points,
        volcano_labels,
        quadrant,
        quadrant_labels,
        verdict,
        top_candidates,
        top_danger,
        recurrence,
        serve_profiles,
        serve_lookup,
        serve_top_candidates,
        serve_top_danger,
        serve_stats,
        union_cohorts,
        samples_per_group,
        strip_version_collapse,
        top_variable,
        pivot_matrix,
        wide_vectors,
        standardize_long,
        svd_features,
        svd_scores_norm,
        svd_gramian,
        svd_row_energy,
        projection,
        reduced_cohorts,
        reduced_labels,
        train_test_split,
        rf_reduced,
        rf_importance,
        rf_held_out,
        rf_importance_total,
        classifier_metrics,
        per_class_metrics,
        confusion_matrix,
        subsample_samples,
        subsample_diff,
        scaling_fit,
    )
}
