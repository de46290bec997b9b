"""Command line jobs: ``python -m contrast <job> ...`` or through spark-submit."""

import argparse

from pyspark.sql import functions as F

from contrast import settings as S
from contrast.operators import classify, diff, scaling, serving, target
from contrast.plans import flows
from contrast.session import build_session
from contrast.sources import tables


PREVIEW = 25


def _report(a, name, df, order=("cohort",)):
    """Preview of a report, in order; with ``--reports`` all of it goes to a folder there.

    The heading tells how many rows there are.
    """
    order = [key for key in order if not isinstance(key, str) or key in df.columns]
    if a.reports:
        path = f"{a.reports}/{name}"
        tables.write_result(df, path)
        df = df.sparkSession.read.parquet(path)
    rows = df.count()
    more = f", the first {PREVIEW}" if rows > PREVIEW else ""
    print(f"== {name.replace('_', ' ')}: {rows} rows{more}")
    (df.orderBy(*order) if order else df).show(PREVIEW, truncate=False)


def _options(a):
    return {"implicit_zeros": a.implicit_zeros, "min_cpm": a.min_cpm, "min_fraction": a.min_fraction}


def ingest(spark, a):
    audit = flows.ingest(spark, a.matrix, a.labels, a.cohort, a.out, a.case_label, a.control_label)
    _report(a, "long_table", audit)
    long = tables.read_long(spark, a.out, [a.cohort])
    _report(a, "samples_per_group", tables.label_distribution(long), ("cohort", "group"))


def ingest_baseline(spark, a):
    _report(a, "long_table", flows.ingest_baseline(spark, a.matrix, a.cohort, a.out))


def differential(spark, a):
    de = flows.differential(spark, a.long, a.out, a.csv, a.cohorts, a.by_feature, **_options(a))
    _report(a, "summary", diff.de_summary(de))
    _report(a, "smallest_p_values", diff.top_by_pvalue(de), ("cohort", "rank"))
    _report(a, "strongest_up", diff.strongest_up(de), ("cohort", F.desc("log2fc")))
    _report(a, "strongest_down", diff.strongest_down(de), ("cohort", "log2fc"))


def profile(spark, a):
    _report(a, "baseline_profile", flows.profile(spark, a.baseline, a.out, a.implicit_zeros), target.FEATURE)


def score(spark, a):
    scores = flows.score(spark, a.diff, a.baseline, a.symbols, a.out, a.csv, a.implicit_zeros, a.stored)
    best = ("cohort", F.desc("target_score"))
    _report(a, "top_candidates", target.top_candidates(scores), best)
    worst = ("cohort", F.desc("baseline_mean_logcpm"))
    _report(a, "up_but_high_at_baseline", target.top_danger(scores), worst)


def volcano(spark, a):
    symbols = tables.read_pairs(spark, a.symbols, ["feature_id", "symbol"])
    points = target.volcano_points(spark.read.parquet(a.diff), symbols)
    tables.write_result(points, a.out)
    labels = target.volcano_labels(spark.read.parquet(a.out))
    _report(a, "volcano_labels", labels, ("cohort", "side", "feature_id"))


def quadrant(spark, a):
    tables.write_result(target.quadrant(spark.read.parquet(a.scores)), a.out)
    labels = target.quadrant_labels(spark.read.parquet(a.out))
    _report(a, "quadrant_labels", labels, ("cohort", "zone", "feature_id"))


def recurrence(spark, a):
    judged = target.verdict(spark.read.parquet(a.scores), a.safe_max)
    tables.write_result(target.recurrence(judged, a.min_cohorts), a.out)
    _report(a, "recurring_candidates", spark.read.parquet(a.out), ("rank",))


def scale(spark, a):
    table = scaling.subsample_diff(tables.read_long(spark, a.long), implicit_zeros=a.implicit_zeros)
    tables.export_csv(table.orderBy("cohort", "fraction"), a.out)
    _report(a, "scaling_table", table, ("cohort", "fraction"))


def fit(spark, a):
    points = tables.read_csv_result(spark, a.points, "n_rows long, seconds double")
    _report(a, "scaling_fit", scaling.scaling_fit(points, a.corpus_rows), ())


def reduce(spark, a):
    _, sigma = flows.reduce(
        spark, a.long, a.baseline, a.out, a.labels_out, a.n_features, a.components, a.implicit_zeros
    )
    values = spark.createDataFrame(list(enumerate(sigma)), "component int, sigma double")
    _report(a, "singular_values", values, ("component",))


def _metrics(a, pred):
    _report(a, "metrics", classify.classifier_metrics(pred), ("metric",))
    _report(a, "confusion", classify.confusion_matrix(pred), ("label",))
    _report(a, "per_class", classify.per_class_metrics(pred), ("label",))
    if a.csv:
        tables.export_csv(classify.classifier_metrics(pred), a.csv)


def classify_reduced(spark, a):
    _metrics(a, flows.classify_reduced(spark, a.reduced, a.out))


def classify_features(spark, a):
    pred = flows.classify_features(
        spark, a.long, a.baseline, a.out, a.importance_out, a.n_features, a.implicit_zeros
    )
    _metrics(a, pred)
    ranked = spark.read.parquet(a.importance_out)
    order = (F.desc("importance"), "feature_id")
    if a.importance_csv:
        tables.export_csv(ranked.orderBy(*order), a.importance_csv)
    _report(a, "importances", ranked, order)


def publish(spark, a):
    documents = flows.publish(spark, a.scores, a.out, a.safe_max)
    _report(a, "verdicts", serving.serve_stats(documents))


def lookup(spark, a):
    documents = tables.read_profiles(spark, a.profiles)
    if a.symbols:
        _report(a, "profiles", serving.lookup_names(documents, a.symbols), ("wanted", "cohort", "feature_id"))
        return
    best = ("cohort", F.desc("target_score"))
    _report(a, "top_candidates", serving.top_candidates(documents), best)
    _report(a, "top_danger", serving.top_danger(documents), ("cohort", "feature_id"))
    _report(a, "stats", serving.serve_stats(documents))


def parser():
    root = argparse.ArgumentParser(prog="contrast", description=__doc__)
    jobs = root.add_subparsers(dest="job", required=True)

    def job(function, *required, **optional):
        sub = jobs.add_parser(function.__name__.replace("_", "-"))
        sub.set_defaults(run=function)
        sub.add_argument("--reports", help="folder for all rows of the printed reports")
        for name in required:
            sub.add_argument(f"--{name.replace('_', '-')}", required=True)
        for name, (kind, default) in optional.items():
            flag = f"--{name.replace('_', '-')}"
            if kind is bool:
                sub.add_argument(flag, action="store_true")
            else:
                sub.add_argument(flag, type=kind, default=default)
        return sub

    text = (str, None)
    top = (int, S.TOP_FEATURES)
    sparse = {"implicit_zeros": (bool, False)}
    expressed = {"min_cpm": (float, S.MIN_CPM), "min_fraction": (float, S.MIN_FRACTION)}
    kinds = {"case_label": (str, S.CASE_LABEL), "control_label": (str, S.CONTROL_LABEL)}
    job(ingest, "matrix", "labels", "cohort", "out", **kinds)
    job(ingest_baseline, "matrix", "cohort", "out")
    job(differential, "long", "out", csv=text, by_feature=text, **sparse, **expressed).add_argument("--cohorts", nargs="*")
    job(profile, "baseline", "out", **sparse)
    job(score, "diff", "baseline", "symbols", "out", csv=text, stored=(bool, False), **sparse)
    job(volcano, "diff", "symbols", "out")
    job(quadrant, "scores", "out")
    job(recurrence, "scores", "out", min_cohorts=(int, 5), safe_max=(float, None))
    job(scale, "long", "out", **sparse)
    job(fit, "points", corpus_rows=(int, S.CORPUS_ROWS))
    components = (int, S.SVD_COMPONENTS)
    job(reduce, "long", "baseline", "out", "labels_out", n_features=top, components=components, **sparse)
    job(classify_reduced, "reduced", "out", csv=text)
    job(
        classify_features, "long", "baseline", "out", "importance_out",
        n_features=top, csv=text, importance_csv=text, **sparse,
    )
    job(publish, "scores", "out", safe_max=(float, None))
    job(lookup, "profiles").add_argument("symbols", nargs="*")
    return root


def main(arguments=None, spark=None):
    parsed = parser().parse_args(arguments)
    parsed.run(spark or build_session(f"contrast-{parsed.job}"), parsed)


if __name__ == "__main__":
    main()
