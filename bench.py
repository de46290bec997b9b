"""Times the headline queries and prints one JSON line.

One untimed run of the flagship starts the JVM and its compiler; every query is then
timed once, from the raw tables to its last row.

``sec_per_million_rows`` repeats the published scaling measurement: the core
differential workload on growing shares of the samples of a dense long table, and
the slope of a line from the second smallest share upward.
"""

import json
import os
import time

from contrast import fixtures as X
from contrast import settings as S
from contrast.operators import diff, matrix, scaling
from contrast.plans.settle import settle
from contrast.queries import QUERIES
from contrast.session import build_session

HEADLINE = [
    "diff_analysis",
    "diff_by_cohort",
    "group_moments",
    "bh_fdr",
    "baseline_profile",
    "target_score",
    "quadrant",
    "recurrence",
    "serve_profiles",
    "log_cpm",
    "matrix_to_long",
    "strip_version_collapse",
    "top_variable",
    "subsample_diff",
    "svd_features",
    "rf_reduced",
    "classifier_metrics",
]


def drain(df):
    df.write.format("noop").mode("overwrite").save()


def timed(action):
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def scaling_points(spark, sf_dir):
    """(million rows, seconds) of the core workload per sample fraction."""
    long = X.contrast_of(X.retail(spark, sf_dir, features=("p_brand", "p_size")))
    # Sixteen feature buckets, as a long table on disk has.
    dense = settle(matrix.densify(long).repartition(S.FEATURE_BUCKETS, "feature_id"), "dense")
    points = []
    drain(diff.diff_core(dense))
    for fraction in S.SCALING_FRACTIONS:
        part = settle(
            scaling.subsample_samples(dense, fraction).repartition(S.FEATURE_BUCKETS, "feature_id"),
            "part",
        )
        rows = part.count()
        seconds = min(timed(lambda: drain(diff.diff_core(part))) for _ in range(2))
        points.append((fraction, rows, seconds))
    return spark.createDataFrame(points, "fraction double, n_rows long, seconds double")


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"),
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    drain(QUERIES["diff_analysis"](spark, sf_dir))
    seconds = {name: timed(lambda q=QUERIES[name]: drain(q(spark, sf_dir))) for name in HEADLINE}
    points = scaling_points(spark, sf_dir)
    fit = scaling.scaling_fit(points).first()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
                "sec_per_million_rows": round(fit["sec_per_million_rows"], 4),
                "fixed_seconds": round(fit["fixed_seconds"], 3),
                "scaling": [[row["n_rows"], row["seconds"]] for row in points.collect()],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
