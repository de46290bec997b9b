"""The command line jobs on a small hand-built study, from text files to lookups."""

import gzip

import numpy as np
import pytest

from contrast.__main__ import main

FEATURES = [f"G{i:02d}.{i % 3}" for i in range(30)] + ["X.1", "X.2_PAR_Y"]


def matrix_file(path, samples, boost, rng):
    lines = ["##annotation=hand", "\t".join(["gene_id", *samples])]
    for i, feature in enumerate(FEATURES):
        rates = [(200 + 40 * i) * (6 if i < 5 and s in boost else 1) for s in samples]
        lines.append("\t".join([feature, *(str(int(rng.poisson(r))) for r in rates)]))
    with gzip.open(path, "wt") as out:
        out.write("\n".join(lines) + "\n")


@pytest.fixture(scope="module")
def study(tmp_path_factory):
    root = tmp_path_factory.mktemp("study")
    rng = np.random.default_rng(11)
    for cohort in ("BRCA", "LUAD"):
        case = [f"{cohort}t{i}" for i in range(14)]
        control = [f"{cohort}n{i}" for i in range(8)]
        matrix_file(root / f"{cohort}.gz", case + control + [f"{cohort}m"], set(case), rng)
        kinds = [(s, "Primary Tumor") for s in case] + [(s, "Solid Tissue Normal") for s in control]
        kinds.append((f"{cohort}m", "Metastatic"))
        (root / f"{cohort}.tsv").write_text("".join(f"{s}\t{k}\n" for s, k in kinds))
        matrix_file(root / f"{cohort}_base.gz", [f"{cohort}b{i}" for i in range(9)], set(), rng)
    (root / "map.tsv").write_text("G00.0\tAlpha\nG01.1\tBeta\n")
    return root


def test_all_jobs(spark, study, capsys):
    at = lambda name: str(study / name)

    def run(*arguments):
        main(list(arguments), spark)

    for cohort in ("BRCA", "LUAD"):
        run("ingest", "--matrix", at(f"{cohort}.gz"), "--labels", at(f"{cohort}.tsv"), "--cohort", cohort, "--out", at("long"))
        run("ingest-baseline", "--matrix", at(f"{cohort}_base.gz"), "--cohort", cohort, "--out", at("base"))
    long = spark.read.parquet(at("long"))
    assert long.count() == 2 * 22 * len(FEATURES)
    assert long.where("sample_id like '%m'").count() == 0

    run("differential", "--long", at("long"), "--out", at("de"), "--csv", at("de_csv"))
    de = spark.read.parquet(at("de"))
    top = {r.feature_id for r in de.where("fdr < 0.05 and log2fc > 1").collect()}
    assert top == set(FEATURES[:5])

    run("score", "--diff", at("de"), "--baseline", at("base"), "--symbols", at("map.tsv"), "--out", at("scores"), "--csv", at("scores_csv"))
    assert spark.read.parquet(at("scores")).count() == 2 * len(FEATURES)
    # The same scores from stored sides in buckets.
    run("differential", "--long", at("long"), "--out", at("de_again"), "--by-feature", at("de_by_feature"))
    run("profile", "--baseline", at("base"), "--out", at("profile"))
    run("score", "--diff", at("de_by_feature"), "--baseline", at("profile"), "--stored", "--symbols", at("map.tsv"), "--out", at("scores_stored"))
    columns = ["cohort", "feature_id", "symbol", "round(target_score, 9)"]
    stored = spark.read.parquet(at("scores_stored")).selectExpr(*columns)
    assert stored.exceptAll(spark.read.parquet(at("scores")).selectExpr(*columns)).count() == 0
    assert stored.count() == 2 * len(FEATURES)
    run("volcano", "--diff", at("de"), "--symbols", at("map.tsv"), "--out", at("volcano"))
    run("quadrant", "--scores", at("scores"), "--out", at("quadrant"))
    run("recurrence", "--scores", at("scores"), "--out", at("recurring"), "--min-cohorts", "2")
    recurring = spark.read.parquet(at("recurring"))
    assert sorted(r["rank"] for r in recurring.collect()) == list(range(1, recurring.count() + 1))
    run("publish", "--scores", at("scores"), "--out", at("profiles"))
    capsys.readouterr()
    run("lookup", "--profiles", at("profiles"), "alpha", "unknown")
    shown = capsys.readouterr().out
    assert "candidate" in shown and "unknown" in shown
    run("lookup", "--profiles", at("profiles"))

    run("scale", "--long", at("long"), "--out", at("scaling"))
    # The scaling table has no seconds, so it can't be fitted by mistake.
    with pytest.raises(ValueError, match="seconds"):
        run("fit", "--points", at("scaling"))
    run("reduce", "--long", at("long"), "--baseline", at("base"), "--out", at("svd"), "--labels-out", at("labels"), "--n-features", "20", "--components", "5")
    svd = spark.read.parquet(at("svd"))
    assert svd.count() == 2 * 31 and {len(r.svd) for r in svd.collect()} == {5}
    assert {r.group_label for r in svd.collect()} == {
        "BREAST-case", "BREAST-control", "LUNG-case", "LUNG-control",
    }
    run("classify-reduced", "--reduced", at("svd"), "--out", at("pred"), "--csv", at("metrics_csv"))
    run("classify-features", "--long", at("long"), "--baseline", at("base"), "--out", at("pred2"), "--importance-out", at("importance"), "--importance-csv", at("importance_csv"), "--n-features", "20")
    shown = capsys.readouterr().out
    assert "accuracy" in shown and "importances" in shown
    ranked = spark.read.parquet(at("importance"))
    assert ranked.count() == 20
    # The collapsed id is there without its versions.
    assert ranked.where("feature_id like '%.%'").count() == 0
    metrics = spark.read.csv(at("metrics_csv"), header=True)
    assert {r.metric for r in metrics.collect()} == {"accuracy", "f1", "auc"}


def test_fit_job(spark, tmp_path, capsys):
    (tmp_path / "points.csv").write_text(
        "fraction,n_samples,n_rows,n_features_tested,seconds\n"
        "0.1,10,1000000,5,9.0\n0.5,50,2000000,5,5.0\n1.0,100,4000000,5,9.0\n"
    )
    main(["fit", "--points", str(tmp_path / "points.csv")], spark)
    assert "2.0" in capsys.readouterr().out


def test_no_row_of_a_report_is_lost(spark, tmp_path, capsys):
    """More recurring features, cohorts and looked-up names than a preview shows."""
    rows = [
        (f"c{c}", f"f{i:02d}", f"S{i}", 2.0 + i / 100, 0.001, 0.1, 0.1, 1.0, 1.0, 1.0 + i)
        for c in range(6)
        for i in range(60)
    ]
    schema = (
        "cohort string, feature_id string, symbol string, log2fc double, fdr double, "
        "baseline_mean_logcpm double, baseline_median_logcpm double, z_effect double, "
        "z_baseline double, target_score double"
    )
    at = lambda name: str(tmp_path / name)
    spark.createDataFrame(rows, schema).write.parquet(at("scores"))
    main(["recurrence", "--scores", at("scores"), "--out", at("recurring"), "--safe-max", "1"], spark)
    ranked = spark.read.parquet(at("recurring")).orderBy("rank").collect()
    assert [r.feature_id for r in ranked] == [f"f{i:02d}" for i in reversed(range(60))]
    assert "60 rows, the first 25" in capsys.readouterr().out
    main(["publish", "--scores", at("scores"), "--out", at("profiles"), "--safe-max", "1"], spark)
    names = [f"s{i}" for i in range(60)] + [f"none{i}" for i in range(1440)]
    main(["lookup", "--profiles", at("profiles"), "--reports", at("found"), *names], spark)
    found = spark.read.parquet(at("found/profiles"))
    assert found.count() == 60 * 6 + 1440 and found.where("found").count() == 360
    main(["lookup", "--profiles", at("profiles"), "--reports", at("tops")], spark)
    assert spark.read.parquet(at("tops/top_candidates")).groupBy("cohort").count().count() == 6


def test_sparse_and_dense_tables_agree(spark, tmp_path, long_of):
    rng = np.random.default_rng(4)
    groups = {f"s{i}": "case" if i < 8 else "control" for i in range(16)}
    counts = {f"f{j}": {s: int(rng.poisson(3 * (j + 1))) for s in groups} for j in range(12)}
    at = lambda name: str(tmp_path / name)
    long_of(counts, groups).write.partitionBy("cohort").parquet(at("dense"))
    long_of(counts, groups).where("count > 0").write.partitionBy("cohort").parquet(at("sparse"))
    main(["differential", "--long", at("dense"), "--out", at("a")], spark)
    main(["differential", "--long", at("sparse"), "--out", at("b"), "--implicit-zeros"], spark)
    a, b = (spark.read.parquet(at(name)).orderBy("feature_id").toPandas() for name in "ab")
    np.testing.assert_allclose(a["pvalue"], b["pvalue"], rtol=1e-9)
