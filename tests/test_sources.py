import gzip

import pytest

from contrast.sources import matrix as text
from contrast.sources import tables


def write(path, content):
    path.write_text(content)
    return str(path)


def cells(df):
    return {(r.feature_id, r.sample_id): r["count"] for r in df.collect()}


MATRIX = "##made by hand\ngene_id\ts1\ts2\ts3\nf1\t1\t2\t3\nf2\t0\t\tx\nf3\t7\nf4\t1\t2\t3\t4\n"


def test_matrix_to_long_edges(spark, tmp_path):
    raw = text.read_matrix(spark, write(tmp_path / "m.tsv", MATRIX))
    got = cells(text.matrix_to_long(raw))
    assert got[("f1", "s2")] == 2
    # Blank and non-numeric counts are NULL, a short row has fewer cells, surplus is ignored.
    assert got[("f2", "s2")] is None and got[("f2", "s3")] is None
    assert [s for f, s in got if f == "f3"] == ["s1"]
    assert sorted(s for f, s in got if f == "f4") == ["s1", "s2", "s3"]
    assert [r.sample_id for r in text.header_positions(raw).orderBy("pos").collect()] == [
        "s1",
        "s2",
        "s3",
    ]


def test_many_files_each_with_its_own_header(spark, tmp_path):
    write(tmp_path / "a.tsv", "gene_id\ts1\ts2\nf1\t1\t2\n")
    write(tmp_path / "b.tsv", "##c\ngene_id\ts9\nf1\t5\n")
    got = cells(text.matrix_to_long(text.read_matrix(spark, str(tmp_path))))
    assert got == {("f1", "s1"): 1, ("f1", "s2"): 2, ("f1", "s9"): 5}


def test_gzip_matrix(spark, tmp_path):
    with gzip.open(tmp_path / "m.tsv.gz", "wt") as out:
        out.write(MATRIX)
    raw = text.read_matrix(spark, str(tmp_path / "m.tsv.gz"))
    assert cells(text.matrix_to_long(raw))[("f1", "s3")] == 3


def test_compressed_files_are_read_once(spark, tmp_path, monkeypatch):
    """Spoiled after the first read, a packed file gives all its cells, also beside a plain one."""
    packed, real, seen = tmp_path / "m.tsv.gz", text.settle, []

    def fill():
        with gzip.open(packed, "wt") as out:
            lines = (f"f{i}\t{i}\t{i * i}\n" for i in range(2000))
            out.write("##c\ngene_id\ts1\ts2\n" + "".join(lines))

    def counted(df, label, **options):
        table = real(df, label, **options)
        seen.append(label)
        if label == "lines":
            packed.write_bytes(b"x" * packed.stat().st_size)
        return table

    fill()
    write(tmp_path / "n.tsv", "gene_id\ts9\nf1\t5\n")
    monkeypatch.setattr(text, "settle", counted)
    monkeypatch.setattr(text, "ROW_GROUP", 4096)
    got = cells(text.matrix_to_long(text.read_matrix(spark, str(tmp_path))))
    assert got[("f1999", "s2")] == 1999**2 and got[("f1", "s9")] == 5 and len(got) == 4001
    fill()
    alone = text.matrix_to_long(text.read_matrix(spark, str(packed)))
    assert alone.count() == 4000 and seen == ["lines", "headers"] * 2


def test_missing_header_fails(spark, tmp_path):
    raw = text.read_matrix(spark, write(tmp_path / "m.tsv", "##only\nf1\t1\t2\n"))
    with pytest.raises(Exception, match="no header line"):
        text.matrix_to_long(raw).collect()


def test_labels_keep_two_classes_only(spark, tmp_path):
    long = spark.createDataFrame(
        [("f", "s1", 1), ("f", "s2", 2), ("f", "s3", 3), ("f", "s4", 4)],
        "feature_id string, sample_id string, count long",
    )
    path = write(
        tmp_path / "l.tsv", "s1\tPrimary Tumor\ns2\tSolid Tissue Normal\ns3\tMetastatic\n"
    )
    labels = tables.read_pairs(spark, path, ["sample_id", "sample_type"])
    grouped = text.to_groups(text.label_samples(long, labels), "c")
    assert {(r.sample_id, r.group) for r in grouped.collect()} == {
        ("s1", "case"),
        ("s2", "control"),
    }


@pytest.mark.parametrize("block", [2, 3, 1024])
def test_matrix_round_trip_with_blocks(spark, tmp_path, long_of, block):
    groups = {f"s{i}": "case" for i in range(5)}
    counts = {"f1": {"s0": 3, "s4": 1}, "f2": {"s2": 8}, "f3": {s: 1 for s in groups}}
    path = str(tmp_path / "out")
    text.write_matrix(long_of(counts, groups), path, block=block)
    got = cells(text.matrix_to_long(text.read_matrix(spark, path + "/*/*")))
    assert got == {(f, s): counts[f].get(s, 0) for f in counts for s in groups}


def test_write_long_replaces_only_its_cohorts(spark, tmp_path, long_of):
    path = str(tmp_path / "long")
    groups = {"s1": "case", "s2": "control"}
    tables.write_long(long_of({"f": {"s1": 1, "s2": 2}}, groups, "a"), path)
    tables.write_long(long_of({"f": {"s1": 5}}, groups, "b"), path)
    tables.write_long(long_of({"f": {"s1": 9}}, groups, "a"), path)
    back = tables.read_long(spark, path)
    assert {(r.cohort, r.sample_id, r["count"]) for r in back.collect()} == {
        ("a", "s1", 9),
        ("b", "s1", 5),
    }
    only = tables.read_long(spark, path, ["b"])
    assert only.count() == 1
    assert "PartitionFilters: [isnotnull(cohort" in only._jdf.queryExecution().toString()


def test_write_long_by_feature_bucket(spark, tmp_path, long_of):
    path = str(tmp_path / "bucketed")
    long = long_of({f"f{i}": {"s1": i} for i in range(9)}, {"s1": "case"}, "007")
    tables.write_long(long, path, feature_buckets=4)
    back = tables.read_long(spark, path, ["007"])
    assert sorted(r["count"] for r in back.collect()) == list(range(9))
    assert len(list((tmp_path / "bucketed" / "cohort=007").glob("feature_bucket=*"))) > 1


def test_csv_columns_are_found_by_name(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.1), (2, None)], "a long, b double")
    path = str(tmp_path / "csv")
    tables.export_csv(df.select("b", "a"), path)
    back = tables.read_csv_result(spark, path, "a long, b double")
    assert back.orderBy("a").collect() == df.collect()
    with pytest.raises(ValueError, match="no column c"):
        tables.read_csv_result(spark, path, "a long, c double")


def test_long_table_with_buckets_keeps_its_columns(spark, tmp_path, long_of):
    long = long_of({f"f{i}": {"s1": i} for i in range(9)}, {"s1": "case"})
    tables.write_long(long, str(tmp_path / "plain"))
    tables.write_long(long, str(tmp_path / "buckets"), feature_buckets=3)
    plain, buckets = (tables.read_long(spark, str(tmp_path / name)) for name in ("plain", "buckets"))
    assert plain.unionByName(buckets).count() == 18
    parts = [tables.read_long(spark, str(tmp_path / "buckets"), bucket=b).count() for b in range(3)]
    assert sum(parts) == 9 and max(parts) < 9


def test_words_of_any_script(spark):
    from contrast.fixtures import WORD_BREAK
    from pyspark.sql import functions as F

    text = spark.createDataFrame([("Été, größe señor; naı\u0308ve x2y",)], "t string")
    words = text.select(F.split(F.lower("t"), WORD_BREAK).alias("w")).first()["w"]
    assert words == ["été", "größe", "señor", "naı\u0308ve", "x", "y"]


def test_audit(spark, long_of):
    long = long_of({"f": {"s1": 1, "s2": 2}, "g": {"s1": 0}}, {"s1": "case", "s2": "control"})
    row = tables.audit_long(long).first()
    assert (row.n_rows, row.n_features, row.n_samples) == (3, 2, 2)
    split = {r.group: r.n_samples for r in tables.label_distribution(long).collect()}
    assert split == {"case": 1, "control": 1}


def test_audit_counts_nulls_as_before_and_expands_nothing(spark, capsys):
    rows = [("a", "f", "s"), ("a", "f", "t"), ("a", None, "s"), (None, "g", None), (None, "g", "s"), ("b", None, None)]
    long = spark.createDataFrame(rows, "cohort string, feature_id string, sample_id string")
    audit = tables.audit_long(long)
    got = {tuple(r) for r in audit.collect()}
    assert got == {("a", 3, 1, 2), (None, 2, 1, 1), ("b", 1, 0, 0)}
    audit.explain()
    assert "Expand" not in capsys.readouterr().out
    assert tables.audit_long(long.limit(0)).count() == 0
