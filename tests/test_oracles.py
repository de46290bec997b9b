"""Registered queries against their SQL at the smallest scale.

A cross-section by default; ``CONTRAST_ALL=1`` runs every query.
"""

import os

import pytest

import __spark_entry__ as registry
import compare

SF_DIR = os.environ.get("CONTRAST_SF_DIR", "/root/testdata/sf0.001")
SAMPLE = [
    "matrix_to_long",
    "sink_long_roundtrip",
    "group_moments",
    "bh_fdr",
    "diff_by_cohort",
    "baseline_profile",
    "quadrant",
    "serve_lookup",
    "strip_version_collapse",
    "classifier_metrics",
    "subsample_diff",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")


@pytest.fixture(scope="module")
def connection():
    return compare.connect(SF_DIR)


@pytest.mark.parametrize(
    "name", list(registry.oracle_sql()) if os.environ.get("CONTRAST_ALL") else SAMPLE
)
def test_query_equals_sql(spark, connection, name):
    query, sql = registry.queries()[name], registry.oracle_sql()[name]
    problem, _, rows = compare.difference(spark, SF_DIR, name, query, sql, connection)
    assert not problem
    assert rows > 0


def test_entry_returns_rows(spark):
    frame = registry.entry(spark)
    assert frame.columns[:2] == ["cohort", "feature_id"]
    assert frame.count() > 0


@pytest.mark.parametrize("name", ["diff_by_cohort", "log_cpm", "quadrant", "subsample_diff"])
def test_plans_have_no_cross_join_and_no_single_task(spark, capsys, name):
    registry.queries()[name](spark, SF_DIR).explain()
    plan = capsys.readouterr().out
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "SinglePartition"):
        assert bad not in plan


def test_every_query_has_an_oracle_or_is_a_model():
    from contrast.oracles import ORACLES
    from contrast.queries import QUERIES

    without = set(QUERIES) - set(ORACLES)
    assert without <= {"rf_reduced", "rf_importance"}
