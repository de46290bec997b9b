import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from contrast.session import build_session

    session = build_session(
        "tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="6g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def long_of(spark):
    """Long table from {feature: {sample: count}} and {sample: group}."""

    def build(counts, groups, cohort="c"):
        rows = [
            (cohort, groups[sample], feature, sample, count)
            for feature, cells in counts.items()
            for sample, count in cells.items()
        ]
        schema = "cohort string, group string, feature_id string, sample_id string, count long"
        return spark.createDataFrame(rows, schema)

    return build
