import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

# Names that the operators use inside; a table may have columns of the same names.
CLASH = ["fp", "node", "key", "h", "n", "secrets", "label", "text_hash", "bucket", "part", "row", "place", "id"]


@pytest.fixture(scope="session", autouse=True)
def workers(spark):
    from contrast.llm.common import importable

    importable(spark)


@pytest.fixture
def documents(spark):
    """Builds a table of documents from (doc_id, text[, source]) with clashing columns."""

    def build(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        table = spark.createDataFrame(full, schema)
        for name in CLASH:
            table = table.selectExpr("*", f"'x' AS `{name}`")
        return table

    return build


ODD = [
    (5, None),
    (7, ""),
    (7, ""),
    (9, " \n\t "),
    (None, "no id here"),
    (3, "one"),
    (3, "one"),
    (2, "é ß ñ 😀 words " * 3000),
]


@pytest.fixture
def odd():
    return list(ODD)


@pytest.fixture
def rows_of():
    def get(df):
        return [row.asDict() for row in df.collect()]

    return get
