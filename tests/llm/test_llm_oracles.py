"""The operators that SQL can express, against their SQL on driver tables and odd rows."""

import duckdb
import pytest

import compare
from contrast.llm import secrets
from contrast.llm.oracles import ORACLES
from contrast.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    connection = compare.connect(SF_DIR)
    problem, _, rows = compare.difference(spark, SF_DIR, name, QUERIES[name], ORACLES[name], connection)
    assert not problem and rows > 100


def test_secrets_of_odd_texts(documents, odd):
    from test_llm_secrets import TEXTS

    rows = odd + list(enumerate(TEXTS, 100))
    connection = duckdb.connect()
    connection.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    connection.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    ours = compare.spark_rows(secrets.secret_report(documents(rows)))
    assert ours == compare.duck_rows(connection, ORACLES["op1_secrets"])


def test_vectors_of_odd_shapes(spark):
    from contrast.llm import rotation
    from test_llm_rotation import ODD, SCHEMA

    connection = duckdb.connect()
    connection.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    connection.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", ODD)
    ours = compare.spark_rows(rotation.vector_groups(spark.createDataFrame(ODD, SCHEMA)))
    assert ours == compare.duck_rows(connection, ORACLES["op9_rotation_codes"])
