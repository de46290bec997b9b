import math
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from contrast.llm import mixing as M
from contrast.llm.oracles import ORACLES


def corpus():
    sizes = {"big": 160, "mid": 40, "small": 12, "tiny": 3, None: 5}
    rows, key = [], 0
    for source, n in sizes.items():
        for i in range(n):
            rows.append((key, "w " * (1 + i * 7 % 23), source))
            key += 1
    return [*rows, (3, None, "big"), (3, None, "big"), (None, "", "small"), (None, "", "small"), (9000, " \t\n", "mid")]


def test_draws_equal_the_sql(documents):
    table = documents(corpus())
    got = sorted(tuple(str(r[c]) for c in ("doc_id", "source", "pass", "block", "place")) for r in M.mix_report(table).collect())
    connection = duckdb.connect()
    connection.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    connection.executemany("INSERT INTO documents VALUES (?, ?, ?)", [r for r in corpus()])
    result = connection.execute(f"SELECT doc_id, source, pass, block, place FROM ({ORACLES['op8_mixing']})").fetchall()
    assert got == sorted(tuple(str(v) for v in row) for row in result)
    assert max(int(r[2]) for r in got) >= 1


@pytest.mark.parametrize("entropy, repeats", [(0.95, 1.5), (0.9, 100.0), (0.999, 4.0), (0.1, 2.0)])
def test_targets_are_met(documents, entropy, repeats):
    rows = M.settle(M.source_rows(documents(corpus())), "mix")
    got = M.source_weights(rows, entropy, repeats).collect()
    total = sum(r["weight"] for r in got)
    assert total == pytest.approx(1)
    most = max(r["target"] / r["tokens"] for r in got)
    assert most <= repeats + 0.51 and all(r["target"] >= r["tokens"] for r in got)
    h = -sum(r["weight"] * math.log(r["weight"]) for r in got)
    exponent = got[0]["exponent"]
    shares = [r["tokens"] / sum(x["tokens"] for x in got) for r in got]

    def spread(a):
        p = [s**a for s in shares]
        return -sum(x / sum(p) * math.log(x / sum(p)) for x in p)

    # Either the entropy is met, or the repetition limit forbids a smaller exponent.
    if h < entropy * math.log(len(got)) - 1e-9:
        step = (exponent - 2 ** -(M.STEPS - 1)) - 1
        assert (min(shares) / max(shares)) ** step > repeats
    else:
        assert exponent == 1 or spread(exponent + 2 ** -(M.STEPS - 1)) < entropy * math.log(len(got)) or most <= repeats


def test_passes_fill_the_budget(documents):
    """Whole passes hold every row; the last one ends within the budget."""
    table = documents(corpus())
    rows = M.settle(M.source_rows(table), "mix")
    weights = {r["source"]: r for r in M.source_weights(rows).collect()}
    tokens = {}
    for r in rows.collect():
        tokens.setdefault((r["doc_id"], r["source"]), r["tokens"])
    drawn = Counter()
    for r in M.mix_report(table).collect():
        drawn[r["source"]] += tokens[r["doc_id"], r["source"]]
    for source, w in weights.items():
        assert w["target"] - 40 <= drawn[source] <= w["target"]
    assert {r["doc_id"] for r in M.mix_report(table).collect()} == {r[0] for r in corpus()}


def test_budget_below_the_corpus_draws_part(documents):
    table = documents(corpus())
    drawn = M.mix(table, budget=500).collect()
    assert 300 < sum(max(1, len((r["row"]["text"] or "").split())) for r in drawn) <= 500


def test_columns_and_empty_table(documents):
    table = documents(corpus())
    assert M.mixed_documents(table).columns == table.columns
    assert M.mix_report(table.where(F.lit(False))).count() == 0
    one = documents([(1, "a b", "only"), (2, "c", "only")])
    assert sorted(r["doc_id"] for r in M.mix_report(one).collect()) == [1, 2]
