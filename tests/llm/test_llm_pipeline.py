import inspect
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from contrast.llm import bpe, secrets, shingles, simhash


@pytest.fixture
def folder(spark, documents, odd, tmp_path):
    rng = random.Random(6)
    words = ["".join(rng.choice("aeioustrn") for _ in range(rng.randint(2, 7))) for _ in range(500)]
    rows, labels = [], []
    for i in range(20, 200):
        bad = i % 6 == 0
        text = " ".join(rng.choice(words) + ("&&&" if bad else "") for _ in range(rng.randint(30, 80)))
        rows.append((i, text + (" password=abcdefghijkl" if i % 10 == 1 else ""), "s0" if i % 3 else "s1"))
        labels.append((i, int(not bad), 0))
    rows += [(400 + i, rows[i][1], "s0") for i in range(0, 40, 7)]
    documents(rows + odd).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), rows, {k: q for k, q, _ in labels}


def test_every_stage_against_brute_force(spark, folder):
    sf_dir, rows, good = folder
    docs = P.read(spark, sf_dir, "documents")
    columns, seen = docs.columns, []
    for name, stage in P.STAGES:
        docs = P.settle(stage(spark, docs, sf_dir), "test")
        seen.append([r.asDict() for r in docs.collect()])
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns
    rated, single, hidden, mixed, encoded = seen
    ids = lambda table: {r["doc_id"] for r in table}
    bad = {k for k, q in good.items() if not q}
    assert not ids(rated) & bad and {k for k, q in good.items() if q} <= ids(rated)
    # Of equal fingerprints the least id stays.
    first = {}
    for r in sorted((r for r in rated if r["doc_id"] is not None), key=lambda r: r["doc_id"]):
        first.setdefault(simhash.fingerprint((r["text"] or "").encode()), r["doc_id"])
    assert ids(single) - {None} == set(first.values())
    assert len(hidden) == len(single) and not any("abcdefghijkl" in (r["text"] or "") for r in hidden)
    assert ids(mixed) == ids(hidden) and len(mixed) >= len(hidden)
    coder = bpe.load()
    texts = {(r["doc_id"], r["text"] or "") for r in mixed}
    assert all(r["exact"] and r["n_tokens"] * 4 == len(r["ids"]) for r in encoded)
    assert {(r["doc_id"], coder.decode(r["ids"]).decode()) for r in encoded} == texts
    assert len(encoded) == len(mixed)


def test_near_copies_of_every_similarity(spark, documents):
    """Near copies at 0.8 or more go, those below stay, as brute force over all pairs has it."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeioustrn") for _ in range(6))
    rows = []
    for n in range(60):
        base = [word() for _ in range(150)]
        rows.append((10 * n, " ".join(base)))
        for j in range(1, 4):
            copy = list(base)
            for at in rng.sample(range(150), rng.randint(1, 5)):
                copy[at] = word()
            rows.append((10 * n + j, " ".join(copy)))

    def cut(text):
        words = text.split()
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}

    sets, root, pairs = {k: cut(t) for k, t in rows}, {k: k for k, _ in rows}, []
    for a in sets:
        for b in range(a + 1, a - a % 10 + 4):
            likeness = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            if likeness >= 0.8:
                pairs.append(likeness)
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {k: new if r == old else r for k, r in root.items()}
    assert min(pairs) < 0.83 and len(pairs) > 60 and len(set(root.values())) > 60
    kept = [r["doc_id"] for r in P.keep_one_of_near(spark, documents(rows), None).collect()]
    assert sorted(kept) == sorted(set(root.values()))


def test_similar_texts_with_unlike_ones_between(spark, documents):
    """All texts have the same words and so the same fingerprints; only their copies are alike."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for n in range(60):
        rng.shuffle(words)
        at = rng.randrange(119)
        swapped = words[:at] + [words[at + 1], words[at]] + words[at + 2 :]
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(swapped))]
    kept = [r["doc_id"] for r in P.keep_one_of_near(spark, documents(rows), None).collect()]
    assert sorted(kept) == [2 * n for n in range(60)]


def test_exact_join_alone_finds_every_link(spark, documents, monkeypatch):
    """Without any proposal, and with frequent shingles last, the links are those of brute force."""
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("aeioustrn") for _ in range(6))
    common, texts = [word() for _ in range(40)], ["", " ", "\n", "one", " one "]
    for _ in range(25):
        base = [word() for _ in range(rng.randint(30, 150))] + common * rng.randint(0, 1)
        for _ in range(3):
            copy = list(base)
            for at in rng.sample(range(30), rng.randint(0, 2)):
                copy[at] = word()
            texts.append(" ".join(copy + [word()] * rng.randint(0, 2)))
    docs = documents(list(enumerate(texts)))
    sets = [shingles.shingle_set(t.encode()) for t in texts]
    least = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            if shingles.similar(sets[a], sets[b]):
                old, new = sorted((least[a], least[b]))[::-1]
                least = [new if x == old else x for x in least]
    assert len(set(least)) < len(texts) - 20
    monkeypatch.setattr(shingles, "SAMPLED", 2)
    assert len(shingles.frequent(docs)) >= 30
    nothing = lambda own: own.select(F.col("code").alias("a"), F.col("code").alias("b")).where("a < b")
    monkeypatch.setattr(shingles, "proposed", nothing)
    monkeypatch.setattr(shingles, "beside", nothing)
    found = {r["doc_id"]: r["component_id"] for r in shingles.similar_groups(docs).collect()}
    assert found == dict(enumerate(least))


def test_run_and_registration(spark, folder):
    import __spark_entry__ as registry

    assert registry.queries()["pipeline"] is P.run and len(P.STAGES) == 5
    assert {n.split("_")[0] for n in registry.queries() if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)}
    assert P.run(spark, folder[0]).where("not exact").count() == 0


def test_empty_table(spark, folder, tmp_path):
    docs = P.read(spark, folder[0], "documents").where(F.lit(False))
    for _, stage in P.STAGES:
        docs = P.settle(stage(spark, docs, folder[0]), "test")
    assert docs.count() == 0 and secrets.KINDS


def test_texts_leave_arrow_one_at_a_time():
    """A batch holds up to 64 MB of texts a side; copied whole, it is there twice in every worker."""
    assert "to_pylist" not in inspect.getsource(shingles)


def test_batches_of_texts_are_small(spark, documents, monkeypatch):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen = spark.conf.get(key), []

    def noted(docs):
        seen.append(int(spark.conf.get(key)))
        return grouped(docs)

    grouped = shingles.similar_groups
    monkeypatch.setattr(shingles, "similar_groups", noted)
    assert shingles.keep_one(documents([(1, "a b"), (2, "a b"), (3, "c")])).count() == 2
    assert seen == [shingles.ROWS] and shingles.ROWS < int(before) and spark.conf.get(key) == before


def test_texts_beside_a_large_group_meet_a_few_of_it(spark, documents):
    """Two groups have few pairs before all are made, and most texts with a link to one are in them."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("aeioustrn") for _ in range(6))
    base, texts = [word() for _ in range(150)], []
    for i in range(160):
        copy = list(base)
        for at in rng.sample(range(150), i % 3 if i < 100 else 3):
            copy[at] = word()
        texts.append(" ".join(copy))
    docs = documents(list(enumerate(texts)))
    code = {r["code"]: r["doc_id"] for r in shingles.printed(docs).collect()}
    group = [c for c, i in code.items() if i < 100]
    found = spark.createDataFrame([(c, min(group)) for c in group], "node long, component long")
    buckets = shingles.settle(shingles.prefixed(docs), "test")
    every, near = (
        {tuple(sorted((code[r["a"]], code[r["b"]]))) for r in step(buckets, found).collect()}
        for step in (shingles.apart, shingles.nearest)
    )
    beside = [{pair for pair in pairs if pair[0] < 100 <= pair[1]} for pairs in (every, near)]
    assert near <= every and len(beside[0]) > 3 * len(beside[1])
    sets = [shingles.shingle_set(t.encode()) for t in texts]
    linked = lambda pairs: {b for a, b in pairs if a < 100 <= b and shingles.similar(sets[a], sets[b])}
    assert len(linked(every)) >= 50 and len(linked(near)) > 0.8 * len(linked(every))
    for b in range(100, 160):
        assert len([a for a, other in near if other == b and a < 100]) <= shingles.TRIED


def test_sketches_never_lose_a_link():
    """They pass all similar pairs, of any sizes, and hardly one that is far from similar."""
    rng = np.random.default_rng(12)
    passed, far = 0, 0
    for n in [0, 1, 2, 5, 9, 63, 64, 65, 400, 511, 513, 3000] * 12:
        base = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for share in (0, 0.02, 0.1, 0.2, 0.25, 0.6, 1):
            new = np.unique(rng.integers(0, 1 << 63, int(share * n * rng.random()) + 1).astype(np.uint64))
            other = np.union1d(rng.permutation(base)[int(share * n * rng.random()) :], new)
            may = shingles.may_be_similar(shingles.sketch(base), shingles.sketch(other), len(base), len(other))
            assert may or not shingles.similar(base, other)
            assert may == shingles.may_be_similar(shingles.sketch(other), shingles.sketch(base), len(other), len(base))
            if n >= 63 and not shingles.similar(base, other, 0.7):
                far, passed = far + 1, passed + may
    assert far > 80 and passed < 0.05 * far
    assert shingles.may_be_similar(shingles.sketch(base[:0]), shingles.sketch(base[:0]), 0, 0)


def _counted(monkeypatch):
    """Numbers of pairs that are verified with whole texts, call by call."""
    seen, real = [], shingles.verified

    def noted(texts, pairs):
        seen.append(pairs.count())
        return real(texts, pairs)

    monkeypatch.setattr(shingles, "verified", noted)
    return seen


def test_unlike_texts_that_share_shingles_are_not_joined(spark, documents, monkeypatch):
    """Texts that share passages but are unlike make many pairs; these never meet as whole texts."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("aeioustrn") for _ in range(6))
    passages = [[word() for _ in range(30)] for _ in range(5)]
    texts = [" ".join([word() for _ in range(60)] + rng.choice(passages) + rng.choice(passages)) for _ in range(120)]
    texts += [f"{t} {word()}" for t in texts[:6]]
    seen = _counted(monkeypatch)
    kept = [r["doc_id"] for r in shingles.keep_one(documents(list(enumerate(texts)))).collect()]
    assert sorted(kept) == list(range(120))
    assert 6 <= sum(seen) < 60


def test_texts_are_joined_a_bounded_volume_at_a_time(spark, documents, monkeypatch):
    """Many pairs a text: they are verified in parts, and those that others imply are not verified."""
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("aeioustrn") for _ in range(6))
    rows, groups = [], 6
    for n in range(groups):
        base = [word() for _ in range(200)]
        for j in range(20):
            copy = list(base)
            copy[rng.randrange(200)] = word()
            rows.append((20 * n + j, " ".join(copy)))
    docs = documents(rows)
    volume, every = sum(len(t) for _, t in rows), []
    for share, batch, sent, limit in (2, 1 << 28, 1 << 20, shingles.BROADCAST_LIMIT), (8, 1, 25, 1):
        for name, value in ("SHARE", share), ("BATCH", batch), ("SENT", sent), ("BROADCAST_LIMIT", limit):
            monkeypatch.setattr(shingles, name, value)
        with monkeypatch.context() as inner:
            seen = _counted(inner)
            assert sorted(r["doc_id"] for r in shingles.keep_one(docs).collect()) == [20 * n for n in range(groups)]
        every.append(seen)
    whole, parts = every
    assert max(whole) > len(rows) and max(parts) * 2 * volume / len(rows) < 2 * volume / 8 and max(parts) < 50
    assert len(parts) > 8 and sum(parts) < sum(whole)
