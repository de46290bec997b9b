import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from contrast.llm import simhash as H
from contrast.llm.components import components


def plain(text, words=4):
    tokens = bytes(text or "", "utf-8").lower().split()
    if not tokens:
        return 0
    shingles = [b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(rows, bits=4):
    """Brute force over all pairs: smallest id reachable for each row."""
    fps = [plain(text) for _, text in rows]
    least = list(range(len(rows)))

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits or (rows[i][0] == rows[j][0] and rows[i][0] is not None):
                a, b = find(i), find(j)
                least[max(a, b)] = min(a, b)
    ids = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            ids[find(i)] = min(ids.get(find(i), key), key)
    return [(rows[i][0], f"{fps[i]:016x}", ids.get(find(i))) for i in range(len(rows))]


def corpus(n=90):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(5)) for _ in range(300)]
    texts = []
    for i in range(n):
        if texts and rng.random() < 0.6:
            words = rng.choice(texts).split()
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 40, 200]))]
        texts.append(" ".join(words).upper() if i % 7 == 0 else " ".join(words))
    return list(enumerate(texts, 10))


def test_groups_equal_brute_force(documents, odd, rows_of):
    rows = odd + corpus()
    got = sorted(
        ((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows_of(H.simhash_report(documents(rows)))),
        key=str,
    )
    assert got == sorted(groups(rows), key=str)


def test_golay_keys_meet_within_four_bits():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 64, 3000, np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, i % 5, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    sides = {0: 1, 1: 0, 2: 2}
    found = [set() for _ in a]
    for row, key, side in zip(*H.golay_keys(b), strict=True):
        found[row].add((int(key), int(side)))
    met = np.zeros(len(a), bool)
    for row, key, side in zip(*H.golay_keys(a), strict=True):
        met[row] |= (int(key), sides[int(side)]) in found[row]
    assert met.all()


def test_long_text_in_blocks(monkeypatch):
    text = "a b c d e f g " * 50
    whole = H.fingerprint(text.encode())
    monkeypatch.setattr(H, "_BLOCK", 7)
    assert H.fingerprint(text.encode()) == whole == plain(text)


def test_dense_chain_is_one_group(spark, rows_of):
    """A bucket of many fingerprints that all differ by little is one component."""
    fps = [(i, ((1 << (i % 40)) | (1 << ((i * 7) % 40))) & ((1 << 40) - 1)) for i in range(300)]
    nodes = spark.createDataFrame([(fp, i) for i, fp in dict((f, i) for i, f in fps).items()], "fp long, node long")
    found = rows_of(components(H.near_links(nodes), "a", "b"))
    assert len({r["component"] for r in found}) == 1 and len(found) == nodes.count()


def test_one_of_each_group_stays(documents):
    base = " ".join(f"word{i}" for i in range(300))
    table = documents([(1, base), (2, base), (3, base + " more"), (4, "other text"), (None, base), (5, None), (6, "")])
    kept = H.keep_one(table)
    assert kept.columns == table.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 4, 5]


def test_components_of_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(links, "a", "b").collect()}
    assert {got[i] for i in range(201)} == {0} and got[501] == 500 and len(got) == 203


def test_empty_table(documents):
    empty = documents([(1, "x")]).where(F.lit(False))
    assert H.simhash_report(empty).count() == 0 and H.keep_one(empty).count() == 0
