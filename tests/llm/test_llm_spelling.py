import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

import compare
from contrast.llm import spelling as S
from contrast.llm.oracles import ORACLES


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def plain(rows, noise=S.NOISE):
    """Brute force over all pairs of words."""
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            n[run if h % noise else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    form, near = {}, {}
    for w in n:
        around = sorted((-n[v], v) for v in n if one_edit(w, v))
        near[w] = len(around)
        form[w] = around[0][1] if around and -around[0][0] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], near[w], n[form[w]] if form[w] else None))
    return sorted(out, key=lambda row: row[0])


def reported(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    return sorted((tuple(row) for row in rows), key=lambda row: row[0])


def random_rows(seed, letters, n=60):
    rng = random.Random(seed)
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(7, 11))) for _ in range(40)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(60):
            word = stems[min(int(rng.expovariate(0.2)), 39)]
            if rng.random() < 0.15:
                at = rng.randrange(len(word))
                word = word[:at] + rng.choice(["", rng.choice(letters), word[at] * 2]) + word[at + 1 :]
            words.append(word.title() if rng.random() < 0.2 else word)
        rows.append((i, rng.choice([" ", "-", "œ "]).join(words)))
    return rows


@pytest.mark.parametrize("letters", ["ab", "aeiouéß", "abcdefgh"])
def test_list_scan_against_all_pairs(letters):
    rng = random.Random(len(letters))
    for _ in range(60):
        s = rng.randint(1, 8)
        words = sorted({"".join(rng.choice(letters) for _ in range(s + rng.randint(0, 1))) for _ in range(40)})
        lo = rng.randint(0, s)
        hi = rng.randint(lo, s + 1)
        want = [
            (i, j)
            for i, a in enumerate(words)
            for j, b in enumerate(words)
            if len(a) == s and (len(b) == s + 1 or (len(b) == s and i < j)) and one_edit(a, b) and lo <= S.shared(a, b) < hi
        ]
        assert sorted(S.near_pairs(words, s, lo, hi)) == sorted(want)


def test_long_words_share_by_halves():
    a = "ab" * 50_000
    assert S.shared(a, a[:70_001] + "z" + a[70_002:]) == 70_001
    words = sorted([a, a[:70_001] + "z" + a[70_002:], a[:70_001] + "zz" + a[70_003:]])
    assert list(S.near_pairs(words, 100_000, 0, 100_001)) == [(0, 1), (1, 2)]


@pytest.mark.parametrize("letters, block", [("ab", 2), ("aeiourstn", 64), ("aeiourstn", 3)])
def test_groups_against_brute_force(documents, letters, block):
    rows = random_rows(3, letters)
    want = plain(rows)
    assert sum(row[4] for row in want) > 20
    assert reported(S.spelling_groups(documents(rows), block=block)) == want


def test_hot_beginning_and_chains(documents):
    rng = random.Random(5)
    words = ["prefixes" + "".join(rng.choice("abc") for _ in range(5)) for _ in range(300)]
    rows = [(i, " ".join(words[i:] + words[i : i + 3])) for i in range(300)]
    # A chain of forms, each ten times as frequent as the one before.
    rows += [(900, "chainword " * 3000), (901, "chaimword " * 300), (902, "chaimwort " * 30), (903, "chaimworts " * 3)]
    ours = reported(S.spelling_groups(documents(rows), block=8, noise=10**9))
    assert ours == plain(rows, 10**9)
    roots = {row[0]: row[2] for row in ours}
    assert roots["chaimworts"] == roots["chaimwort"] == "chainword"


def test_odd_texts_against_sql(documents, odd):
    rows = odd + random_rows(7, "aeiouéÿrst", 40) + [(77, "A" * 40_000 + " " + "A" * 40_000 + " " + "a" * 39_999)]
    rows += [(None, "Wiederholung Wiederholung"), (78, "×÷ÀÁÂÃÄ " * 3)]
    ours = S.spelling_groups(documents(rows))
    assert reported(ours) == plain(rows)
    connection = duckdb.connect()
    connection.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    connection.executemany("INSERT INTO documents VALUES (?, ?)", [r for r in rows if r[0] != 77])
    short = S.spelling_groups(documents([r for r in rows if r[0] != 77]))
    assert compare.spark_rows(short) == compare.duck_rows(connection, ORACLES["op12_spelling"])


def test_empty_table(documents):
    assert S.spelling_groups(documents([(1, "x")]).limit(0)).count() == 0
    assert S.spelling_groups(documents([(1, None), (2, "")])).count() == 0
