import random

import numpy as np
import pytest

from statera.llm import similar
from statera.llm.components import components
from statera.llm.words import graded as words_graded


def brute(rows, words, percent):
    sets = {}
    for doc, text in rows:
        parts = (text or "").encode().lower().split()
        k = min(words, len(parts))
        sets.setdefault(doc, []).append({tuple(parts[i : i + k]) for i in range(len(parts) - k + 1)} if parts else set())
    flat = [(d, s) for d, many in sets.items() for s in many]
    parent = list(range(len(flat)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = {}
    for i, (_, s) in enumerate(flat):
        for t in s:
            where.setdefault(t, []).append(i)
    for i, (_, a) in enumerate(flat):
        shared = {}
        for t in a:
            for j in where[t]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if 100 * n >= percent * (len(a) + len(flat[j][1]) - n):
                parent[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(flat):
        low[root(i)] = min(low.get(root(i), d), d)
    return sorted((d, len(s), low[root(i)]) for i, (d, s) in enumerate(flat))


def got(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80)])
def test_table(spark, words, percent):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(similar.near_duplicates(docs, words, percent)) == brute(rows, words, percent)


def test_groups_of_near_copies(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, common = [], [rng.choice(vocabulary) for _ in range(60)]
    for g in range(6):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([8, 70, 130, 260]))] + common
        for _ in range(40):
            text = list(base)
            for _ in range(rng.randrange(4)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(text)))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(similar.near_duplicates(docs, 3, 90, bits=12)) == brute(rows, 3, 90)


def test_prefixes_always_meet(monkeypatch):
    rng = np.random.default_rng(1)
    for _ in range(3000):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = a.copy()
        for _ in range(int(rng.integers(0, n // 9 + 2))):
            if rng.random() < 0.5 and len(b) > 1:
                b = np.delete(b, rng.integers(len(b)))
            else:
                b = np.append(b, rng.integers(0, 2**63, 1, dtype=np.uint64))
        b = np.unique(b)
        both = len(np.intersect1d(a, b))
        if 100 * both >= 90 * (len(a) + len(b) - both):
            share = rng.choice([0, 3, 8, 10])
            seen = lambda x: np.where(x % np.uint64(10) < share, 1000, (x % np.uint64(7)).astype(np.int64))  # noqa: E731, B023
            (s, at), (t, bt) = similar.signatures(a, seen(a), 100, 90), similar.signatures(b, seen(b), 100, 90)
            shared, i, j = np.intersect1d(s, t, return_indices=True)
            assert len(shared), (len(a), len(b), share)
            # some shared entry passes the positional filter
            assert (190 * np.minimum(len(a) - at[i], len(b) - bt[j]) >= 90 * (len(a) + len(b))).any()


def test_odd_rows(spark, odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert got(similar.near_duplicates(odd_docs)) == brute(rows, 3, 90)
    kept = similar.one_of_each(odd_docs).collect()
    assert sorted(r.doc_id for r in kept) == [1, 3, 4, 5, 6, 7, 8, 9]
    assert similar.near_duplicates(odd_docs.limit(0)).count() == 0


def test_long_chain(spark):
    rows = [(i, i + 1) for i in range(0, 200)] + [(500, 501), (501, 500), (7, 7)]
    out = {r.node: r.component for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert all(out[i] == 0 for i in range(201)) and out[501] == 500


def test_null_ids_carry_links(spark):
    """1 and 3 are linked only through a text whose id is null."""
    base = [f"w{i}" for i in range(100)]
    near, far = base[:97] + ["x", "y", "z"], base[3:97] + ["x", "y", "z", "u", "v", "w"]
    rows = [(1, " ".join(base)), (None, " ".join(near)), (3, " ".join(far)), (None, "alone and without a name"), (None, None)]
    found = similar.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    brute_rows = [(1, rows[0][1]), (2, rows[1][1]), (3, rows[2][1])]
    assert {d: c for d, _, c in brute(brute_rows, 3, 90)} == {1: 1, 2: 1, 3: 1}
    assert sorted((str(r.doc_id), str(r.component_id)) for r in found) == [("1", "1"), ("3", "1"), ("None", "1"), ("None", "None"), ("None", "None")]


def test_one_of_each_keeps_texts_of_repeated_ids(spark):
    texts = [f"text {i} " + " ".join(f"w{i}x{j}" for j in range(30)) for i in range(6)]
    rows = [(1, texts[0], "a"), (1, texts[1], "a"), (2, texts[0], "b"), (None, texts[2], "c"), (None, texts[2], "b"), (None, texts[0], "b"), (3, texts[3], "a"), (3, texts[3], "a"), (None, " ", None), (9, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for n in (1, 3):
        kept = similar.one_of_each(docs.repartition(n)).collect()
        assert sorted(map(str, map(tuple, kept))) == sorted(map(str, [rows[0], rows[1], rows[4], rows[6], rows[8], rows[9]]))


@pytest.mark.parametrize("rows_a_block", [2, 7])
def test_hot_entries_in_blocks(spark, monkeypatch, rows_a_block):
    monkeypatch.setattr(similar, "BLOCK_ROWS", rows_a_block)
    rng = random.Random(rows_a_block)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        own = list(base)
        for _ in range(rng.randrange(6)):
            own[rng.randrange(120)] = f"y{rng.randrange(9)}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(similar.near_duplicates(docs, 3, 90, bits=12)) == brute(rows, 3, 90)


def test_sketch_grows_with_the_corpus():
    assert similar.bits_for(0) == similar.bits_for(500_000_000) == similar.LEAST_BITS
    assert similar.bits_for(8_000_000_000) == 25 and similar.bits_for(10**14) == similar.MOST_BITS
    grades = np.zeros(1 << 12, np.uint8)
    assert similar.limits(grades) == (32, 16)
    rare, own = similar.limits(words_graded(np.full(1 << 12, 1000)))
    assert words_graded(np.array([1000]))[0] <= own < rare < words_graded(np.array([8000]))[0]
