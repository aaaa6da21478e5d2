import random

import numpy as np
import pytest

from statera.llm import lines


def brute(rows, percent=80, least=1):
    every = []
    for doc, text in rows:
        for j, line in enumerate((text or "").split("\n")):
            every.append((doc, j, frozenset(line.encode().lower().split())))
    every.sort(key=lambda r: r[:2])
    gone, where, seen = set(), {}, []
    for doc, j, s in every:
        if len(s) < least:
            continue
        shared = {}
        for w in s:
            for k in where.get(w, ()):
                shared[k] = shared.get(k, 0) + 1
        if any(100 * n >= percent * (len(s) + len(seen[k]) - n) for k, n in shared.items()):
            gone.add((doc, j))
        for w in s:
            where.setdefault(w, []).append(len(seen))
        seen.append(s)
    out = []
    for doc, text in rows:
        kept = [x for j, x in enumerate((text or "").split("\n")) if (doc, j) not in gone]
        n = sum(d == doc for d, _ in gone)
        out.append((doc, text if text is None else "\n".join(kept), n))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.text, r.n_removed) for r in df.collect()), key=str)


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = lines.dedup_lines(docs)
    assert got(found) == brute(rows)
    assert all(r.n_chars == len(r.text) for r in found.collect())


@pytest.mark.parametrize(
    ("bits", "small", "spread", "rare", "stream"),
    [(6, 32, 16_384, 512, 100_000), (16, 4, 16_384, 512, 50), (16, 3, 20, 512, 100_000), (16, 1_024, 10**6, 3, 100_000), (16, 2, 20, 10, 30)],
)
def test_many_similar_lines(spark, monkeypatch, bits, small, spread, rare, stream):
    monkeypatch.setattr(lines, "SMALL", small)
    monkeypatch.setattr(lines, "SPREAD", spread)
    monkeypatch.setattr(lines, "RARE", rare)
    monkeypatch.setattr(lines, "STREAM", stream)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    bases = [rng.choices(words, k=rng.randrange(3, 30)) for _ in range(12)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rng.randrange(1, 8)):
            line = list(rng.choice(bases))
            for _ in range(rng.randrange(4)):
                line[rng.randrange(len(line))] = rng.choice(words)
            text.append(" ".join(line))
        rows.append((i, "\n".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(lines.dedup_lines(docs, bits=bits)) == brute(rows)
    if small < 5:
        monkeypatch.setattr(lines, "BROADCAST_ROWS", -1)
        assert got(lines.dedup_lines(docs, bits=bits)) == brute(rows)


def test_entries_of_similar_sets_meet():
    """Any two sets with enough in common share an entry, whatever the occurrences of their words and their lengths."""
    rng = np.random.default_rng(3)
    words = rng.integers(1, 2**63, 3_000, dtype=np.uint64)
    counts = np.sort(2 ** rng.uniform(1, 12, 3_000)).astype(np.int64)
    for _ in range(300):
        n = int(rng.integers(4, 170))
        a = rng.choice(3_000, n, replace=False) if rng.random() < 0.5 else rng.choice(np.arange(2_600, 3_000), n, replace=False)
        b = np.setdiff1d(a, rng.choice(a, n // 10, replace=False))
        b = np.union1d(b, rng.choice(3_000, (n - len(b)) // 2, replace=False))
        if 100 * len(np.intersect1d(a, b)) < 80 * len(np.union1d(a, b)):
            continue
        both = [np.sort(a), b]
        x, line = words[np.concatenate(both)], np.repeat([0, 1], [len(v) for v in both])
        at, sigs, pos, _ = lines.entries(x, line, np.bincount(line), counts[np.concatenate(both)], 80, 900.0)
        assert set(sigs[at == 0]) & set(sigs[at == 1])
        assert len(sigs) < 800 * len(both)


def test_clashing_names(spark):
    rows = [(1, "one two\nthree", "mine", "h", 5, 6, 7, "m"), (2, "one two\nfour", "yours", "h", 5, 6, 7, "m")]
    names = ["doc_id", "text", "_id", "_hash", "n_lines", "n_removed", "_row", "mask"]
    found = lines.dedup_lines(spark.createDataFrame(rows, names))
    assert found.columns == ["doc_id", "text", "_id", "_hash", "_row", "mask", "n_lines", "n_removed"]
    assert sorted(tuple(r) for r in found.collect()) == [(1, "one two\nthree", "mine", "h", 7, "m", 2, 0), (2, "four", "yours", "h", 7, "m", 2, 1)]


def test_null_id_and_the_least_id_are_two_documents(spark):
    rows = [(None, "a b c\nd e f"), (-(2**63), "a b c\nd e f"), (-(2**63), "g h i")]
    found = [(r.doc_id, r.text) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(t for _, t in found) == ["", "a b c\nd e f", "g h i"]


def test_odd_rows(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(lines, "BROADCAST_ROWS", -1)
    found = lines.dedup_lines(odd_docs)
    assert found.columns == [*odd_docs.columns, "n_lines", "n_removed"]
    rows = {(r.doc_id, r.text): r for r in found.collect()}
    text = "The MIT License. the quick brown fox jumps over the lazy dog again and again"
    assert rows[(1, text)].n_removed == 0 and rows[(2, "")].n_removed == 1
    assert rows[(3, None)].n_lines == 0 and rows[(4, "")].n_lines == 1
    assert found.count() == 10 and lines.dedup_lines(odd_docs.limit(0)).count() == 0
