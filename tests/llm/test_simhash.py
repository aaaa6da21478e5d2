import random

import numpy as np
import pytest
import xxhash

from statera.llm import queries_tables, simhash


def bits_of(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def classes(prints, bits=2):
    """Smallest member of each one's component, by comparing all."""
    up = list(range(len(prints)))
    for i, x in enumerate(prints):
        for j in range(i):
            if (x ^ prints[j]).bit_count() <= bits:
                a, b = up[i], up[j]
                up = [min(a, b) if u in (a, b) else u for u in up]
    return up


def test_bits_are_majorities(monkeypatch):
    texts = [None, "", " \n\t ", "One", "one two", "one two THREE", "Été à\x0bla mer, a b c d e f", "w x y z " * 500]
    assert [simhash.fingerprint(t) for t in texts] == [bits_of(t) for t in texts]
    whole = simhash.word_runs
    monkeypatch.setattr(simhash, "word_runs", lambda t, table, carried: whole(t, table, carried, 3))
    assert [simhash.fingerprint(t) for t in texts] == [bits_of(t) for t in texts]


def crowd(seed, groups=60, each=25):
    """Fingerprints in clouds: flips of one to four bits around centres, chains among them."""
    rng = random.Random(seed)
    out = {0}
    for _ in range(groups):
        x = rng.getrandbits(64)
        for _ in range(each):
            out.add(x)
            y = x
            for _ in range(rng.randint(1, 4)):
                y ^= 1 << rng.randrange(64)
            out.add(y)
            x = rng.choice([x, y])
    return sorted(out)


@pytest.mark.parametrize("shard, leaf", [(10_000, 128), (50, 8), (7, 1)])
def test_links_join_what_all_pairs_join(spark, monkeypatch, shard, leaf):
    monkeypatch.setattr(simhash, "SHARD_ROWS", shard)
    monkeypatch.setattr(simhash, "LEAF", leaf)
    prints = crowd(shard)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    nodes = spark.createDataFrame([(p,) for p in signed], "fp long").repartition(5)
    links = [(r.a, r.b) for r in simhash.links(nodes, 2).collect()]
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in links)
    place, up = {p: i for i, p in enumerate(signed)}, list(range(len(signed)))
    for a, b in links:
        p, q = up[place[a]], up[place[b]]
        up = [min(p, q) if u in (p, q) else u for u in up]
    assert up == classes(prints)


def test_tree_visits_every_close_point_once():
    points = np.array(crowd(5), np.uint64)
    tree = simhash.VantageTree(points, 4)
    pairs = [tuple(sorted((int(x), int(y)))) for a, b in simhash.close_pairs(tree, points, 2, True) for x, y in zip(a, b, strict=True)]
    want = {(int(x), int(y)) for i, y in enumerate(points) for x in points[:i] if int(x ^ y).bit_count() <= 2}
    assert len(pairs) == len(set(pairs)) and {tuple(sorted(p)) for p in pairs} == want


def test_query_equals_brute_force(spark, odd_docs, monkeypatch):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    for d in range(100, 220):
        base = rng.sample(words, 300)
        for k in range(rng.randint(1, 4)):
            rows.append((d * 10 + k, " ".join(base)))
            base[rng.randrange(300)] = "edited"
    rows += [(None, "one"), (None, "nobody knows this text at all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(queries_tables, "read_table", lambda *a: docs)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in queries_tables.op12_simhash_near_dedup(spark, "").collect()), key=str)
    prints = [bits_of(t) for _, t in rows]
    part = classes(prints)
    least = {p: min((d for (d, _), q in zip(rows, part, strict=True) if q == p and d is not None), default=None) for p in part}
    assert got == sorted(((d, f"{x:016x}", least[p]) for (d, _), x, p in zip(rows, prints, part, strict=True)), key=str)
    assert any(len([1 for q in part if q == p]) > 1 for p in set(part))
    assert simhash.near_duplicates(odd_docs.limit(0)).count() == 0
