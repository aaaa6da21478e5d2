import hashlib
import random
import zlib

import pytest

from statera.llm import queries_tables, trie

KIND = "conv_id long, turn long, role string, text string"


def brute(convs):
    """conv_id to (role, text) turns; nodes as dicts, by definition."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        children = [q for q in below if len(q) == len(p) + 1]
        ends = sorted(c for c in m if len(convs[c]) == len(p))
        out.append((
            min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children), sum(not any(x[:-1] == q for x in members if x) for q in below),
            sum((len(members[q]) - 1) * len(q[-1][1].split()) for q in below if q), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def rows_of(frame):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=str)


@pytest.fixture
def talks():
    rng = random.Random(3)
    return {c: [(rng.choice("ua"), rng.choice(["x", "y y", ""])) for _ in range(rng.randint(1, 5))] for c in [*range(0, 45), 77, 1000, -3]}


def frame(spark, talks):
    return spark.createDataFrame([(c, t, r, x) for c, turns in talks.items() for t, (r, x) in enumerate(turns)], KIND)


def test_trie_equals_definition_in_small_blocks(spark, talks, monkeypatch):
    monkeypatch.setattr(trie, "DEPTH_BITS", 1)
    monkeypatch.setattr(trie, "BLOCK_BITS", 1)
    monkeypatch.setattr(trie, "FAN_IN", 2)
    talks = {**talks, 2000: [("u", "same words here")] * 30, 2001: [("u", "same words here")] * 33}
    assert rows_of(trie.prefix_trie(frame(spark, talks))) == brute(talks)


def test_query_rebuilds_conversations(spark, talks, monkeypatch):
    talks = {**talks, next(c for c in range(4001, 4020) if zlib.crc32(str(c).encode()) % 4): [("u", "alone")]}
    monkeypatch.setattr(queries_tables, "read_table", lambda *a: frame(spark, talks))
    made = {}
    for c, turns in talks.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = talks.get(c - (abs(c) % 20) * (1 if c >= 0 else -1), [])
        made[c] = base[:h] + turns[h:]
    assert any(not x for x in made.values())
    assert rows_of(queries_tables.op11_prefix_trie(spark, "")) == brute(made)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 3, "u", "late"), (1, 1, "u", "a  b"), (2, None, "", ""), (2, 1, "u", "a  b"), (2, 1, "u", "a  b"), (None, 0, "u", "nobody's"), (3, 5, "u", "w " * 50_000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], KIND + ", depth long, k1 string")
    want = {1: [("", ""), ("u", "a  b"), ("u", "late")], 2: [("", ""), ("u", "a  b"), ("u", "a  b")], 3: [("u", "w " * 50_000)]}
    assert rows_of(trie.prefix_trie(df)) == brute(want)
    assert trie.prefix_trie(df.limit(0)).count() == 0


def test_hot_keys_are_broadcast_and_others_not(spark):
    from pyspark.sql import functions as F

    from statera.llm import common

    rows = spark.range(9000).select(F.when(F.col("id") < 3000, 0).otherwise(F.col("id")).alias("k"), "id")
    one = rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("twice", F.col("k") * 2)
    got = common.spread_join(rows, one, ["k"], "n")
    assert got.count() == 9000 and got.where("twice <> 2 * k").count() == 0
    assert set(got.columns) == {"k", "id", "n", "twice"}
