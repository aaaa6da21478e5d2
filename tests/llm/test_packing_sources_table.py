"""Packing of many sources: shares of windows as a table, equal to the search window by window."""

import numpy as np
import public_tokenizers
import pytest

from statera.llm import mixing, packing
from tests.llm.test_packing import check
from tests.llm.test_packing_weights import one_by_one

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def many(spark):
    rows = [(i % 97 if i % 13 else None, None if i % 29 == 0 else f"word{i % 7} " * (i % 40), None if i % 31 == 0 else f"s{i % 90}") for i in range(600)]
    rows += [(1_000, " ".join(f"w{i}" for i in range(5_000)), "large"), (1_001, "", "empty")] + [(7, "the same row", "s1")] * 5
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def placed(pieces):
    """doc, source, place and position of every token, whatever the pieces."""
    return sorted((str(r.doc_id), str(r.source), r.start + i, r.sequence_id, r.offset + i, bytes(r.ids)[4 * i : 4 * i + 4]) for r in pieces.collect() for i in range(r.length))


@pytest.mark.parametrize("weighed", [False, True])
def test_table_of_shares_is_the_search(spark, many, monkeypatch, weighed):
    names = [r[0] for r in many.select("source").distinct().collect()]
    weights = {s: 1.0 + len(s or "") for s in names} if weighed else None
    assert len(names) > packing.FEW_SOURCES
    got = packing.pack(many, PATH, 64, weights=weights)
    types, got = got.dtypes, placed(got)
    assert len({r[3:5] for r in got}) == len(got)
    monkeypatch.setattr(packing, "FEW_SOURCES", 1_000)
    want = packing.pack(many, PATH, 64, weights=weights)
    assert want.dtypes == types and placed(want) == got


def test_sources_share_queues_beyond_the_bound(spark, many, monkeypatch):
    monkeypatch.setattr(packing, "MOST_QUEUES", 10)
    docs = many.dropDuplicates(["doc_id"]).where("doc_id IS NOT NULL")
    pieces = packing.pack(docs, PATH, 64)
    check(docs, pieces, 64)
    assert {r.source for r in pieces.collect()} == {r.source for r in docs.collect()}


@pytest.mark.parametrize(("totals", "weights"), [([5] * 300 + [700], [5] * 300 + [700]), ([3] * 100, [1] * 100), (list(range(1, 90)), [2] * 89)])
def test_states_of_many_queues_are_the_simulation(totals, weights):
    want = one_by_one(totals, weights, 16)
    t, w = np.array(totals), np.array(weights, float)
    assert packing.served(t, 0, len(want) - 1, 16, w).tolist() == want
    s = packing.shares(t, 2, len(want) - 2, 16, w)
    taken = np.zeros((len(want), len(t)), int)
    np.add.at(taken, (s["_window"], s["_queue"]), s["_n"])
    assert (taken[2:-2] == np.diff(want, axis=0)[2:-1]).all()


def test_a_small_source_is_placed_without_a_walk():
    totals = np.array([4_000_000_000_000, 3, 50_000_000_000])
    p = packing.cut(np.array([0]), np.array([3]), 1, totals, 4_096)
    q = [packing.served_at(totals, p["window"] + i, 4_096) for i in (0, 1)]
    assert (q[0][:, 1] <= p["start"]).all() and (p["start"] < q[1][:, 1]).all() and p["start"].tolist() == [0, 1, 2]


def test_many_sources_of_a_mix_keep_their_shares(monkeypatch):
    monkeypatch.setattr(mixing, "RUN_SLOTS", 300)
    slots = np.array([11] * 200 + [0, 800])
    got = [mixing.shard_counts(slots, 30, i, 100, 1)[0] for i in range(30)]
    assert (sum(got) == slots).all() and all(c.sum() == 100 for c in got)
