import re

import numpy as np
import pytest

from statera.llm import mixing


def words(text):
    return len(re.findall(mixing.WORD, text or ""))


def test_targets():
    assert sum(mixing.targets([100, 100, 100])) == pytest.approx(450)
    t = mixing.targets([100, 100, 100])
    assert t[0] == 200 and t[1] == pytest.approx(250 * 2 / 3) and t[2] == pytest.approx(250 / 3)
    assert mixing.targets([0, 0]) == [0, 0] and mixing.targets([]) == [] and mixing.targets([10]) == [15]


@pytest.mark.parametrize("n", [1, 2, 3, 100, 4097])
def test_permutation(n):
    assert sorted(mixing.permuted(np.arange(n), n, 7)) == list(range(n))


def test_shards_split_the_totals():
    slots = np.array([37, 0, 900, 63])
    got = [mixing.shard_counts(slots, 10, i, 100, 1) for i in range(10)]
    assert (sum(c for c, _ in got) == slots).all() and all(c.sum() == 100 for c, _ in got)
    before = np.zeros(4, int)
    for counts, start in got:
        assert (start == before).all()
        before += counts


def test_runs_of_shards_hold_their_shares(monkeypatch):
    monkeypatch.setattr(mixing, "RUN_SLOTS", 300)
    slots = np.array([37, 0, 900, 63])
    got = [mixing.shard_counts(slots, 10, i, 100, 1) for i in range(10)]
    assert (sum(c for c, _ in got) == slots).all() and all(c.sum() == 100 for c, _ in got)
    for run in range(0, 9, 3):
        share = slots * 300 / slots.sum()
        assert (abs(sum(c for c, _ in got[run : run + 3]) - share) <= 1).all()


@pytest.mark.parametrize("n", [1, 2, 5, 4_096, 5_000, 100_000])
def test_place_of_a_block(n):
    order = mixing.permuted(np.arange(n), n, 11)
    for value in {0, n // 2, n - 1}:
        assert order[mixing.place_of(value, n, 11)] == value


@pytest.mark.parametrize("blocks", [3, 4_000, 5_000, 20_000])
def test_slots_hold_the_target_at_every_size(blocks):
    """Words of all slots, block by block, whatever slot the short last block falls in."""
    for seed in range(10):
        sizes = [blocks * 256 - 200, 3 * blocks * 256 - 77]
        plan = mixing.plan_of([("a", sizes[0]), ("b", sizes[1])], seed, 256, 2_048)
        for i, s in enumerate(plan.sources):
            took = mixing.permuted(np.arange(s.slots) % s.blocks, s.blocks, seed + i)
            words = np.where(took == s.blocks - 1, s.size - (s.blocks - 1) * 256, 256)
            if s.last:
                words[-1] = min(words[-1], s.last)
            assert abs(words.sum() - s.target) <= 1


@pytest.mark.parametrize("which", ["table", "odd"])
def test_mix_meets_targets(spark, odd_docs, which):
    docs = odd_docs if which == "odd" else spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows, mixed, plan = mixing.mixture(docs, block=64)
    out = mixing.taken(rows, mixed).collect()
    texts = sorted((r.doc_id, words(r.text)) for r in docs.collect())
    assert sorted((r.doc_id, r["size"]) for r in out) == texts
    assert all(0 <= r.taken <= 2 * r["size"] for r in out)
    sources = {r.doc_id: r.source for r in docs.collect()}
    sums = {}
    for r in out:
        own = sums.setdefault(sources[r.doc_id], [0, r.target])
        own[0] += r.taken
        assert own[1] == r.target
    assert len(sums) == len(plan.sources) and all(abs(n - target) <= 1 for n, target in sums.values())
    again = mixing.taken(*mixing.mixture(docs, block=64)[:2]).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out))
    per_slot = mixed.groupBy("shard", "slot").sum("n_words").collect()
    assert all(r[2] <= 64 for r in per_slot)


def test_texts_of_the_mix(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows, mixed, _ = mixing.mixture(docs)
    want = {r.doc_id: r.taken for r in mixing.taken(rows, mixed).collect() if r.taken}
    got = {}
    for r in mixing.mixed_documents(docs).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + words(r.text)
    assert got == want


def test_odd_texts_and_empty(spark, odd_docs):
    out = mixing.mixed_documents(odd_docs)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"] and out.count() > 0
    assert mixing.mixed_documents(odd_docs.limit(0)).count() == 0


def test_equal_texts_of_two_languages_stay_apart(spark):
    said = " ".join(f"w{i}" for i in range(300))
    docs = spark.createDataFrame([(1, said, "en", "a"), (1, said, "fr", "a"), (1, said, None, "a"), (2, said, "de", "b")], "doc_id long, text string, lang string, source string")
    rows, mixed, _ = mixing.mixture(docs)
    out = mixing.mixed_documents(docs).collect()
    assert {r.lang for r in out} == {"en", "fr", None, "de"}
    assert sum(words(r.text) for r in out) == sum(r.taken for r in mixing.taken(rows, mixed).collect())
