"""Target weights of packing: the closed form against a queue by queue simulation, and proportions of whole windows."""

from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest

from statera.llm import packing
from tests.llm.test_packing import check

PATH = public_tokenizers.path("word_bpe_49k.json")


def one_by_one(totals, weights, length):
    """Each token goes to the queue whose next one is due first, ties to the earlier queue."""
    gone, states = [0] * len(totals), [[0] * len(totals)]
    for n in range(1, sum(totals) + 1):
        queue = min((Fraction(2 * gone[i] + 1, 2 * weights[i]), i) for i in range(len(totals)) if gone[i] < totals[i])[1]
        gone[queue] += 1
        if n % length == 0 or n == sum(totals):
            states.append(list(gone))
    return states


@pytest.mark.parametrize(
    ("totals", "weights"),
    [([100, 300, 50], [5, 2, 1]), ([10, 10, 10, 400], [1, 1, 1, 1]), ([1, 500], [7, 3]), ([64], [9]), ([40, 3, 77, 5, 200], [1, 30, 2, 2, 11]), (list(range(1, 40)), [3] * 39)],
)
def test_closed_form_is_the_simulation(totals, weights):
    t, w = np.array(totals), np.array(weights, float)
    n = -(-sum(totals) // 16)
    want = one_by_one(totals, weights, 16)
    assert packing.served(t, 0, n, 16, w).tolist() == want
    assert packing.served(t, n // 2, n, 16, w).tolist() == want[n // 2 :]
    own = one_by_one(totals, totals, 16)
    assert packing.served(t, 0, n, 16).tolist() == own
    for k in range(n + 1):
        carried = packing.deficits(t, k, 16, w)
        assert abs(carried.sum()) < 1e-6 and (np.abs(carried) <= 1 + len(totals) / 2).all()


def test_pieces_of_a_weighted_queue_stand_in_its_windows():
    totals, weights = np.array([300, 2_000, 90]), np.array([5.0, 2, 1])
    q = packing.served(totals, 0, -(-2_390 // 16), 16, weights)
    for queue, total in enumerate(totals.tolist()):
        size = np.full(total // 10, 10)
        start = np.cumsum(size) - size
        p = packing.cut(start, size, queue, totals, 16, weights)
        for at, w, offset in zip((start[p["row"]] + p["start"]).tolist(), p["window"].tolist(), p["offset"].tolist(), strict=True):
            assert q[w, queue] <= at < q[w + 1, queue]
            assert offset == (q[w + 1, :queue] - q[w, :queue]).sum() + at - q[w, queue]


def test_windows_hold_the_target_proportions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names = sorted(r[0] for r in docs.select("source").distinct().collect())
    weights = {s: float(1 + i % 3) for i, s in enumerate(names)}
    pieces = packing.pack(docs, PATH, 512, weights=weights)
    held, last = {}, {}
    for r in check(docs, pieces, 512):
        held[r.sequence_id, r.source] = held.get((r.sequence_id, r.source), 0) + r.length
        last[r.source] = max(last.get(r.source, 0), r.sequence_id)
    whole = min(last.values())  # until the first source runs out
    assert whole > 2
    for w in range(whole):
        for s in names:
            assert abs(held.get((w, s), 0) - 512 * weights[s] / sum(weights.values())) <= 1 + len(names) / 2


def test_every_source_needs_a_weight(spark, odd_docs):
    with pytest.raises(ValueError, match="no positive weight"):
        packing.pack(odd_docs, PATH, 64, weights={"a": 1.0})
