import numpy as np
import pytest

from statera.llm import packing


@pytest.mark.parametrize(("small", "each", "large", "at"), [(300, 10, 20_000, 999), (300, 10, 20_000, 4_999), (600, 2, 30_000, 7_490), (600, 1, 5_000, 2_490)])
def test_many_equal_sources_move_a_token_far(small, each, large, at):
    totals = np.array([each] * small + [large])
    size = np.array([1, 1, 30, 50])
    start = at + np.cumsum(size) - size
    p = packing.cut(start, size, small, totals, 16)
    assert np.bincount(p["row"], p["end"] - p["start"], len(size)).tolist() == size.tolist()
    for r in range(len(size)):
        mine = p["row"] == r
        begin, end = np.sort(p["start"][mine]), np.sort(p["end"][mine])
        assert begin[0] == 0 and end[-1] == size[r] and (begin[1:] == end[:-1]).all()
    # the same windows and places as when all windows are searched
    q = packing.served(totals, 0, -(-int(totals.sum()) // 16), 16)[:, small]
    for s, w in zip((start[p["row"]] + p["start"]).tolist(), p["window"].tolist(), strict=True):
        assert q[w] <= s < q[w + 1]


def test_missing_tokens_are_an_error(monkeypatch):
    whole = packing.served
    monkeypatch.setattr(packing, "served", lambda totals, first, last, length: np.minimum(whole(totals, first, last, length), 100))
    with pytest.raises(ValueError, match="do not hold all"):
        packing.cut(np.array([0]), np.array([1_000]), 0, np.array([1_000, 500]), 64)
