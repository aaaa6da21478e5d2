"""op6 as a whole against a plain version that lists every slot of every source."""

import re
from fractions import Fraction

import numpy as np
import pytest

from statera.llm import mixing


def brute(docs, block):
    """(doc_id, size, source_size, target, taken) of rows of doc_id, source and text with ids of their own, which one bucket holds."""
    sized, sources = [(d, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, s, t in docs], {}
    for row in sorted(sized, key=lambda r: r[0]):
        sources.setdefault(row[1], []).append(row)
    names = sorted(sources, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    size = {s: sum(r[2] for r in sources[s]) for s in names}
    target, left, free = {}, Fraction(3, 2) * sum(size.values()), list(names)
    while True:  # the excess of what is above twice its size is shared anew
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * size[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = Fraction(2 * size[s])
            left -= target[s]
        free = [s for s in free if s not in over]
        if not free:
            break
    out = []
    for i, s in enumerate(names):
        words = [r[0] for r in sources[s] for _ in range(r[2])]
        blocks = [words[k : k + block] for k in range(0, len(words), block)]
        order = mixing.permuted(np.arange(len(blocks)), len(blocks), i).tolist() if blocks else []
        taken, rest, j = dict.fromkeys((r[0] for r in sources[s]), 0), round(float(target[s])), 0
        while rest:
            for doc in blocks[order[j % len(order)]][:rest]:
                taken[doc] += 1
                rest -= 1
            j += 1
        out += [(r[0], r[2], size[s], float(target[s]), taken[r[0]]) for r in sources[s]]
    return sorted(out)


@pytest.mark.parametrize("block", [256, 7])
def test_taken_is_what_all_slots_take(spark, block):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "source", "text")
    rows, mixed, _ = mixing.mixture(docs, block=block)
    got = sorted(map(tuple, mixing.taken(rows, mixed).collect()))
    want = brute([tuple(r) for r in docs.collect()], block)
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want])


def test_small_and_empty_sources(spark):
    docs = [(1, "a", "one two three"), (2, "b", None), (3, None, "x " * 50), (4, "c", "y " * 400), (5, "a", ""), (6, "c", "z")]
    rows, mixed, _ = mixing.mixture(spark.createDataFrame(docs, "doc_id long, source string, text string"), block=8, shard=4)
    assert sorted(map(tuple, mixing.taken(rows, mixed).collect())) == brute(docs, 8)
