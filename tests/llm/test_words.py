import re
import numpy as np

from statera.llm import words


def test_words_and_lines():
    texts = ["The the\tTHE é É\n\n a\x0bb\x1cc ", "", "x" * 3000 + " y", "\n", "the"]
    got = []
    for first, part in words.batches(texts):
        h, line, lines = words.hashed(part)
        base = np.repeat(np.arange(len(part)) + first, lines)
        number = np.arange(lines.sum()) - np.repeat(np.cumsum(lines) - lines, lines)
        got += [(int(base[k]), int(number[k]), int(x)) for x, k in zip(h, line, strict=True)]
    want = []
    for i, t in enumerate(texts):
        for j, line in enumerate(t.split("\n")):
            want += [(i, j, w) for w in re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in line))]
    assert [g[:2] for g in got] == [w[:2] for w in want]
    names = {}
    for (_, _, h), (_, _, w) in zip(got, want, strict=True):
        assert names.setdefault(h, w) == w
    assert len(names) == len({w for _, _, w in want})


def test_no_collisions_among_short_words():
    every = [f"{a}{b}" for a in range(300) for b in "abcdefghij"] + [str(i) for i in range(50_000)]
    h, _, _ = words.hashed([" ".join(every).encode()])
    assert len(np.unique(h)) == len(set(every))


def test_grades_keep_order():
    x = np.array([0, 1, 2, 15, 16, 17, 40, 1000, 10**6, 4 * 10**9])
    assert (np.diff(words.graded(x).astype(int)) >= 0).all() and words.graded(x)[1] == 1


def test_grades_keep_order_and_least_counts():
    counts = np.unique(np.concatenate((np.arange(3000), 2 ** np.arange(32, dtype=np.int64) - 1))).astype(np.uint32)
    grades = words.graded(counts)
    least = words.least_counts()[grades]
    assert (np.diff(grades.astype(int)) >= 0).all() and (least <= counts + 1e-6).all()
    assert (counts <= np.maximum(15, least * 2 ** (1 / 8) + 1e-6))[counts < 2**31].all()
