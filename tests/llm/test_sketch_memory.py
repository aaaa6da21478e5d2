import tracemalloc

import numpy as np
import pandas as pd

from statera.llm import words


def test_a_task_of_a_sketch_holds_little(monkeypatch):
    """A corpus of distinct hashes, the worst for a task: all are sent with their counts, and its own memory stays below 48 MB."""

    class Docs:
        def select(self, *_):
            return self

        def mapInPandas(self, run, _):
            tracemalloc.start()
            sent = sum(sum(map(len, b["n"])) // 4 for b in run(iter([pd.DataFrame({"text": [str(i)]}) for i in range(100)])))
            self.found = sent, tracemalloc.get_traced_memory()[1] / 1e6
            tracemalloc.stop()
            raise StopIteration

    hashes = lambda part: iter([np.arange(int(part[0]) * 30_000, (int(part[0]) + 1) * 30_000, dtype=np.uint64) << np.uint64(42)])
    docs = Docs()
    try:
        words.sketch(docs, hashes, 22)
    except StopIteration:
        pass
    assert docs.found[0] == 3_000_000 and docs.found[1] < 48, docs.found
