"""Words of whole texts as 64-bit hashes, and counts of hashes over a corpus: what the set joins stand on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statera.llm.common import dropped, lean, stored

_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
#: Bytes of text that are taken at a time (a longer text is taken alone), log2 of the counters of a slice of a sketch,
#: buckets or words that a task counts before it sends sums, hashes that it sorts at a time, and tasks whose slices are added up together.
BATCH, SLICE_BITS, HELD, SORTED, FAN_IN = 1 << 18, 17, 1 << 19, 1 << 18, 512
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, base: int, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        x = np.full(2 * n, np.uint64(base))
        x[0] = 1
        _powers[kind] = np.multiply.accumulate(x)
    return _powers[kind]


def batches(texts: list[str]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts in UTF-8, ASCII letters lower-cased, of about BATCH bytes, each with the place of its first."""
    held, size, first = [], 0, 0
    for i, t in enumerate(texts):
        x = t.encode().lower()
        if held and size + len(x) > BATCH:
            yield first, held
            held, size, first = [], 0, i
        held.append(x)
        size += len(x) + 1
    if held:
        yield first, held


def word_runs(text: bytes, table: bytes, carried: int, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """A text's words in runs of about ``size`` bytes, each but the first after the last ``carried`` words before it.

    ``table`` translates bytes: what is no part of a word becomes a space. A text without words is one empty run.
    """
    text, old, a = text.translate(table), [], 0
    while True:
        b = text.find(b" ", a + size)
        words = old + text[a : b if b >= 0 else len(text)].split()
        yield words
        if b < 0:
            return
        old, a = words[-carried:] if carried else [], b


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, its line counted over all texts, lines of each text); words end at ASCII white space, lines at feeds.

    A word's hash is a polynomial over its bytes, from differences of running sums: no word is handled by itself.
    """
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = (joined == 32) | (joined - np.uint8(9) < 5)
    edge = np.flatnonzero(np.diff(space, prepend=True))
    start, end = edge[0::2], edge[1::2]
    sums = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum(joined * _power("up", _BASE, len(joined))[: len(joined)], out=sums[1:])
    h = (sums[end] - sums[start]) * _power("down", _INVERSE, len(joined))[start]
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h ^= h >> np.uint64(29)
    feeds = np.flatnonzero(joined == 10)
    line = np.repeat(np.arange(len(feeds)), np.diff(np.searchsorted(start, feeds), prepend=0))
    return h, line, np.array([t.count(b"\n") + 1 for t in texts], np.int64)


def sketch(docs: DataFrame, hashes: Callable[[list[str]], Iterator[np.ndarray]], bits: int, finish: Callable[[np.ndarray], np.ndarray] = np.asarray) -> np.ndarray:
    """Counts per bucket (the first bits of a hash) over all texts.

    A task sends the buckets that it has seen, with counts, a slice of the buckets a row; it holds about HELD of them, nothing
    as large as all counters. Slices are added up for FAN_IN tasks at a time, then in all. ``finish`` turns counts (4 bytes
    each) into what is kept of them; the driver gets only that.
    """
    low = min(bits, SLICE_BITS)

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fresh, size = [], 0
        at, n = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        for b in parts:
            for x in hashes(b["text"].tolist()):
                fresh.append((x >> np.uint64(64 - bits)).astype(np.uint32))
                size += len(x)
                if size > SORTED:
                    at, n = _added(at, n, fresh)
                    fresh, size = [], 0
                    if len(at) > HELD:
                        yield slices(at, n)
                        at, n = at[:0], n[:0]
        at, n = _added(at, n, fresh)
        if len(at):
            yield slices(at, n)

    def slices(at: np.ndarray, n: np.ndarray) -> pd.DataFrame:
        part = at >> np.uint32(low)
        first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        ends = np.append(first[1:], len(at))
        n = np.minimum(n, 2**32 - 1).astype("<u4")
        inner = (at & np.uint32((1 << low) - 1)).astype("<u4")
        kept = [(inner[i:j].tobytes(), n[i:j].tobytes()) for i, j in zip(first, ends, strict=True)]
        return pd.DataFrame({"slice": part[first].astype(np.int32), "at": [x for x, _ in kept], "n": [x for _, x in kept]})

    def added(b: pd.DataFrame) -> np.ndarray:
        total = np.zeros(1 << low, np.int64)
        for at, n in zip(b["at"], b["n"], strict=True):
            total[np.frombuffer(at, "<u4")] += np.frombuffer(n, "<u4")
        return np.minimum(total, 2**32 - 1).astype(np.uint32)

    def some(b: pd.DataFrame) -> pd.DataFrame:
        total = added(b)
        at = np.flatnonzero(total).astype("<u4")
        return pd.DataFrame({"slice": [b["slice"].iloc[0]], "at": [at.tobytes()], "n": [total[at].astype("<u4").tobytes()]})

    def whole(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"slice": [b["slice"].iloc[0]], "sums": [finish(added(b)).tobytes()]})

    kind = "slice int, at binary, n binary"
    sums = docs.select("text").mapInPandas(lean(count), kind).withColumn("tasks", F.floor(F.spark_partition_id() / FAN_IN))
    sums = sums.groupBy("slice", "tasks").applyInPandas(some, kind)
    dtype = finish(np.zeros(1, np.uint32)).dtype
    out = np.tile(finish(np.zeros(1, np.uint32)), 1 << bits).reshape(-1, 1 << low)
    found = stored(sums.groupBy("slice").applyInPandas(whole, "slice int, sums binary"), "sketch")  # its shuffle files go when it is written
    for r in found.toLocalIterator():
        out[r["slice"]] = np.frombuffer(r["sums"], dtype)
    dropped(found)
    return out.reshape(-1)


def _added(at: np.ndarray, n: np.ndarray, fresh: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted buckets and their counts, with those of fresh ones added."""
    if not fresh:
        return at, n
    new = np.sort(np.concatenate(fresh))
    first = np.flatnonzero(np.concatenate(([True], new[1:] != new[:-1])))[: len(new)]
    both, counts = np.concatenate((at, new[first])), np.concatenate((n, np.diff(first, append=len(new))))
    by = np.argsort(both, kind="stable")
    both, counts = both[by], counts[by]
    first = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1])))[: len(both)]
    return both[first], np.add.reduceat(counts, first) if len(first) else counts


def graded(counts: np.ndarray) -> np.ndarray:
    """Counts in one byte that keeps their order: exact up to 15, then eight grades for each power of two."""
    x = np.maximum(counts, 1).astype(np.float64)
    return np.where(counts <= 15, counts, np.minimum(255, 16 + np.floor(8 * (np.log2(x) - 4)))).astype(np.uint8)


def least_counts() -> np.ndarray:
    """The least count of each grade."""
    grade = np.arange(256, dtype=np.float64)
    return np.where(grade <= 15, grade, np.exp2((grade - 16) / 8 + 4))
