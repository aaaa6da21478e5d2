"""Operator 10: document fingerprints by winnowing.

Every k-gram of code points is hashed with a rolling polynomial; of each window of w successive hashes the
smallest is kept, of equal ones the rightmost, with its position. Two texts that share a passage of at least
``w + k - 1`` code points share a kept hash.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statera.llm.common import buckets_for, lean, shuffle_width

GRAM, WINDOW = 16, 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
#: Documents in one range of ids, and the most ranges (their limits are held by the driver).
RANGE_ROWS, MOST_RANGES = 2_000, 4_096


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(32))


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all k-grams; blocks double, so that a gram takes log k steps."""
    n = len(codes)
    out, power, done = None, None, 0
    block, block_power, length = codes.astype(np.uint64) + np.uint64(1), _BASE, 1
    while True:
        if k & length:
            if out is None:
                out, power = block, block_power
            else:
                out = out[: n - done - length + 1] * block_power + block[done : done + n - done - length + 1]
                with np.errstate(over="ignore"):
                    power = power * block_power
            done += length
        if 2 * length > k:
            return _spread(out)
        m = n - 2 * length + 1
        block = block[:m] * block_power + block[length : length + m]
        with np.errstate(over="ignore"):
            block_power = block_power * block_power
        length *= 2


def winnow(text: str, k: int = GRAM, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes kept. Text shorter than k is one gram; fewer than w hashes are one window; empty text has none."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = gram_hashes(codes, min(k, len(codes)))
    n, w = len(hashes), min(w, len(hashes))
    at, length = np.arange(n), 1
    best = hashes
    while 2 * length <= w:
        at, best = _rightmost(at, best, length, n - 2 * length + 1)
        length *= 2
    if length < w:
        at, best = _rightmost(at, best, w - length, n - w + 1)
    keep = np.concatenate(([True], at[1:] != at[:-1]))  # the place never moves left
    at = at[keep]
    return at, hashes[at]


def _rightmost(at: np.ndarray, best: np.ndarray, step: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    right = best[step : step + m] <= best[:m]
    return np.where(right, at[step : step + m], at[:m]), np.where(right, best[step : step + m], best[:m])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of kept hashes; two empty ones are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def encode(x: np.ndarray, kind: str = "<u8") -> str:
    return base64.b64encode(x.astype(kind).tobytes()).decode()


def decode(x: str, kind: str = "<u8") -> np.ndarray:
    return np.frombuffer(base64.b64decode(x), kind)


def fingerprints(docs: DataFrame, k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """doc_id, n_chars, prints (array of position and hash, 64 bits) of every whole text; null text counts as empty, repeated
    rows give equal rows, a text shorter than k is one gram, no rows give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [winnow(t, k, w) for t in b.text]
            yield pd.DataFrame({
                "doc_id": b.doc_id,
                "n_chars": b.text.str.len(),
                "prints": [[{"pos": int(p), "hash": int(h)} for p, h in zip(f[0], f[1].view(np.int64), strict=True)] for f in found],
            })

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(lean(run), "doc_id long, n_chars long, prints array<struct<pos: long, hash: long>>")


def with_next(docs: DataFrame) -> DataFrame:
    """The rows of docs in ranges of ascending ids, each range followed by the first row of the next one.

    Columns: _range, _head (true for that extra row), doc_id, text. Only the limits of ranges and their first
    ids, MOST_RANGES at most, pass the driver. Rows are ordered by id, then text; a null id comes first.
    """
    least = -(2**63)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("_id", F.coalesce("doc_id", F.lit(least)))
    n = min(MOST_RANGES, buckets_for(rows.count(), RANGE_ROWS))
    cuts = rows.approxQuantile("_id", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    limits = np.unique(np.array(cuts, dtype=np.float64)).astype(np.int64)

    @F.pandas_udf("int")
    def in_range(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(limits, ids.to_numpy(np.int64), side="right").astype(np.int32))

    rows = rows.withColumn("_range", in_range("_id"))
    firsts = sorted((r[0], r[1]) for r in rows.groupBy("_range").agg(F.min("_id")).collect())
    before = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}
    heads = rows.where(F.col("_id").isin(list(before))).groupBy("_id").agg(F.min("text").alias("text"))
    if before:
        place = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
        heads = heads.withColumn("_range", F.element_at(place, F.col("_id")).cast("int"))
    else:
        heads = heads.withColumn("_range", F.lit(0))
    every = rows.select("_range", F.lit(False).alias("_head"), "_id", "doc_id", "text").unionByName(
        heads.select("_range", F.lit(True).alias("_head"), "_id", F.lit(None).cast("long").alias("doc_id"), "text")
    )
    return every.repartition(shuffle_width(docs.sparkSession), "_range").sortWithinPartitions("_range", "_head", "_id", "text")


def edited_fingerprints(docs: DataFrame, k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """Each text's fingerprint against that of its edited text and of the next document.

    The edited text is the text whose last half (rounded down) is replaced by the first as many code points, or
    all, of the next document by ascending id; the last document is followed by the first. Null text is empty;
    repeated ids are ordered by text; a single document follows itself; no rows give no rows. Fingerprints are the kept
    hashes (64 bits) in order, ``positions`` where each was kept (32 bits), both base64: they decode to what ``winnow`` gives.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            out = []
            for span, head, doc, text in zip(b["_range"], b["_head"], b["doc_id"], b["text"], strict=True):
                at, kept = winnow(text, k, w)
                now = (span, doc, text, kept, np.unique(kept), at)
                if held is not None and held[0] == span:
                    out.append(_against(held, now, k, w))
                held = None if head else now
            yield pd.DataFrame(out, columns=list(_OUT)).astype({"doc_id": "Int64"})

    rows = with_next(docs).select("_range", "_head", "doc_id", "text")
    return rows.mapInPandas(lean(run), ", ".join(f"{c} {t}" for c, t in _OUT.items()))


_OUT = {
    "doc_id": "long", "n_chars": "long", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string",
    "near_edited": "double", "near_next": "double", "n_prints": "long", "positions": "string",
}


def _against(own: tuple, following: tuple, k: int, w: int) -> tuple:
    _, doc, text, kept, distinct, at = own
    half = len(text) // 2
    edited = text[: len(text) - half] + following[2][:half]
    _, edited_kept = winnow(edited, k, w)
    digest = hashlib.sha256(edited.encode()).hexdigest()
    near = likeness(distinct, np.unique(edited_kept)), likeness(distinct, following[4])
    return None if pd.isna(doc) else int(doc), len(text), digest, encode(kept), encode(edited_kept), *near, len(kept), encode(at, "<u4")
