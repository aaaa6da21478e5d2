"""Operator 12: SimHash near duplicates, found by vantage-point trees.

A fingerprint's bit is the majority of that bit in the hashes of a text's shingles. Distinct fingerprints are nodes. A
tree over a bounded sample of them cuts the space into shards: at each vantage point, what lies within a radius is
inside, the rest outside. A fingerprint is stored in the one shard it lies in and asked of the others that its ball
overlaps: by the triangle inequality only those where its distance to the vantage point is near the radius. A pair is parted first
where one is inside and one outside, and there the inner one goes over, so the outer one need not. In a shard a second
tree of the same kind, over all that is stored there, answers exactly. Groups of copies are one node from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statera.llm.common import lean, spread_join, stored
from statera.llm.components import components
from statera.llm.words import word_runs

SEED = 42
#: Fingerprints that the tree of shards is built from, at most, and those stored in a shard, about; points of a leaf of
#: a shard's own tree; distances that it holds at a time.
SAMPLE, SHARD_ROWS, LEAF, CELLS = 1 << 18, 50_000, 128, 1 << 22
_WORD = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))


def fingerprint(text: str | None, words: int = 3) -> int:
    """64 bits: a bit is 1 if more than half of the shingles' XXH64 hashes have it. Fewer words are one shingle, none give 0."""
    ones, n = np.zeros(64, np.int64), 0
    for run in word_runs((text or "").encode(), _WORD, words - 1):
        hashes = _hashes(run, words)
        n += len(hashes)
        for i in range(0, len(hashes), 1 << 16):
            part = hashes[i : i + (1 << 16)]
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    if not n and run:  # all of its words, fewer than a shingle's, are in the last run
        ones, n = np.unpackbits(_hashes(run, len(run)).view(np.uint8), bitorder="little"), 1
    return int.from_bytes(np.packbits(2 * ones.astype(np.int64) > n, bitorder="little").tobytes(), "little")


def _hashes(run: list[bytes], words: int) -> np.ndarray:
    joined, ends = b" ".join(run), np.cumsum([len(w) + 1 for w in run]) - 1
    first, last = np.append(0, ends[:-1] + 1)[: max(0, len(run) - words + 1)], ends[words - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(first.tolist(), last.tolist(), strict=True)], "<u8")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t.as_py(), words) for t in b.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, fp long")


class VantageTree:
    """A binary tree over distinct points: node i has a vantage point, a radius and two branches (negative: a leaf)."""

    def __init__(self, points: np.ndarray, leaf: int) -> None:
        self.vantage, self.radius, self.inside, self.outside = [], [], [], []
        self.leaves: list[np.ndarray] = []
        self.root = self._grown(points, leaf)

    def _grown(self, points: np.ndarray, leaf: int) -> int:
        cut = _cut(points) if len(points) > leaf else None
        if cut is None:
            self.leaves.append(points)
            return -len(self.leaves)
        vantage, radius, far = cut
        at = len(self.vantage)
        for kept, x in ((self.vantage, vantage), (self.radius, radius), (self.inside, 0), (self.outside, 0)):
            kept.append(x)
        self.inside[at] = self._grown(points[~far], leaf)
        self.outside[at] = self._grown(points[far], leaf)
        return at

    def visits(self, x: np.ndarray, reach: int, own: bool) -> Iterator[tuple[int, np.ndarray, bool]]:
        """(leaf, rows of x, whether they lie in it) for all leaves that may hold points within ``reach`` of them.

        With ``own``, x are the tree's points, and of two points that are close only one visits the other's leaf.
        Without, no row counts as lying in a leaf, and rows visit all leaves that their ball overlaps.
        """
        todo = [(self.root, np.arange(len(x)), own)]
        while todo:
            at, rows, mine = todo.pop()
            if not len(rows):
                continue
            if at < 0:
                yield -at - 1, rows, mine
                continue
            d = np.bitwise_count(x[rows] ^ self.vantage[at])
            near, far = d <= self.radius[at], d > self.radius[at]
            if mine:
                todo += [(self.inside[at], rows[near], True), (self.outside[at], rows[far], True)]
                todo.append((self.outside[at], rows[near & (d + reach > self.radius[at])], False))
            else:
                todo.append((self.inside[at], rows[d <= self.radius[at] + reach], False))
                todo.append((self.outside[at], rows[d + reach > self.radius[at]], False))


def _cut(points: np.ndarray) -> tuple[np.uint64, int, np.ndarray] | None:
    """A vantage point, of a few the one whose distances differ most, a radius near their median, and who lies outside."""
    few = points[np.linspace(0, len(points) - 1, 8).astype(int)]
    some = points[np.linspace(0, len(points) - 1, min(len(points), 512)).astype(int)]
    spread = np.bitwise_count(few[:, None] ^ some[None, :]).std(axis=1)
    vantage = few[spread.argmax()]
    d = np.bitwise_count(points ^ vantage)
    radius = int(np.median(d))
    if radius >= d.max():
        radius = int(d.max()) - 1
    far = d > radius
    return (vantage, radius, far) if far.any() and not far.all() else None


class Joined:
    """Which points links have joined so far: only links that join two groups are kept."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def _top(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def fresh(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        out = []
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = self._top(x), self._top(y)
            if p != q:
                self.up[p] = q
                out.append((x, y))
        return out


def close_pairs(tree: VantageTree, x: np.ndarray, bits: int, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of x and the tree's points that differ in ``bits`` bits or fewer; a pair of two of its points comes once."""
    for leaf, rows, mine in tree.visits(x, bits, own):
        y = tree.leaves[leaf]
        step = max(1, CELLS // len(y))
        for i in range(0, len(rows), step):
            part = x[rows[i : i + step]]
            p, q = np.nonzero(np.bitwise_count(part[:, None] ^ y[None, :]) <= bits)
            keep = part[p] < y[q] if mine else part[p] != y[q]
            yield part[p[keep]], y[q[keep]]


def links(nodes: DataFrame, bits: int) -> DataFrame:
    """a, b: fingerprints of nodes (fp) that differ in few bits; enough of these links to join all that are joined."""
    n = nodes.count()
    sample = np.array([r[0] for r in nodes.orderBy(F.xxhash64("fp"), "fp").select("fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    tree = VantageTree(sample, max(2, int(len(sample) * min(1.0, SHARD_ROWS / max(n, 1)))))
    tree.leaves = [x[:0] for x in tree.leaves]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("fp").to_numpy().view(np.uint64)
            for shard, rows, mine in tree.visits(x, bits, own=True):
                yield pa.record_batch({"shard": pa.array(np.full(len(rows), shard), pa.int32()), "asked": pa.array(np.full(len(rows), not mine)), "fp": pa.array(x[rows].view(np.int64))})

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, own, joined = None, [], None, Joined()

        def found(x: np.ndarray, stored_here: bool) -> Iterator[pa.RecordBatch]:
            for a, b in close_pairs(own, x, bits, stored_here):
                if fresh := joined.fresh(a.view(np.int64), b.view(np.int64)):
                    yield pa.record_batch({"a": pa.array([p for p, _ in fresh], pa.int64()), "b": pa.array([q for _, q in fresh], pa.int64())})

        def begun() -> Iterator[pa.RecordBatch]:
            """The shard's own points are all here: they meet each other."""
            nonlocal own
            points = np.concatenate(held) if held else np.zeros(0, np.uint64)
            own = VantageTree(points, LEAF)
            yield from found(points, True)

        for b in batches:
            shard, asked = b.column("shard").to_numpy(), b.column("asked").to_numpy(zero_copy_only=False)
            x = b.column("fp").to_numpy().view(np.uint64)
            starts = np.flatnonzero(np.concatenate(([True], (shard[1:] != shard[:-1]) | (asked[1:] != asked[:-1]))))
            for i, j in zip(starts, np.append(starts[1:], len(x)), strict=True):
                if shard[i] != now:
                    if now is not None and own is None:
                        yield from begun()
                    now, held, own, joined = shard[i], [], None, Joined()
                if not asked[i]:
                    held.append(x[i:j].copy())
                    continue
                if own is None:
                    yield from begun()
                yield from found(x[i:j], False)
        if now is not None and own is None:
            yield from begun()

    rows = nodes.select("fp").mapInArrow(lean(dealt), "shard int, asked boolean, fp long")
    sorted_rows = rows.repartition("shard").sortWithinPartitions("shard", "asked")
    return sorted_rows.select("shard", "asked", "fp").mapInArrow(lean(answered), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links, its own included) of each row.

    Null, empty and wordless texts have fingerprint zero and link like others. Repeated rows have equal fingerprints.
    Documents of a null id link, but give no component its name: without others it is null. No rows give no rows; other
    columns of docs play no part.
    """
    rows = stored(fingerprints(docs, words), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("label")), "nodes")
    parts = components(links(nodes, bits)).withColumnRenamed("node", "fp")
    named = stored(nodes.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "named")
    least = named.groupBy("component").agg(F.min("label").alias("component_id"), F.count("*").alias("members"))
    classes = stored(spread_join(named, least, ["component"], "members").select("fp", "n", "component_id"), "classes")
    return spread_join(rows, classes, ["fp"], "n").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
