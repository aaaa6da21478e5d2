"""Operator 9: n-gram Jaccard join by token-combination prefixes.

A document's set is its distinct word shingles. All shingles have one order: rare ones by their count in a sketch, then
frequent ones, dealt into small classes. Of a pair with enough in common, the prefix that is long enough holds a common
rare shingle, or two common ones of a class of frequent shingles: those are indexed. A class counts for one shingle
less than it has, so prefixes are extended until what is counted exceeds the shingles that a partner may lack.

Candidates are verified on whole sets. Groups of copies are not expanded into pairs: equal sets are one node; each index
entry first links its nodes along their sizes; pairs of nodes that these links join already need no check, all others get one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statera.llm.common import dropped, few, lean, stored
from statera.llm.components import components
from statera.llm.words import batches, graded, hashed, least_counts
from statera.llm.words import sketch as count_sketch

#: Least and most log2 of the sketch's counters (executors are sent their array, a byte each), and characters of the corpus
#: for one of them in between; sizes below which all shingles count as rare; shingles of a class of frequent ones; nodes
#: sent to executors instead of being shuffled for.
LEAST_BITS, MOST_BITS, CHARS, SMALL, CLASS, BROADCAST_ROWS = 22, 26, 256, 64, 4, 500_000
#: Nodes of an index entry that one task orders: of a larger entry, blocks of so many.
BLOCK_ROWS = 2_048
#: What names a document: its id (the least number for a null one) and a hash of its text and of whether the id is null.
KEY = ["_id", "_hash"]
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def shingles_of(texts: list[str], words: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles; fewer words than that are one shingle."""
    for _, part in batches(texts):
        x, line, lines = hashed(part)
        ends = np.searchsorted(line, np.cumsum(lines))
        for first, end in zip(np.concatenate(([0], ends[:-1])), ends, strict=True):
            own = x[first:end]
            k = min(words, len(own))
            h = np.full(max(0, len(own) - k + 1) if k else 0, k, np.uint64)
            for i in range(k):
                h = (h ^ (h >> np.uint64(29))) * _P + own[i : len(own) - k + 1 + i]
            yield np.unique((h ^ (h >> np.uint64(32))) * _Q)


def shingles(text: str | None, words: int) -> np.ndarray:
    """One text's; ASCII letters lower-cased, words split at ASCII white space only."""
    return next(shingles_of([text or ""], words))


def bits_for(size: int) -> int:
    """log2 of the counters for a corpus of so many characters."""
    return min(MOST_BITS, max(LEAST_BITS, (size // CHARS).bit_length()))


def sketch(docs: DataFrame, words: int, bits: int) -> np.ndarray:
    """Grades of how many documents each hash bucket of shingles has, over the whole corpus."""
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))

    def hashes(part: list[str]) -> Iterator[np.ndarray]:
        for i in range(0, len(part), 128):
            yield np.concatenate(list(shingles_of(part[i : i + 128], words)))

    return count_sketch(texts, hashes, bits, graded)


def least_common(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def signatures(tokens: np.ndarray, seen: np.ndarray, frequent: float, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """What is indexed for a set: rare shingles of the prefix, and pairs within classes of its frequent ones; and of each
    how many of the set's shingles can't be common to a partner with which it is the first to be shared.

    ``seen`` are the sketch's counts or grades, ``frequent`` is one of them. Classes depend on the power of two below a set's size; a set whose partners can
    lie beyond a power of two is indexed for both sides of it. Before the first shared pair each earlier class can hold
    one common shingle.
    """
    n = len(tokens)
    need = n - least_common(n, percent) + 1
    order = np.lexsort((tokens, seen))
    low, high = least_common(n, percent), 100 * n // percent
    out, pos = [], []
    rare = int((seen <= frequent).sum())
    for level in range(max(1, low).bit_length() - 1, high.bit_length()):
        singles = need if (1 << level) < SMALL or rare >= need else rare
        out.append(tokens[order[:singles]])
        pos.append(np.arange(singles))
        if singles == need:
            continue
        rest = tokens[order[rare:]]
        kinds = ((rest * _P) >> np.uint64(33)) % np.uint64((1 << level) // CLASS)
        by = np.lexsort((rest, kinds))
        rest, kinds = rest[by], kinds[by]
        first = np.concatenate(([True], kinds[1:] != kinds[:-1]))
        counted = np.cumsum(~first)  # a class counts for one less than it has
        end = int(np.searchsorted(counted, need - rare)) + 1
        rest, begin = rest[:end], np.flatnonzero(first[:end])
        salt = np.uint64(level * int(_Q) % 2**64)
        for q, (a, b) in enumerate(zip(begin, np.append(begin[1:], len(rest)), strict=True)):
            i, j = np.triu_indices(b - a, 1)
            h = (rest[a:b][i] ^ salt) * _P + rest[a:b][j]
            out.append((h ^ (h >> np.uint64(31))) * _Q)
            pos.append(rare + a + i - q)
    sigs, at = np.unique(np.concatenate(out), return_index=True)
    return sigs, np.concatenate(pos)[at]


def keyed(docs: DataFrame) -> DataFrame:
    """_id, _hash, known (whether there is an id), text (null: empty)."""
    text, there = F.coalesce(F.col("text"), F.lit("")), F.col("doc_id").isNotNull()
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_id"), F.xxhash64(text, there).alias("_hash"), there.alias("known"), text.alias("text"))


def limits(grades: np.ndarray) -> tuple[int, int]:
    """Grades up to which shingles are rare, and up to which hardly any document shares them, by the mean of all counters."""
    steps = np.bincount(grades, minlength=256)
    mean = float(steps @ least_counts()) / len(grades)
    rare, own = graded(np.array([4 * mean + 64, 2 * mean + 16]))
    return int(rare), int(own)


def indexed(docs: DataFrame, words: int, percent: int, bits: int | None) -> DataFrame:
    """_id, _hash, known, n (size of its set), core (its shingles that others seem to have), digest of the set, what is indexed."""
    if bits is None:
        bits = bits_for(docs.agg(F.sum(F.length("text"))).first()[0] or 0)
    grades = sketch(docs, words, bits)
    frequent, shared = limits(grades)
    held = docs.sparkSession.sparkContext.broadcast(grades)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = held.value
        for b in batches:
            n, digests, kept, places, core = [], [], [], [], []
            for x in shingles_of(b["text"].tolist(), words):
                n.append(len(x))
                digests.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
                at = seen[(x >> np.uint64(64 - bits)).astype(np.int64)]
                core.append(int((at > shared).sum()))
                sigs, pos = signatures(x, at, frequent, percent) if len(x) else (x, np.zeros(0, np.int64))
                kept.append(sigs.view(np.int64))
                places.append(pos)
            yield b[[*KEY, "known"]].assign(n=n, core=core, digest=digests, sigs=kept, pos=places)

    return keyed(docs).mapInPandas(lean(run), "_id long, _hash long, known boolean, n long, core long, digest binary, sigs array<long>, pos array<int>")


def sets_of(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """node and its set of those nodes, from the texts of the documents that stand for them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [x.tobytes() for x in shingles_of(b["text"].tolist(), words)]
            right = [hashlib.blake2b(x, digest_size=16).digest() == d for x, d in zip(found, b["digest"], strict=True)]
            yield pd.DataFrame({"node": b["node"], "tokens": found})[right]

    rows = keyed(docs).select(*KEY, "text").join(few(nodes.select(*KEY, "node", "digest"), BROADCAST_ROWS), KEY)
    return rows.select("node", "digest", "text").mapInPandas(lean(run), "node long, tokens binary").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b whose sets have percent or more of their union in common."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = np.zeros(len(b), bool)
            for i, (x, y) in enumerate(zip(b["x"], b["y"], strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield b.loc[keep, ["a", "b"]]

    one = sets.select(F.col("node").alias("a"), F.col("tokens").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInPandas(lean(run), "a long, b long")


def _fits(percent: int) -> str:
    """Sizes allow a link, and enough of both sets can be common where they first share an entry."""
    return f"p <> q AND 100 * least(p_n, q_n) >= {percent} * greatest(p_n, q_n) AND {100 + percent} * least(p_n - p_pos, q_n - q_pos) >= {percent} * (p_n + q_n)"


def _pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs a, b (smaller node, larger node) of rows with p, p_n, p_pos and q, q_n, q_pos that may be links."""
    return rows.where(_fits(percent)).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def _named(prefix: str, source: str = "") -> list:
    return [F.col(f"{source}node").alias(prefix), F.col(f"{source}n").alias(f"{prefix}_n"), F.col(f"{source}pos").alias(f"{prefix}_pos")]


def _sets(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """The sets of the nodes in pairs."""
    involved = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    return stored(sets_of(docs, stored(involved.join(nodes.select("node", *KEY, "digest"), "node"), "involved"), words), "sets")


def shared(rows: DataFrame) -> DataFrame:
    """The rows of index entries that several nodes have: no other can give a pair.

    Entries are counted, and the shuffle files of that are gone, before the rows are dealt.
    """
    counts = stored(rows.groupBy("sig").agg(F.count("*").alias("_m")).where("_m > 1").select("sig"), "counts")
    kept = stored(rows.join(counts, "sig").select(*rows.columns), "shared")
    dropped(counts)
    return kept


def first_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs that may be links: in each index entry, nodes with the next smaller one and with the one that has most in common
    with others, which is closest to all of a group of copies.

    An entry of more than BLOCK_ROWS nodes is dealt into blocks; each has such a node of its own, paired with the entry's.
    Entries are counted before they are shuffled, so a hot one is one row a task there.
    """
    centre = F.max(F.struct("core", "node", "n", "pos"))
    entries = rows.groupBy("sig").agg(F.count("*").alias("_m"), centre.alias("_c")).where("_m > 1")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("_m") / BLOCK_ROWS))
    dealt = rows.join(entries, "sig").withColumn("_block", F.pmod(F.xxhash64("node"), blocks))
    block = Window.partitionBy("sig", "_block")
    beside = F.lag(F.struct("node", "n", "pos")).over(block.orderBy("n", "node"))
    both = dealt.withColumn("_b", beside).withColumn("_o", centre.over(block))
    others = [F.col("_b"), *[F.col(c).dropFields("core") for c in ("_o", "_c")]]
    others[2] = F.when(F.col("_o.node") == F.col("node"), others[2])
    tried = both.select(*_named("p"), F.explode(F.array(*others)).alias("_q")).where("_q IS NOT NULL")
    return _pairs(tried.select("p", "p_n", "p_pos", *_named("q", "_q.")), percent)


def rest_pairs(rows: DataFrame, joined: DataFrame, near: DataFrame, percent: int) -> DataFrame:
    """Pairs that may be links between nodes that share an entry and that ``joined`` (node, component) does not join yet.

    Entries within one component are left out. Nodes of others meet those of their own class of size and of the next ones,
    the only ones that can be similar enough. An entry of more than BLOCK_ROWS nodes is dealt into blocks; its nodes meet
    each block by itself.
    """
    placed = rows.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = placed.groupBy("sig").agg(F.min("component").alias("_low"), F.max("component").alias("_high"), F.ceil(F.count("*") / BLOCK_ROWS).alias("_blocks")).where("_low < _high")
    mixed = placed.join(several.select("sig", "_blocks"), "sig").withColumn("_class", F.floor(F.log("n") / float(np.log(100 / percent)) + 1e-9))
    mixed = stored(mixed, "mixed")
    one = mixed.select("sig", *_named("p"), F.col("component").alias("_p"), "_blocks", F.explode(F.array(F.col("_class") - 1, F.col("_class"), F.col("_class") + 1)).alias("_class"))
    one = one.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_block")).drop("_blocks")
    other = mixed.select("sig", "_class", F.pmod(F.xxhash64("node"), "_blocks").alias("_block"), *_named("q"), F.col("component").alias("_q"))
    rest = one.join(other, ["sig", "_class", "_block"]).where(f"p < q AND _p <> _q AND {_fits(percent)}")
    return _pairs(rest, percent).join(near, ["a", "b"], "left_anti")


def links(docs: DataFrame, words: int = 3, percent: int = 90, bits: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with n and digest; nodes, one for each distinct set; components of the nodes that have links).

    The components are those of all links between sets that have percent of their union in common.
    """
    whole = stored(indexed(docs, words, percent, bits), "indexed")
    sets = whole.where("n > 0").groupBy("digest").agg(
        F.min(F.struct(*KEY)).alias("k"), F.min(F.when(F.col("known"), F.col("_id"))).alias("label"), F.first("n").alias("n"), F.first("core").alias("core"),
        F.first(F.arrays_zip(F.col("sigs").alias("sig"), "pos")).alias("sigs"),
    )
    numbered = stored(sets.select("digest", "k.*", "label", "n", "core", "sigs", F.monotonically_increasing_id().alias("node")), "numbered")
    seen = stored(whole.select(*KEY, "known", "n", "digest"), "seen")
    dropped(whole)
    rows = shared(numbered.select("node", "n", "core", F.inline("sigs").alias("sig", "pos")))
    nodes = stored(numbered.drop("sigs"), "nodes")
    dropped(numbered)
    near = stored(first_pairs(rows, percent), "near")
    first = stored(verified(near, _sets(docs, near, nodes, words), percent), "links")
    rest = stored(rest_pairs(rows, components(first), near, percent), "rest")
    second = stored(verified(rest, _sets(docs, rest, nodes, words), percent), "links")
    return seen, nodes, components(first.union(second))


def _classes(docs: DataFrame, words: int, percent: int, bits: int | None) -> tuple[DataFrame, DataFrame]:
    """(documents with words: _id, _hash, known, n, component; documents without)."""
    seen, nodes, parts = links(docs, words, percent, bits)
    named = nodes.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("label").alias("component_id"))
    classes = named.select("digest", "component").join(least, "component")
    return seen.where("n > 0").select(*KEY, "known", "n", "digest").join(classes, "digest"), seen.where("n = 0")


def near_duplicates(docs: DataFrame, words: int = 3, percent: int = 90, bits: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, its own included) of every document.

    Null, empty and wordless texts have an empty set and no link; fewer words than a shingle's are one shingle; repeated
    rows have equal sets and so one component. Documents of a null id link like others, but give no component its name:
    where there are no others it is null. No rows give no rows; other columns of docs play no part.
    """
    some, none = _classes(docs, words, percent, bits)
    doc = F.when(F.col("known"), F.col("_id")).alias("doc_id")
    rows = some.select(doc, F.col("n").alias("n_shingles"), "component_id")
    return rows.union(none.select(doc, F.col("n").alias("n_shingles"), doc.alias("component_id")))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, bits: int | None = None) -> DataFrame:
    """The rows of docs without near duplicates: of each component the one with the smallest doc_id stays.

    Rows that repeat an id with another text are documents of their own, ordered by a hash of the text; a null id comes
    last. Of rows that repeat both id and text the one with the least values stays. Texts without words have no near
    duplicates: all stay. No rows give no rows.
    """
    some, _ = _classes(docs, words, percent, bits)
    first = some.groupBy("component").agg(F.min(F.struct(~F.col("known"), *KEY)).alias("k")).select("k._id", "k._hash")
    text, there = F.coalesce(F.col("text"), F.lit("")), F.col("doc_id").isNotNull()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_id"), F.xxhash64(text, there).alias("_hash"))
    kept = rows.join(stored(first, "kept"), KEY, "left_semi").groupBy(*KEY).agg(F.min("_row").alias("_row"))
    return kept.select("_row.*").unionByName(docs.where(~text.rlike(r"[^\x20\x09-\x0D]")))
