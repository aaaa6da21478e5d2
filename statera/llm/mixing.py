"""Operator 6: mixing sources to target weights.

Each source's words, in a fixed pseudorandom order of documents, are cut into blocks of equal length. The mix is a
row of output shards of equal numbers of slots. A shard's counts of each source are a multinomial draw, given the
totals: a seeded binary tree over the shards splits the totals, so that any task draws its own shard's counts, and
where they start, without the others. Slot j of a source takes block p(j) of a pseudorandom permutation of the
source's blocks, and slots and blocks are joined by that index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statera.llm.common import buckets_for, lean, running_start, stored
from statera.llm.packing import served

WEIGHTS, EPOCHS, MOST_REPEATS = (5, 2, 1), Fraction(3, 2), 2
#: Words of a block, slots of an output shard and of a run of shards, documents of a bucket, sources whose totals the driver
#: may hold.
BLOCK, SHARD, RUN_SLOTS, BUCKET_ROWS, MOST_SOURCES = 256, 2_048, 1 << 28, 4_096, 100_000
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Source:
    name: str | None
    size: int
    target: float
    blocks: int
    slots: int
    last: int  # words that the last slot takes


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, epochs: Fraction = EPOCHS, most: int = MOST_REPEATS) -> list[float]:
    """Shares of ``epochs`` times all sizes by weight, none above ``most`` times its size, the excess shared anew."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    left, free, out = epochs * sum(sizes), set(range(len(sizes))), [Fraction(0)] * len(sizes)
    while free:
        total = sum(weight[i] for i in free)
        over = {i for i in free if left * weight[i] > total * most * sizes[i]}
        for i in over or free:
            out[i] = Fraction(most * sizes[i]) if over else left * weight[i] / total
        left -= sum(out[i] for i in over)
        free = free - over if over else set()
    return [float(x) for x in out]


def permuted(j: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1: a Feistel network over the next even number of bits, walked until within."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask, out, todo = np.uint64((1 << half) - 1), j.astype(np.uint64), np.arange(len(j))
    while len(todo):
        x = out[todo]
        left, right = x >> np.uint64(half), x & mask
        for turn in range(4):
            seed = np.uint64((key * 0x9E3779B97F4A7C15 + turn * 0xD1B54A32D192ED03 + 1) % 2**64)
            h = (right + seed) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((h >> np.uint64(32)) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def place_of(value: int, n: int, key: int) -> int:
    """The j that ``permuted`` takes to value: the same network backwards."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for turn in reversed(range(4)):
            seed = (key * 0x9E3779B97F4A7C15 + turn * 0xD1B54A32D192ED03 + 1) % 2**64
            h = (left + seed) * 0xBF58476D1CE4E5B9 % 2**64
            h = (h ^ (h >> 29)) * 0x94D049BB133111EB % 2**64
            left, right = right ^ ((h >> 32) & mask), left
        value = left << half | right
        if value < n:
            return value


def split(counts: np.ndarray, take: int, seed: tuple[int, ...]) -> np.ndarray:
    """How many of each source fall in the first ``take`` slots: a multivariate hypergeometric draw."""
    return np.random.default_rng(seed).multivariate_hypergeometric(counts, take, method="marginals")


@lru_cache(maxsize=2)
def _ends(slots: bytes, run: int, size: int) -> np.ndarray:
    """Slots of each source before a run and after it, made once for the shards of a run that a task meets in turn."""
    return served(np.frombuffer(slots, np.int64), run, run + 1, size)


def shard_counts(slots: np.ndarray, shards: int, shard: int, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A shard's slots of each source, and how many of each the shards before it have.

    Runs of RUN_SLOTS slots have each source's share to a slot, as in packing; a run's slots are dealt to its shards by draws.
    """
    run = max(1, RUN_SLOTS // size)
    first, last = shard // run * run, min(shards, (shard // run + 1) * run)
    ends = _ends(slots.astype(np.int64).tobytes(), shard // run, run * size)
    counts, before, low, high = ends[1] - ends[0], ends[0], first, last
    while high - low > 1:
        mid = (low + high) // 2
        left = split(counts, (mid - low) * size, (seed, low, high))
        if shard < mid:
            counts, high = left, mid
        else:
            counts, before, low = counts - left, before + left, mid
    return counts, before


@dataclass(frozen=True)
class Plan:
    sources: list[Source]
    seed: int
    block: int
    shard: int

    @property
    def shards(self) -> int:
        return -(-sum(s.slots for s in self.sources) // self.shard)


def plan_of(sizes: list[tuple[str | None, int]], seed: int, block: int, shard: int) -> Plan:
    """Slots of each source: whole passes over its blocks, then as many as the rest of the target needs, the last one cut."""
    sources = []
    for i, ((name, size), target) in enumerate(zip(sizes, targets([n for _, n in sizes]), strict=True)):
        blocks, tail = -(-size // block), size - (-(-size // block) - 1) * block
        passes, rest = divmod(round(target), size) if size else (0, 0)
        slots, last = passes * blocks, 0
        if rest:
            n = -(-rest // block)
            at = place_of(blocks - 1, blocks, seed + i)  # the slot that takes the short last block
            have = n * block - (block - tail if at < n else 0)
            if have < rest:
                n, have = n + 1, have + block
            slots, last = slots + n, rest - (have - (tail if at == n - 1 else block))
        sources.append(Source(name, size, target, blocks, slots, last))
    return Plan(sources, seed, block, shard)


def word_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the text, null: 0), _text (hash of text and, where there is one, lang: it orders repeated ids and tells them apart)."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), _identity(docs).alias("_text"))


def _identity(docs: DataFrame) -> Column:
    return F.xxhash64("text", "lang") if "lang" in docs.columns else F.xxhash64("text")


def queued(sizes: DataFrame, seed: int, block: int, shard: int) -> tuple[DataFrame, Plan]:
    """The rows with _source (its place) and _start (words of the source before it), and the plan."""
    found = sizes.groupBy("source").agg(F.sum("size"), F.count("*")).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"{len(found)} sources; mixing takes {MOST_SOURCES}")
    found.sort(key=lambda r: (r[0] is None, (r[0] or "").encode()))
    plan = plan_of([(r[0], int(r[1])) for r in found], seed, block, shard)
    spark = sizes.sparkSession
    names = spark.createDataFrame([(i, s.name, s.size, s.target) for i, s in enumerate(plan.sources)], "_source int, _name string, source_size long, target double")
    n = buckets_for(sum(r[2] for r in found), BUCKET_ROWS)
    rows = sizes.join(F.broadcast(names), F.col("source").eqNullSafe(F.col("_name"))).drop("_name")
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "_text", F.lit(seed)), F.lit(n)).cast("int"))
    return running_start(rows, "_source", "_bucket", [F.col("doc_id"), F.col("size"), F.col("_text")], "size", "_start"), plan


def slots(spark: SparkSession, plan: Plan) -> DataFrame:
    """shard, slot, _source, _block, copy (pass over the source), words (what it takes of the block at most)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        each = np.array([s.slots for s in plan.sources], np.int64)
        for b in batches:
            for shard in b["id"]:
                size = min(plan.shard, int(each.sum()) - int(shard) * plan.shard)
                counts, before = shard_counts(each, plan.shards, int(shard), plan.shard, plan.seed)
                place, out = np.random.default_rng((plan.seed, int(shard))).permutation(size), []
                for i in np.flatnonzero(counts):
                    s = plan.sources[i]
                    j = before[i] + np.arange(counts[i])
                    words = np.where((j == s.slots - 1) & (s.last > 0), s.last, plan.block)
                    out.append(pd.DataFrame({"shard": shard, "_source": np.int32(i), "_block": permuted(j % s.blocks, s.blocks, plan.seed + int(i)), "copy": j // s.blocks, "words": words}))
                yield pd.concat(out).assign(slot=place)[["shard", "slot", "_source", "_block", "copy", "words"]]

    parts = max(1, min(plan.shards, 64 * spark.sparkContext.defaultParallelism))
    return spark.range(0, plan.shards, 1, parts).mapInPandas(lean(run), "shard long, slot long, _source int, _block long, copy long, words long")


def mix(rows: DataFrame, plan: Plan) -> DataFrame:
    """The mix: a row for each part of a document in a slot.

    Columns: shard, slot, copy, _source, _start (the document's place), doc_id, first (its first word there), n_words.
    """
    block = plan.block
    held = rows.where("size > 0").select("_source", "_start", "doc_id", "size")
    last = F.floor((F.col("_start") + F.col("size") - 1) / block)
    parts = held.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_start") / block), last)))
    begin = F.greatest(F.col("_start"), F.col("_block") * block)
    end = F.least(F.col("_start") + F.col("size"), (F.col("_block") + 1) * block, F.col("_block") * block + F.col("words"))
    # both sides grow with the corpus, whatever is estimated of the slots' size
    out = slots(rows.sparkSession, plan).join(parts.hint("merge"), ["_source", "_block"])
    out = out.select("shard", "slot", "copy", "_source", "_start", "doc_id", (begin - F.col("_start")).alias("first"), (end - begin).alias("n_words"))
    return out.where("n_words > 0")


def mixture(docs: DataFrame, seed: int = 0, block: int = BLOCK, shard: int = SHARD) -> tuple[DataFrame, DataFrame, Plan]:
    """(rows with their source's size and target, the mix over them, the plan).

    Sources by code point, null last, weigh 5, 2, 1, repeating. No block is taken more often than twice, so no document
    exceeds twice its size. Null and wordless texts take part with size 0; repeated rows are documents of their own;
    no rows give an empty mix. The same rows and seed give the same mix.
    """
    rows, plan = queued(stored(word_sizes(docs), "sizes"), seed, block, shard)
    rows = stored(rows, "queued")
    return rows, mix(rows, plan), plan


def taken(rows: DataFrame, mixed: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (words of the document in the mix, repeats counted)."""
    sums = mixed.groupBy("_source", "_start").agg(F.sum("n_words").alias("_taken"))
    some = F.when(F.col("size") > 0, F.coalesce("_taken", F.lit(0))).otherwise(F.lit(0))  # a wordless row shares its place with the next one
    return rows.join(sums, ["_source", "_start"], "left").select("doc_id", "size", "source_size", "target", some.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 0, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """The mix as documents: one row for each document and pass that takes part of it, with the words taken, in order.

    doc_id, lang and source stay; a text keeps the white space between words taken together. Rows that repeat id, source,
    text and lang are told apart by nothing: what they take comes out as one of them. Null and wordless texts give no
    rows, nor does an empty table.
    """
    rows, mixed, _ = mixture(docs, seed, block, shard)
    spans = mixed.groupBy("_source", "_start", "copy").agg(F.sort_array(F.collect_list(F.struct("first", "n_words"))).alias("spans"))
    named = lambda doc, name: (F.coalesce(F.col(doc).cast("long"), F.lit(-(2**63))).alias("_doc"), F.coalesce(F.concat(F.lit("="), name), F.lit("")).alias("_name"))
    taken_of = rows.where("size > 0").select("_source", "_start", "_text", *named("doc_id", "source")).join(spans, ["_source", "_start"])
    key = ["_doc", "_name", "_text"]
    keyed = taken_of.groupBy(key).agg(F.collect_list(F.struct("copy", "spans")).alias("takes"), F.count_distinct("_start").alias("_rows"))
    texts = docs.select("doc_id", "text", "lang", "source", *named("doc_id", "source"), _identity(docs).alias("_text"))
    joined = texts.join(keyed, key)
    # what several equal rows take together goes to one of them
    full = joined.where("_rows = 1").unionByName(joined.where("_rows > 1").dropDuplicates(key))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        word = re.compile(WORD)
        for b in batches:
            out = []
            for doc, text, lang, source, takes in zip(b["doc_id"], b["text"], b["lang"], b["source"], b["takes"], strict=True):
                at = [m.span() for m in word.finditer(text)]
                for take in takes:
                    runs: list[list[int]] = []
                    for s in take["spans"]:
                        first, end = int(s["first"]), int(s["first"]) + int(s["n_words"])
                        if runs and runs[-1][1] == first:
                            runs[-1][1] = end
                        else:
                            runs.append([first, end])
                    whole = runs == [[0, len(at)]]
                    new = text if whole else "\n".join(text[at[i][0] : at[j - 1][1]] for i, j in runs)
                    out.append((doc, new, lang, source, len(new)))
            yield pd.DataFrame(out, columns=["doc_id", "text", "lang", "source", "n_chars"])

    kept = full.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang", "source", "takes")
    out = kept.mapInPandas(lean(run), "doc_id string, text string, lang string, source string, n_chars long")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
