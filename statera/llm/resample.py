"""Operator 13: importance resampling towards a target distribution.

Texts become runs of word ids (an integer dictionary of the words that a task has met), n-grams tuples of ids: a tuple is
its first words' tuple and one more word, so two integers. Each distinct tuple of a task is spelled and hashed once, to
a bucket; from then on its occurrences are counted by integer. Counts per bucket of the corpus and of the target give
each bucket a gain; a document's weight is the sum of its features' gains, and the highest weights with noise are drawn.

Texts are read twice and never shuffled: tasks send a sum per bucket, then narrow rows, which range partitions rank.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statera.llm.common import lean, stored
from statera.llm.words import word_runs

#: Words and tuples that a task's dictionary holds before it starts anew (counts are kept).
KNOWN = 1_000_000
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Grams:
    """Ids of words and of tuples of words, up to ``orders`` of them, and the bucket of each."""

    def __init__(self, orders: int, buckets: int) -> None:
        self.orders, self.buckets = orders, buckets
        self.clear()

    def clear(self) -> None:
        self.ids: list[dict] = [{} for _ in range(self.orders)]
        self.spelled: list[list[bytes]] = [[] for _ in range(self.orders)]
        self.bucket = [np.zeros(1024, np.int32) for _ in range(self.orders)]

    def _new(self, order: int, code: bytes | int, spelled: bytes) -> int:
        new = self.ids[order][code] = len(self.spelled[order])
        self.spelled[order].append(spelled)
        if new == len(self.bucket[order]):
            self.bucket[order] = np.concatenate((self.bucket[order], np.zeros(new, np.int32)))
        self.bucket[order][new] = zlib.crc32(spelled) % self.buckets
        return new

    def _words(self, words: list[bytes]) -> np.ndarray:
        known = self.ids[0]
        return np.array([known[w] if w in known else self._new(0, w, w) for w in words], np.int64)

    def _longer(self, order: int, codes: np.ndarray) -> np.ndarray:
        known, words = self.ids[order], self.spelled[0]
        distinct, back = np.unique(codes, return_inverse=True)
        found = [known[c] if c in known else self._new(order, c, self.spelled[order - 1][c >> 32] + b" " + words[c & 0xFFFFFFFF]) for c in distinct.tolist()]
        return np.array(found, np.int64)[back]

    def features(self, text: str | None) -> Iterator[tuple[int, np.ndarray]]:
        """(words that are new, buckets of the features that end in them) of a text, run by run of its words."""
        carried = self.orders - 1
        for i, words in enumerate(word_runs((text or "").encode(), _WORD, carried)):
            if sum(map(len, self.spelled)) > KNOWN:
                self.clear()
            old = min(carried, seen) if i else 0
            seen = len(words)
            ids = self._words(words)
            found, tuples = [self.bucket[0][ids[old:]]], ids
            for n in range(1, min(self.orders, len(words))):
                tuples = self._longer(n, (tuples[:-1] << 32) | ids[n:])
                found.append(self.bucket[n][tuples[max(0, old - n) :]])
            yield len(words) - old, np.concatenate(found)


def bucket_counts(docs: DataFrame, orders: int, buckets: int) -> np.ndarray:
    """Features of all texts in each bucket: tasks send sums, the driver gets ``buckets`` numbers at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, n = Grams(orders, buckets), np.zeros(buckets, np.int64)
        for b in batches:
            for text in b.column(0):
                for _, found in grams.features(text.as_py()):
                    n += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.record_batch({"bucket": pa.array(at, pa.int32()), "n": pa.array(n[at], pa.int64())})

    out = np.zeros(buckets, np.int64)
    for r in docs.select("text").mapInArrow(lean(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of how much likelier a bucket is in the target, both counted one more than they are."""
    n, every, aim = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(((t + 1) * (every + n)) / ((s + 1) * (aim + n)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, keep: list[str], gain: np.ndarray, orders: int) -> DataFrame:
    """The columns ``keep`` of docs, _words, n_features and weight (sum of the gains of its features) of each row."""
    buckets = len(gain)
    kinds = [docs.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(orders, buckets)
        for b in batches:
            sums = np.zeros((b.num_rows, 3), np.int64)
            for i, text in enumerate(b.column("_text")):
                for words, found in grams.features(text.as_py()):
                    sums[i] += (words, len(found), gain[found].sum())
            own = [b.column(f"_own{i}") for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*own, *[pa.array(x) for x in sums.T]], [*keep, "_words", "n_features", "weight"])

    rows = docs.select(*[F.col(f"`{c}`").alias(f"_own{i}") for i, c in enumerate(keep)], F.col("text").alias("_text"))
    kind = ", ".join([*[f"`{k.name}` {k.dataType.simpleString()}" for k in kinds], "_words long, n_features long, weight long"])
    return rows.mapInArrow(lean(run), kind)


def ranked(rows: DataFrame, order: list, most: int) -> DataFrame:
    """rank of each row in that order from 1, null beyond ``most``; ranges are counted, then numbered each by itself."""
    spread = stored(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = spread.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.col("_start")
    found = spread.join(F.broadcast(starts), "_part").withColumn("rank", place.cast("long")).drop("_part", "_start")
    return found.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))


def resampled(docs: DataFrame, target: DataFrame, percent: int = 10, orders: int = 1, buckets: int = 10_000, seed: int = 2024, least_words: int = 20, keep: list[str] | None = None) -> DataFrame:
    """Every row of docs, its columns ``keep`` (doc_id alone if None) with n_features, weight, score, rank.

    A text's features are its runs of 1 to ``orders`` words. score is weight plus noise that the seed and doc_id fix. Of rows with
    ``least_words`` words, ``percent`` in a hundred (rounded down) are drawn, highest scores first, ties to the smaller
    doc_id, null ids last; rank is null for others. Null text has no features. Repeated rows are drawn like others, next to
    each other. A null id's noise is that of an empty one. No target text leaves all targets' counts at 0; no docs give no rows.
    """
    keep = ["doc_id"] if keep is None else keep
    gain = gains(bucket_counts(docs, orders, buckets), bucket_counts(target, orders, buckets))
    hidden = docs.withColumn("_id", F.col("doc_id"))
    rows = weighed(hidden, ["_id", *keep], gain, orders)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    rows = stored(rows.withColumn("score", F.col("weight") + noise).withColumn("_row", F.monotonically_increasing_id()), "weighed")
    fit = rows.where(F.col("_words") >= least_words)
    drawn = ranked(fit, [F.desc("score"), F.asc_nulls_last("_id"), F.asc("_row")], percent * fit.count() // 100)
    rest = rows.where(F.col("_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select(*keep, "n_features", "weight", "score", "rank")
