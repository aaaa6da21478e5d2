"""Operator 1: nearest neighbours by a block matrix join.

Every vector is quantised once to int8 codes, a scale and the exact length of what it lost. Queries and candidates are
dealt into blocks; each pair of blocks is one tile, which gets codes alone and multiplies them: that gives every distance
with an error bound. Pairs that could still be among a query's nearest fetch their vectors, are recomputed in double
precision, and are merged by heaps.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statera.llm.common import buckets_for, lean, stored

K, QUERY_BLOCK, CANDIDATE_BLOCK = 10, 2_048, 4_096
#: Queries of a tile that are multiplied at a time; queries whose heaps a task keeps before it hands them on.
STRIP, HEAPS = 256, 10_000
#: Components beyond which vectors are multiplied by a power of two before they are quantised, so that squares stay finite.
LARGE = 1e140


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v of rows with an id and a vector that is neither zero nor holds a null or non-finite component."""
    whole = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select("vec_id", "embedding").where(whole & F.exists("embedding", lambda x: x != 0)).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, their scale, and the exact length of what each row lost."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = 1
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    return codes, scale, np.sqrt(((x - codes * scale[:, None]) ** 2).sum(axis=1))


def coded(batches: Iterator[pd.DataFrame], times: float = 1.0) -> Iterator[pd.DataFrame]:
    """Rows with codes, scale and lost (of the vector times a power of two) beside the vector; vectors may differ in length."""
    for b in batches:
        parts = []
        for _, same in b.groupby(b["v"].map(len), sort=False):
            codes, scale, lost = quantised(np.stack(same["v"]).astype(float) * times)
            parts.append(same.assign(codes=[x.tobytes() for x in codes], scale=scale, lost=lost))
        yield pd.concat(parts) if parts else b.assign(codes=[], scale=[], lost=[])


def bounds(q: tuple, c: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all distances between two lists of (codes, scale, lost)."""
    (qc, qs, qe), (cc, cs, ce) = q, c
    # products of int8 codes are whole numbers below 2**24 up to 1,040 dimensions, exact in single precision
    kind = np.float32 if qc.shape[1] <= 1_040 else np.float64
    product = (qc.astype(kind) @ cc.astype(kind).T).astype(np.float64)
    norm = lambda x, s: (x.astype(np.float64) ** 2).sum(axis=1) * s**2
    both = norm(qc, qs)[:, None] + norm(cc, cs)[None, :]
    square, rounding = both - 2 * np.outer(qs, cs) * product, 1e-12 * both  # whole numbers are exact, their scaling is not
    lost = (qe[:, None] + ce[None, :]) * (1 + 1e-9)
    low, high = np.sqrt(np.maximum(square - rounding, 0)) * (1 - 1e-12) - lost, np.sqrt(np.maximum(square + rounding, 0)) * (1 + 1e-12) + lost
    return np.where(np.isnan(low), 0, low), np.where(np.isnan(high), np.inf, high)


def _is_single(vectors: DataFrame) -> bool:
    return vectors.schema["v"].dataType.elementType.simpleString() != "double"


def _shrink(vectors: DataFrame) -> float:
    """A power of two that brings the largest component of all vectors down to about LARGE, 1 if none is beyond. Single
    precision ends long before."""
    if _is_single(vectors):
        return 1.0
    most = vectors.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0]
    return 1.0 if most is None or most <= LARGE else 2.0 ** -int(np.ceil(np.log2(most / LARGE)))


def distance(x: Column, y: Column, single: bool = False) -> Column:
    """In double precision, components added in order; where their squares leave its range, as multiples of the largest.
    Those of components in single precision never do."""
    apart = F.zip_with(x, y, lambda a, b: a.cast("double") - b.cast("double"))
    total = lambda d: F.aggregate(d, F.lit(0.0), lambda a, e: a + e * e)
    if single:
        return F.sqrt(total(apart))
    plain, most = total(apart), F.array_max(F.transform(apart, F.abs))
    fine = (plain < float("inf")) & ((plain > 1e-280) | (most == 0)) | (most == float("inf"))
    return F.when(fine, F.sqrt(plain)).otherwise(most * F.sqrt(total(F.transform(apart, lambda e: e / most))))


def _codes(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(b["codes"]), np.int8).reshape(len(b), -1), b["scale"].to_numpy(), b["lost"].to_numpy()


def tile(q: pd.DataFrame, c: pd.DataFrame, k: int) -> pd.DataFrame:
    """q_row, c_row, low, high of the pairs that may be among a query's k nearest of the block."""
    cut: list[tuple] = []
    if len(q) and len(c):
        (qc, qs, qe), block = _codes(q), _codes(c)
        q_ids, q_rows, c_ids, c_rows = q["vec_id"].to_numpy(), q["row"].to_numpy(), c["vec_id"].to_numpy(), c["row"].to_numpy()
        for at in range(0, len(q), STRIP):
            part = slice(at, at + STRIP)
            low, high = bounds((qc[part], qs[part], qe[part]), block)
            same = q_ids[part][:, None] == c_ids[None, :]
            high[same] = np.inf
            limit = np.partition(high, k - 1, axis=1)[:, k - 1] if len(c) > k else np.full(len(high), np.inf)
            i, j = np.nonzero((low <= limit[:, None]) & ~same)
            cut.append((q_rows[part][i], c_rows[j], low[i, j], high[i, j]))
    columns = [np.concatenate(x) for x in zip(*cut, strict=True)] if cut else [[]] * 4
    return pd.DataFrame(dict(zip(("q_row", "c_row", "low", "high"), columns, strict=True)))


def heaps(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """The k nearest distinct (score, vec_id) that the task sees of each query; a query may come out in several lists."""
    kept: dict[int, list[tuple[float, int]]] = {}

    def lists() -> pd.DataFrame:
        rows = [(q, v, s) for q, found in kept.items() for s, v in heapq.nsmallest(k, found)]
        kept.clear()
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    for b in batches:
        for q, rows in b.groupby("query_id", sort=False):
            found = set(kept.get(q, ())) | set(zip(rows["score"].tolist(), rows["vec_id"].tolist(), strict=True))
            kept[q] = heapq.nsmallest(k, found)
        if len(kept) > HEAPS:
            yield lists()
    yield lists()


def nearest(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest by Euclidean distance, ties to the smaller vec_id.

    ``is_query`` selects queries among the rows; all rows but the query's own id are candidates, fewer than k if there are
    fewer. Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part;
    rows that repeat an id and its vector count once; no rows give no rows. Of rows with equal vectors the k + 1 smallest
    ids are candidates: no query can rank another one of them, so copies fill no lists.
    """
    # repeats go before blocks are dealt, so that they take no place in a tile's lists
    copies = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    once = usable(vectors).dropDuplicates(["vec_id", "v"])
    least = once.withColumn("_nth", copies).where(F.col("_nth") <= k + 1).select("vec_id", "v", F.lit(True).alias("candidate"))
    rest = once.where(is_query).select("vec_id", "v", F.lit(False).alias("candidate"))
    kind = f"vec_id long, v {once.schema['v'].dataType.simpleString()}, candidate boolean, codes binary, scale double, lost double"
    times = _shrink(once)
    rows = least.unionByName(rest).mapInPandas(lean(lambda batches: coded(batches, times)), kind)
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("_size", F.size("v")), "vectors")
    sizes = rows.where("candidate").groupBy("_size").count().orderBy(F.desc("count"), "_size").limit(1).collect()
    rows = rows.where(F.col("_size") == (sizes[0][0] if sizes else 0))
    queries, candidates = rows.where("NOT candidate"), rows.where("candidate")
    n_q, n_c = buckets_for(queries.count(), QUERY_BLOCK), buckets_for(candidates.count(), CANDIDATE_BLOCK)
    dealt = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    codes = ["row", "vec_id", "codes", "scale", "lost"]
    q = queries.select(*codes, dealt(n_q).alias("q_block"), spread(n_c).alias("c_block"))
    c = candidates.select(*codes, dealt(n_c).alias("c_block"), spread(n_q).alias("q_block"))
    tiles = q.groupBy("q_block", "c_block").cogroup(c.groupBy("q_block", "c_block"))
    found = stored(tiles.applyInPandas(lambda a, b: tile(a, b, k), "q_row long, c_row long, low double, high double"), "tiles")

    nth = F.row_number().over(Window.partitionBy("q_row").orderBy("high"))
    limits = found.select("q_row", "high").withColumn("_nth", nth).where(F.col("_nth") <= k).groupBy("q_row").agg(F.max("high").alias("limit"))
    left = found.join(limits, "q_row").where("low <= limit").select("q_row", "c_row")
    left = left.join(candidates.select(F.col("row").alias("c_row"), "vec_id", F.col("v").alias("c_v")), "c_row")
    left = left.join(queries.select(F.col("row").alias("q_row"), F.col("vec_id").alias("query_id"), "v"), "q_row")
    kind = "query_id long, vec_id long, score double"
    merged = left.select("query_id", "vec_id", distance(F.col("v"), F.col("c_v"), _is_single(once)).alias("score")).mapInPandas(lean(lambda batches: heaps(batches, k)), kind)

    def ranked(b: pd.DataFrame) -> pd.DataFrame:
        best = heapq.nsmallest(k, set(zip(b["score"].tolist(), b["vec_id"].tolist(), strict=True)))
        return pd.DataFrame({"query_id": b["query_id"].iloc[0], "rank": range(1, len(best) + 1), "vec_id": [v for _, v in best], "score": [s for s, _ in best]})

    return merged.groupBy("query_id").applyInPandas(ranked, "query_id long, rank int, vec_id long, score double")
