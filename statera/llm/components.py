"""Connected components of a graph of links, by alternating stars: every link is kept, none leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statera.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of every node of the edges a, b; the diameter costs its logarithm in rounds.

    Large stars hang each node's larger neighbours on its smallest one, small stars the smaller ones and itself. A hub's
    links are summed per task before the shuffle.
    """
    now = stored(_directed(edges.select("a", "b")), "stars")
    mark = _mark(now)
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
        large = _directed(both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        now = stored(_directed(small), "stars")
        new = _mark(now)
        if new == mark:
            break
        mark = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def _directed(edges: DataFrame) -> DataFrame:
    """Each link once, from its larger to its smaller node."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).collect()[0])
