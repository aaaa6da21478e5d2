"""Operator 11: the prefix trie of conversations.

A node is a distinct sequence of first turns, named by 128 hash bits: the exclusive or of its turns' hashes, each with its
place, so that the running names of a conversation can be made in parts. Each task sends a table of its nodes, already
combined; tables are merged by name, FAN_IN of them at a time, then all: members add up, end lists join. End lists are
kept in blocks by id, none longer than a block.

The rollup goes bottom-up along paths instead of level by level: a node lies on the path of its smallest member, each path
sums its own nodes from its end upwards, and the sums of paths are merged by name. So a trie of any depth takes
the same few shuffles. Conversations are split by depth and turns by range: neither a long conversation nor a
first turn that all share is handled by one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statera.llm.common import lean, spread_join, stored

#: log2 of the turns of a conversation that one window takes, log2 of the ids of a block of an end list, tables merged at once.
DEPTH_BITS, BLOCK_BITS, FAN_IN = 14, 8, 512
NODE = ["k1", "k2"]


def along(rows: DataFrame, group: list[str], bucket: str, order: list, sums: dict[str, Column], xors: dict[str, Column] | None = None, back: bool = False) -> DataFrame:
    """Rows with running sums and exclusive ors, their own row included, in a group's order of buckets, then rows.

    A task takes one bucket of a group; buckets begin with what those before them come to.
    """
    parts = {**{k: (F.sum, c) for k, c in sums.items()}, **{k: (F.bit_xor, c) for k, c in (xors or {}).items()}}
    totals = rows.groupBy(*group, bucket).agg(*[fn(c).alias(f"_{k}") for k, (fn, c) in parts.items()])
    before = Window.partitionBy(*group).orderBy(F.desc(bucket) if back else F.asc(bucket)).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*group, bucket, *[F.coalesce(fn(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k, (fn, _) in parts.items()])
    within = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = [(F.col(f"_{k}") + fn(c).over(within) if fn is F.sum else F.col(f"_{k}").bitwiseXOR(fn(c).over(within))).alias(k) for k, (fn, c) in parts.items()]
    return rows.join(starts, [*group, bucket]).select(*rows.columns, *out)


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), a, b (hashes of role and text), words of the text, of every turn that has a conv_id.

    Turns are in the order of ``turn``, null first, ties by hashes of role and text; null role and text are empty.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit("turn"), text, role).alias("b"), words.alias("words"), F.monotonically_increasing_id().alias("_row"),
    )
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("a"), F.asc("b"), F.asc("_row")]
    ranges = stored(stored(turns, "turns").repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    return along(ranges, ["conv_id"], "_part", order[1:], {"pos": F.lit(1)}).select("conv_id", "pos", "a", "b", "words")


def as_steps(own: DataFrame) -> DataFrame:
    """numbered turns as the steps that ``trie`` takes: each conversation as it is."""
    convs = own.groupBy("conv_id").agg(F.count("*").alias("depths"))
    return own.select("conv_id", F.col("pos").alias("depth"), "a", "b", "words").unionByName(_roots(convs))


def rebuilt(own: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Steps of conversations c that begin with the first h turns of c - c % every, h = crc32(c) % most, and go on after
    their own first h turns. What the other conversation lacks is left out; one that is absent gives no turns."""
    own = stored(own, "numbered")
    sizes = own.groupBy("conv_id").agg(F.count("*").alias("turns"))
    sizes = sizes.withColumn("h", F.crc32(F.col("conv_id").cast("string")) % most).withColumn("base", F.col("conv_id") - F.col("conv_id") % every)
    found = sizes.select(F.col("conv_id").alias("base"), F.col("turns").alias("_there"))
    convs = sizes.join(found, "base", "left").withColumn("given", F.least("h", F.coalesce("_there", F.lit(0)))).drop("_there")
    convs = stored(convs.withColumn("depths", F.col("given") + F.greatest(F.col("turns") - F.col("h"), F.lit(0))), "rebuilt")
    heads = own.where(F.col("pos") < most).withColumnRenamed("conv_id", "base").join(convs.where("given > 0").select("conv_id", "base", "given"), "base").where("pos <= given")
    tails = spread_join(own, convs.select("conv_id", "h", "given", "turns"), ["conv_id"], "turns").where("pos > h")
    turns = heads.select("conv_id", F.col("pos").alias("depth"), "a", "b", "words").union(tails.select("conv_id", (F.col("pos") - F.col("h") + F.col("given")).alias("depth"), "a", "b", "words"))
    return turns.unionByName(_roots(convs))


def _roots(convs: DataFrame) -> DataFrame:
    return convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("words"))


def merged(rows: DataFrame, key: list[str], *aggs: tuple[str, str]) -> DataFrame:
    """(name, function) of each column, merged by key: by tasks first, then FAN_IN of their tables at a time, then all."""
    tables = len(rows.inputFiles())
    while tables > FAN_IN:
        tables = -(-tables // FAN_IN)
        rows = rows.groupBy(*key, F.pmod(F.spark_partition_id(), F.lit(tables)).alias("_tables")).agg(*[F.expr(f"{fn}({c})").alias(c) for c, fn in aggs]).drop("_tables")
    return rows.groupBy(*key).agg(*[F.expr(f"{fn}({c})").alias(c) for c, fn in aggs])


def trie(steps: DataFrame) -> DataFrame:
    """The nodes of steps (conv_id, depth from the root's 0 on, a, b, words): conv_id (the smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and k1, k2, which name a node.

    Turnless conversations end at the root. No conversations give no nodes, not even a root.
    """
    ha, hb = (F.when(F.col("depth") > 0, x).otherwise(F.lit(0)) for x in (F.xxhash64("depth", "a", "b"), F.xxhash64("b", "depth", "a")))
    rows = steps.withColumn("bucket", F.shiftright("depth", DEPTH_BITS)).withColumn("ha", ha).withColumn("hb", hb)
    paths = along(rows, ["conv_id"], "bucket", [F.asc("depth")], {}, {"k1": F.col("ha"), "k2": F.col("hb")})
    parent = [F.when(F.col("depth") > 0, F.col(k).bitwiseXOR(F.col(h))).alias(p) for k, h, p in (("k1", "ha", "p1"), ("k2", "hb", "p2"))]
    paths = stored(paths.select("conv_id", "depth", "bucket", *NODE, *parent, "words"), "paths")
    nodes = merged(paths.withColumn("n_convs", F.lit(1)), NODE, ("conv_id", "min"), ("depth", "min"), ("p1", "min"), ("p2", "min"), ("words", "min"), ("n_convs", "sum"))
    nodes = stored(nodes, "nodes")
    children = stored(nodes.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children")), "children")
    nodes = stored(nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    above = nodes.where("n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_n"))
    below = spread_join(nodes.where("depth > 0"), above, ["p1", "p2"], "_n").select(*NODE, "parent_conv_id")
    out = nodes.join(below, NODE, "left").join(_rollup(paths, nodes), NODE).join(_ends(paths), NODE, "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"), *NODE,
    )


def _rollup(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """n_leaves and saved_tokens of each node's subtree: paths sum the nodes that are theirs, from the end upwards."""
    leaf, saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("words")
    theirs = nodes.select("conv_id", "depth", leaf.alias("leaf"), saved.alias("saved")).where("leaf > 0 OR saved > 0")
    worth = paths.select("conv_id", "depth", "bucket", *NODE).join(theirs, ["conv_id", "depth"], "left")
    sums = {"n_leaves": F.coalesce("leaf", F.lit(0)), "saved_tokens": F.coalesce("saved", F.lit(0))}
    up = along(worth, ["conv_id"], "bucket", [F.desc("depth")], sums, back=True)
    return merged(up.where("n_leaves > 0 OR saved_tokens > 0"), NODE, ("n_leaves", "sum"), ("saved_tokens", "sum"))


def _ends(paths: DataFrame) -> DataFrame:
    """ends_sha256 of the nodes where conversations end. Ids are joined block by block; the digest of a node runs over
    its blocks in order, of which a task holds one batch."""
    last = paths.groupBy("conv_id").agg(F.max(F.struct("depth", *NODE)).alias("_l")).select("_l.k1", "_l.k2", "conv_id")
    block = F.shiftright("conv_id", BLOCK_BITS).alias("block")
    blocks = last.groupBy(*NODE, block).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for b in batches:
            done = []
            for k1, k2, ids in zip(*[b.column(c).to_pylist() for c in (*NODE, "ids")], strict=True):
                if (k1, k2) != now:
                    if now:
                        done.append((*now, digest.hexdigest()))
                    now, digest = (k1, k2), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield _digests(done)
        if now:
            yield _digests([(*now, digest.hexdigest())])

    parts = blocks.repartition(*NODE).sortWithinPartitions(*NODE, "block")
    return parts.select(*NODE, "ids").mapInArrow(lean(run), "k1 long, k2 long, ends_sha256 string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"k1": pa.int64(), "k2": pa.int64(), "ends_sha256": pa.string()}
    return pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())], list(kinds))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """``trie`` of the conversations as they are: turns in order of ``turn``, null first. Null role and text are empty, rows without a
    conv_id belong to no conversation and take no part, repeated rows are turns of their own."""
    return trie(as_steps(numbered(conversations)))
