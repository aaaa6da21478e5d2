"""Operator 5: WARC archives, written and read back with boundary-chain verification.

Archives are plain WARC 1.0 files. Reading splits them at the version line wherever it stands, so any task can start
anywhere; every such place is a candidate record with an offset and, by its Content-Length, a successor offset. Pointer
jumping from offset 0 keeps the records that the chain reaches; version lines inside payloads are not reached.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statera.llm.common import new_folder, running_start, stored

MAGIC, CRLF = "WARC/1.0\r\n", "\r\n"
#: Payloads of at least so many bytes are stored once; bytes of an archive whose chain one task follows; rows that are
#: sent to every executor instead of being shuffled for.
SHARED_BYTES, SEGMENT, BROADCAST_ROWS = 100, 64 << 20, 50_000
DATE = "2000-01-01T00:00:00Z"


def _few(df: DataFrame) -> DataFrame:
    """Broadcast if it is counted to be small; a large one is joined by a shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def decisions(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, first (the smallest page_id with an equal payload of SHARED_BYTES or more, if another row has it)."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    large = rows.where(F.octet_length("payload") >= SHARED_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("_n"))
    return rows.join(_few(stored(large.where("_n > 1").drop("_n"), "shared")), "digest", "left")


def record(rows: DataFrame) -> Column:
    """The record up to the line break that the writer adds: a response with its HTTP block, or a revisit without payload."""
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit(CRLF + CRLF))
    block = F.when(rows["revisit"], F.lit("HTTP/1.1 200 OK\r\n\r\n")).otherwise(F.concat(http, F.col("payload")))
    head = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(rows["revisit"], F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), page, F.lit(">"))),
        line("WARC-Date", F.lit(DATE)),
        F.when(F.col("url").isNotNull(), line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20"))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(rows["revisit"], line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">")))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
    )
    return F.concat(head, line("Content-Length", F.octet_length(block).cast("string")), F.lit(CRLF), block, F.lit(CRLF))


def write_archives(pages: DataFrame, path: str) -> None:
    """A record per row, in as many files as pages has partitions.

    Null html is empty; rows that repeat the smallest page_id of a payload are all responses; control characters and
    spaces of a url become %20; no rows give no records.
    """
    rows = decisions(pages)
    rows = rows.withColumn("revisit", F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
    rows.select(record(rows).alias("value")).write.option("lineSep", CRLF).text(path)


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """What stands between version lines: file, block and nth (which order a file's chunks), mark (what tells chunks of a file
    apart unless they are equal), value. Block and nth depend on how files are split, so they hold for one scan only."""
    text = spark.read.option("lineSep", MAGIC).text(path)
    return text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"),
        F.xxhash64("value").alias("mark"), "value",
    )


def _field(head: Column, name: str, value: str = "([^\r\n]*)") -> Column:
    found = F.regexp_extract(head, rf"(?i)(?:^|\n){name}: *{value}", 1)
    return F.when(found != "", found)


def _payload(raw: Column, head_bytes: Column, length: Column) -> Column:
    """The bytes behind the HTTP header of a block."""
    block = F.substring(raw, head_bytes + 5, length)
    http = F.octet_length(F.substring_index(block.cast("string"), CRLF + CRLF, 1))
    return F.substring(block, http + 5, length)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every chunk with its offset; those that could be records with fields, successor and the digest of a payload that they hold whole."""
    head = F.substring_index("value", CRLF + CRLF, 1)
    rows = chunks(spark, path).select("file", "block", "nth", "mark", "value", F.octet_length("value").cast("long").alias("bytes"), head.alias("head"))
    rows = rows.withColumn("head_bytes", F.octet_length("head")).withColumn("length", _field(F.col("head"), "Content-Length", r"(\d{1,10})\r?(?:\n|$)").try_cast("int"))
    whole = F.col("bytes") == F.col("head_bytes") + 8 + F.col("length")
    payload = _payload(F.col("value").cast("binary"), F.col("head_bytes"), F.col("length"))
    return rows.select(
        "file", "block", "nth", "mark", "bytes", "head_bytes", "length",
        _field(F.col("head"), "WARC-Type").alias("type"),
        _field(F.col("head"), "WARC-Record-ID", r"<urn:page:(-?\d+)>").try_cast("long").alias("page_id"),
        _field(F.col("head"), "WARC-Refers-To", r"<urn:page:(-?\d+)>").try_cast("long").alias("refers_to"),
        _field(F.col("head"), "WARC-Payload-Digest", "sha256:([0-9a-f]+)").alias("digest"),
        F.when(whole, F.sha2(payload, 256)).alias("own_digest"),
        F.when(whole, F.octet_length(payload).cast("long")).alias("own_bytes"),
    )


def _offsets(rows: DataFrame) -> DataFrame:
    """start of the version line before each chunk (below 0 for what stands before the first), next: the offset behind its record.

    A task adds up one split of an archive; the splits' sums give each its start.
    """
    rows = running_start(rows.withColumn("_span", F.col("bytes") + len(MAGIC)), "file", "block", [F.col("nth")], "_span", "_before")
    rows = rows.withColumn("start", F.col("_before") - len(MAGIC)).drop("block", "nth", "_span", "_before")
    return rows.withColumn("next", F.col("start") + len(MAGIC) + F.col("head_bytes") + 8 + F.col("length"))


def jump(start: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Indices of the successors among ``start`` (sorted); n for one that is not there."""
    at = np.searchsorted(start, following)
    return np.where((at < len(start)) & (start[np.minimum(at, len(start) - 1)] == following), at, len(start))


def reached(start: np.ndarray, following: np.ndarray, entry: int) -> np.ndarray:
    """Which places the chain from ``entry`` visits, by pointer jumping."""
    n = len(start)
    to = np.append(jump(start, following), n)
    seen = np.zeros(n + 1, bool)
    seen[jump(start, np.array([entry]))[0]] = True
    for _ in range(n.bit_length() + 1):
        seen[to[np.flatnonzero(seen)]] = True
        to = to[to]
    return seen[:n]


def leaves(start: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Where the chain from each place leaves the segment: the successor offset of the last place on it."""
    n = len(start)
    last = jump(start, following)
    last = np.where(last < n, last, np.arange(n))
    for _ in range(n.bit_length() + 1):
        last = last[last]
    return following[last]


def records(rows: DataFrame) -> DataFrame:
    """file and start of the chunks (rows with start and next) that the chain from offset 0 of their file reaches.

    Segments of an archive are followed by one task each; where files have several, the places at which chains enter
    segments are joined with where they leave them, doubling the distance each round.
    """
    spots = rows.where("start >= 0 AND next IS NOT NULL").select("file", F.floor(F.col("start") / SEGMENT).alias("segment"), "start", "next")
    entries = spots.where("segment = 0").select("file", "segment").distinct().withColumn("entry", F.lit(0).cast("long"))
    if spots.where("segment > 0").limit(1).count():
        entries = stored(_entries(spots), "entries")

    def within(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("start")
        keep = reached(b["start"].to_numpy(np.int64), b["next"].to_numpy(np.int64), int(b["entry"].iloc[0]))
        return b.loc[keep, ["file", "start"]]

    return spots.join(entries, ["file", "segment"]).groupBy("file", "segment").applyInPandas(within, "file string, start long")


def _entries(spots: DataFrame) -> DataFrame:
    """file, segment, entry: where the chain from offset 0 enters each segment."""

    def out(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("start")
        return b.assign(next=leaves(b["start"].to_numpy(np.int64), b["next"].to_numpy(np.int64)))[["file", "start", "next"]]

    hops = stored(spots.groupBy("file", "segment").applyInPandas(out, "file string, start long, next long"), "hops")
    known = stored(spots.where("start = 0").select("file", "start"), "entered")
    while True:
        further = known.join(hops, ["file", "start"]).select("file", F.col("next").alias("start")).union(known).distinct()
        further = stored(further, "entered")
        if further.count() == known.count():
            break
        ahead = hops.select("file", F.col("start").alias("next"), F.col("next").alias("_after"))
        hops = stored(hops.join(ahead, ["file", "next"], "left").select("file", "start", F.coalesce("_after", "next").alias("next")), "hops")
        known = further
    found = known.join(spots.select("file", "start", "segment"), ["file", "start"])
    return found.groupBy("file", "segment").agg(F.min("start").alias("entry"))


def owned(rows: DataFrame, true: DataFrame) -> DataFrame:
    """Add ``owner``: the last true start up to each chunk, whose record the chunk is part of (null before the first).

    A task follows one segment of an archive; what reaches into a segment comes from the segments' last starts.
    """
    both = rows.unionByName(true.withColumn("_true", F.col("start")), allowMissingColumns=True).withColumn("_segment", F.floor(F.col("start") / SEGMENT))
    earlier = Window.partitionBy("file").orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    last = both.groupBy("file", "_segment").agg(F.max("_true").alias("_last")).withColumn("_carried", F.max("_last").over(earlier)).drop("_last")
    within = Window.partitionBy("file", "_segment").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    marked = both.withColumn("_within", F.max("_true").over(within)).where("_true IS NULL").join(last, ["file", "_segment"])
    return marked.withColumn("owner", F.coalesce("_within", "_carried")).drop("_true", "_segment", "_within", "_carried")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record_type, refers_to, file, offset, payload_bytes, payload_digest of every true record.

    Digest and size are of the payload read, a revisit's of the response that it names by digest (null if there is none).
    A payload that holds version lines is put together from its chunks, which a second scan fetches by file, mark and size:
    however files are split then, it finds the same ones.
    """
    rows = stored(_offsets(stored(candidates(spark, path), "candidates")), "offsets")
    rows = stored(owned(rows, stored(records(rows), "true")), "owned")
    kept = rows.where("owner = start")
    broken = kept.where("own_digest IS NULL AND type = 'response'").select("file", "owner", F.col("next").alias("_to"), F.col("head_bytes").alias("_head"), F.col("length").alias("_length"))
    pieces = rows.select("file", "start", "owner", "mark", "bytes").join(broken, ["file", "owner"]).where("start < _to")
    pieces = stored(pieces.withColumnRenamed("owner", "_from"), "pieces")
    values = chunks(spark, path).select("file", "mark", F.octet_length("value").cast("long").alias("bytes"), "value")
    values = values.join(_few(stored(pieces.select("file", "mark", "bytes").distinct(), "marks")), ["file", "mark", "bytes"]).dropDuplicates(["file", "mark", "bytes"])
    texts = values.join(pieces, ["file", "mark", "bytes"])
    parts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "value"))), lambda x: x["value"]), MAGIC)
    texts = texts.groupBy("file", F.col("_from").alias("start"), "_head", "_length").agg(parts.alias("value"))
    payload = _payload(F.col("value").cast("binary"), F.col("_head"), F.col("_length"))
    joined = texts.select("file", "start", F.sha2(payload, 256).alias("_digest"), F.octet_length(payload).cast("long").alias("_bytes"))
    every = kept.join(joined, ["file", "start"], "left").select(
        "page_id", F.col("type").alias("record_type"), "refers_to", "file", F.col("start").alias("offset"), "digest",
        F.coalesce("own_digest", "_digest").alias("_own"), F.coalesce("own_bytes", "_bytes").alias("_size"),
    )
    whole = every.where("record_type = 'response'").select(*every.columns, F.col("_size").alias("payload_bytes"), F.col("_own").alias("payload_digest"))
    named = whole.groupBy(F.col("_own").alias("digest")).agg(F.max("_size").alias("payload_bytes")).withColumn("payload_digest", F.col("digest"))
    again = every.where("record_type = 'revisit'").join(named, "digest", "left").select(*every.columns, "payload_bytes", "payload_digest")
    return whole.unionByName(again).select("page_id", "record_type", "refers_to", "file", "offset", "payload_bytes", "payload_digest")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = new_folder(spark, "warc")
    write_archives(pages, path)
    return read_archives(spark, path)
