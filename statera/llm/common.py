"""What several operators share: reading tables, the shared scratch folder, running offsets, language-neutral words."""

from __future__ import annotations

import atexit
import ctypes
import math
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_OWN: dict[str, str] = {}
_CACHES: dict[str, Callable[[], None]] = {}


def caches(name: str, clear: Callable[[], None]) -> None:
    """Register what empties a cache that one operator keeps in Python workers, which serve all operators in turn."""
    _CACHES[name] = clear


def lean(run: Callable[[Iterator], Iterator], name: str | None = None) -> Callable[[Iterator], Iterator]:
    """A task's function for mapInPandas or mapInArrow that leaves little behind in its Python worker, which serves all
    operators in turn: before, caches of others are emptied; after, memory that is free goes back to the system."""

    def task(parts: Iterator) -> Iterator:
        from statera.llm import common  # the worker's own module: what this function carries along would be a copy

        for other, clear in common._CACHES.items():
            if other != name:
                clear()
        try:
            yield from run(parts)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return task


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one table; everything goes through Spark's readers, so any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def scratch(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Where it is unset, a local session gets a temporary folder of its own; a cluster is an error, since
    executors could not see that folder.
    """
    if shared := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return shared.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN[app] = tempfile.mkdtemp(prefix="statera-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return f"file://{_OWN[app]}"


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{scratch(spark)}/statera/{label}-{uuid.uuid4().hex}"


#: Shuffle files of a finished write are dropped at once: nothing reads them again.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write the rows to the shared folder and read them back: lineage ends at files that outlive executors."""
    spark = df.sparkSession
    path, before = new_folder(spark, label), spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.select("*").write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*frames: DataFrame) -> None:
    """Delete the files of stored tables that nothing will read again."""
    for df in frames:
        if files := df.inputFiles():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def few(df: DataFrame, rows: int, size: Column | None = None, most: int = 0) -> DataFrame:
    """Broadcast if it is counted to have no more than so many rows, and no more than ``most`` of ``size`` (a sum) where rows
    differ in size; a larger one is joined by a shuffle."""
    n, total = df.agg(F.count("*"), F.coalesce(size if size is not None else F.lit(0), F.lit(0))).collect()[0]
    return F.broadcast(df) if n <= rows and total <= most else df


#: Rows of a broadcast that holds the hot keys of a join.
HOT_KEYS = 4_096


def spread_join(rows: DataFrame, one: DataFrame, key: list[str], count: str) -> DataFrame:
    """Rows with the columns of ``one``, which has a row for each of their keys and in ``count`` how many rows have it.

    Of keys that hold more than one in HOT_KEYS of all rows there are fewer than HOT_KEYS: their rows of ``one`` are broadcast.
    The other keys are joined by a shuffle in which none is hot.
    """
    total = one.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    added = [c for c in one.columns if c not in key]
    hot = one.where(F.col(count) > total / HOT_KEYS).select(*key, F.struct(*added).alias("_hot"))
    marked = rows.join(F.broadcast(hot), key, "left")
    there = marked.where("_hot IS NOT NULL").select(*rows.columns, "_hot.*")
    rest = marked.where("_hot IS NULL").select(*rows.columns).join(one.where(F.col(count) <= total / HOT_KEYS), key)
    return there.union(rest.select(*rows.columns, *added))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets_for(rows: int, per_bucket: int) -> int:
    return max(1, math.ceil(rows / per_bucket))


def running_start(df: DataFrame, group: str, bucket: str, order: list[Column], size: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``size`` over the rows before this one in its group, groups ordered by bucket, then ``order``.

    A group may hold most rows: only one (group, bucket) is summed in a task, and the sums of its buckets
    (one row each) give every bucket its start.
    """
    sums = df.groupBy(group, bucket).agg(F.sum(size).alias("_bucket_sum"))
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(group, bucket, F.coalesce(F.sum("_bucket_sum").over(before), F.lit(0)).alias("_bucket_start"))
    within = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(starts, [group, bucket])
        .withColumn(out, F.col("_bucket_start") + F.coalesce(F.sum(size).over(within), F.lit(0)))
        .drop("_bucket_start")
    )
