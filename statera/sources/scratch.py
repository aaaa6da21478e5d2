"""Intermediate tables that several branches of a plan read: written once to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a local session has a temporary folder and a cluster is an error."""
    if shared := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return shared.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN[app] = tempfile.mkdtemp(prefix="statera-plans-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return f"file://{_OWN[app]}"


def settled(df: DataFrame, label: str) -> DataFrame:
    """The rows, written and read back: lineage ends at files that outlive executors, and branches don't repeat the work."""
    path = f"{shared_folder(df.sparkSession)}/statera/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
