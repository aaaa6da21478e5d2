"""Optional streaming ingest: landed statement tables are analysed batch by batch; a document that lands again is replaced."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from statera.plans.analysis import analyse
from statera.sources.store import save

ROWS = "document_id string, kind string, ref_id string, row_idx int, label string, cells array<string>, scale string, currency string, header array<string>"


def ingest(spark: SparkSession, landing: str, folder: str, checkpoint: str) -> StreamingQuery:
    """Start reading JSON files of statement rows from the landing folder; results go to ``folder``, each file once."""

    def one(batch: DataFrame, number: int) -> None:
        from pyspark.sql import functions as F

        heads = batch.select("document_id", "kind", "header").distinct().select("document_id", "kind", F.posexplode("header").alias("_p", "label"))
        save(analyse(batch.drop("header"), heads.select("document_id", "kind", (F.col("_p") + 1).alias("col"), "label")), folder)

    stream = spark.readStream.schema(ROWS).json(landing)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
