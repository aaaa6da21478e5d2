"""Queries op4 and op6: thin digests of packing and mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statera.llm import mixing, packing
from statera.llm.common import read_table


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents", "doc_id", "source", "text")
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, mixed, _ = mixing.mixture(read_table(spark, sf_dir, "documents", "doc_id", "source", "text"))
    return mixing.taken(rows, mixed)


QUERIES = {"op4_packing": op4_packing, "op6_mixing": op6_mixing}
ORACLE: dict[str, str] = {}
