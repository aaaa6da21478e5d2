"""Queries op2 and op9: documents without repeated lines, near-duplicate classes of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from statera.llm import lines, similar
from statera.llm.common import read_table


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(read_table(spark, sf_dir, "documents", "doc_id", "text", "n_chars"), least_words=1)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.near_duplicates(read_table(spark, sf_dir, "documents", "doc_id", "text"), 3, 90)


QUERIES = {"op2_line_dedup": op2_line_dedup, "op9_ngram_jaccard_join": op9_ngram_jaccard_join}
ORACLE: dict[str, str] = {}
