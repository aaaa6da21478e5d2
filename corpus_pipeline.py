"""From documents to training sequences: language ID, line dedup, near duplicates, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir), docs being what the stage before it kept, and returns a DataFrame; all but the
last have the columns of documents. SQL cannot express the learnt profiles, the sketch orders or the draws, so
ORACLE_SQL is None and the stages are tested against brute-force versions of their operators.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statera.llm import language, lines, mixing, packing, similar
from statera.llm.common import read_table, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents that are handed to a Python worker at a time: whole texts, so far fewer than Spark's own 10,000.
BATCH_CONF, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2_000


def sized(spark: SparkSession) -> None:
    """Five operators share an executor's memory with their workers: unless the session has a smaller one, set the batch size."""
    if int(spark.conf.get(BATCH_CONF)) > BATCH_ROWS:
        spark.conf.set(BATCH_CONF, BATCH_ROWS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; it becomes their lang. Repeated rows get equal results, ties go to the smaller name, no rows
    give none. Text without a letter, or null, is rejected, and so is text whose
    score is below language.least_score, which all texts with a language give: it is in none of the languages learnt. Where none could be learnt, all text with a
    letter stays, with the lang it had."""
    sized(spark)
    learnt = language.profiles(docs)
    if not learnt:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    found = stored(language.predictions(docs, learnt, COLUMNS), "predicted")
    known = (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") > 0) & (F.col("score") >= language.least_score(found))
    return found.where(known).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier line matches; a document that has no word left goes. Null ids come first; texts of a repeated or
    null id are told apart by a hash; rows that repeat both are treated alike; no rows give none."""
    return lines.dedup_lines(docs.select(*COLUMNS)).where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*COLUMNS)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, four fifths or more in common. Of ties the smallest
    id stays, null ids last; no rows give none."""
    return similar.one_of_each(docs.select(*COLUMNS), 5, 80)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' words drawn to the sources' targets; a row for each document and pass that takes part of it. A
    null source is a source; repeated rows are documents of their own; no rows give none."""
    return mixing.mixed_documents(docs).select(*COLUMNS)


def packing_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 4096 tokens: their ids (unsigned little-endian 32 bits) and the CRC32 of these. Null
    text is an empty document; no rows give none."""
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("mixing sources to target weights", mixing_sources),
    ("packing", packing_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; each one's rows are written to the shared folder and read again by the next."""
    docs = read_table(spark, sf_dir, "documents", *COLUMNS)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
