"""Rows to show beside the cards and charts (V2, V4-V6): values, trends, checks, flags, where a figure comes from, notices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statera.functions.vocabulary import CONCEPTS, RANKS
from statera.operators.views import LABELS, metric_text, money_text, relative_text, unavailable_text

HIGH = RANKS.index("high")
#: What a reader is told of the basis: level and text.
BASIS = {
    "consolidated": ("info", "Figures are of the group as a whole."),
    "standalone_fallback": ("warning", "There are no consolidated statements: figures are of the parent company alone and may differ much from the group's."),
    "unknown": ("error", "The basis of the statements could not be told: tables were chosen by their words alone. Trust no figure without its page."),
}


def spoken(name: Column) -> Column:
    """A name with blanks, its first letter a capital."""
    said = F.replace(name, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(said, 1, 1)), F.substring(said, F.lit(2), F.length(said)))


def label_of(name: Column) -> Column:
    """A metric's label, or any other name spoken."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in LABELS.items() for x in p]), name), spoken(name))


def is_computed(refs: Column) -> Column:
    """Whether a figure refers to other concepts instead of a row."""
    return F.coalesce(F.get(refs, F.lit(0)).isin(list(CONCEPTS)), F.lit(True))


def value_rows(figures: DataFrame, rows: DataFrame) -> DataFrame:
    """document_id, concept, period, value, page, source_row, how_found, ref_id, status of every figure that is there.

    rows: document_id, ref_id, label. A figure read from a cell has its row's page and label; a computed one what it was
    computed from, and no page. Low is what a model picked, or what is less than certain.
    """
    there = figures.where("value IS NOT NULL").withColumn("_computed", is_computed(F.col("refs")))
    there = there.withColumn("ref_id", F.when(~F.col("_computed"), F.get("refs", F.lit(0))))
    named = there.join(rows.select("document_id", "ref_id", F.col("label").alias("_label")).dropDuplicates(["document_id", "ref_id"]), ["document_id", "ref_id"], "left")
    source = F.when(F.col("_computed"), F.concat(F.lit("derived from "), F.array_join(F.transform("refs", lambda r: F.replace(r, F.lit("_"), F.lit(" "))), ", "))).otherwise(F.coalesce("_label", F.lit("")))
    low = F.coalesce(F.col("extraction") == "llm_mapped", F.lit(False)) | F.coalesce(F.col("rank") != HIGH, F.lit(True))
    return named.select(
        "document_id", spoken(F.col("concept")).alias("concept"), F.col("end_year").alias("period"), money_text(F.col("value"), F.coalesce("currency", F.lit("")), F.lit(1), F.lit("")).alias("value"),
        F.coalesce(F.nullif(F.regexp_extract(F.coalesce("ref_id", F.lit("")), r"^page_([0-9]+)_", 1), F.lit("")), F.lit("")).alias("page"), source.alias("source_row"),
        F.when(F.col("_computed"), "derived").otherwise(F.replace("extraction", F.lit("_"), F.lit(" "))).alias("how_found"), F.coalesce("ref_id", F.lit("")).alias("ref_id"), F.when(low, "low").otherwise("ok").alias("status"),
    )


def trend_rows(changes: DataFrame) -> DataFrame:
    """document_id, subject, from_year, to_year, change, direction, reads_as, status of the changes that are there."""
    return changes.where("na IS NULL").select(
        "document_id", label_of(F.col("subject")).alias("subject"), "from_year", "to_year", relative_text(F.col("relative")).alias("change"), "direction",
        F.col("economic").alias("reads_as"), F.when(F.col("relative").isNull(), "na").otherwise("ok").alias("status"),
    )


def reconciliation_rows(checks: DataFrame) -> DataFrame:
    return checks.select("document_id", spoken(F.col("name")).alias("check"), F.col("end_year").alias("period"), "status", "detail", F.array_join("refs", ", ").alias("refs"))


def red_flag_rows(flags: DataFrame) -> DataFrame:
    return flags.select("document_id", spoken(F.col("rule_id")).alias("rule"), F.col("outcome").alias("status"), "severity", "message", F.array_join("refs", ", ").alias("refs"))


def provenance(wanted: DataFrame, figures: DataFrame, cells: DataFrame, rows: DataFrame, notes: DataFrame) -> DataFrame:
    """wanted (document_id, ref_id) with what was read there: page, table_idx, row_idx, col, row_label, raw_text, scale,
    currency, value, dash_zero, concept, period, notes (rows that were passed over for this figure).

    Of several figures of a row the first by concept and newest period is told. Only figures read from cells have a place.
    """
    mine = figures.where(F.col("value").isNotNull() & ~is_computed(F.col("refs"))).select("document_id", F.get("refs", F.lit(0)).alias("ref_id"), "concept", "end_year", "value", "currency")
    first = mine.groupBy("document_id", "ref_id").agg(F.min_by(F.struct("concept", "end_year", "value", "currency"), F.struct("concept", -F.col("end_year"))).alias("f"))
    held = cells.select("document_id", "ref_id", "end_year", "col", F.col("token").alias("raw_text"), "scale", "dash_zero")
    out = wanted.join(first, ["document_id", "ref_id"]).select("document_id", "ref_id", "f.*").join(held, ["document_id", "ref_id", "end_year"], "left")
    labels = rows.select("document_id", "ref_id", "label").dropDuplicates(["document_id", "ref_id"])
    said = F.concat(F.lit("'"), "dropped_label", F.lit("' ("), F.replace("dropped_ref", F.lit("_"), F.lit(" ")), F.lit(") also matched "), F.replace("concept", F.lit("_"), F.lit(" ")), F.lit("; "), "reason")
    passed = notes.groupBy("document_id", F.col("kept_ref").alias("ref_id"), "concept").agg(F.array_sort(F.collect_list(said)).alias("notes"))
    out = out.join(labels, ["document_id", "ref_id"], "left").join(passed, ["document_id", "ref_id", "concept"], "left")
    place = lambda i: F.regexp_extract("ref_id", r"^page_([0-9]+)_table_([0-9]+)_row_([0-9]+)$", i).try_cast("int")
    return out.select(
        "document_id", "ref_id", place(1).alias("page"), place(2).alias("table_idx"), place(3).alias("row_idx"), "col", F.col("label").alias("row_label"), "raw_text", "scale", "currency",
        F.col("value").cast("string").alias("value"), "dash_zero", "concept", F.col("end_year").alias("period"), F.coalesce("notes", F.array().cast("array<string>")).alias("notes"),
    )


def history_metric_rows(metrics: DataFrame) -> DataFrame:
    """document_id, metric, period, value, status of stored metrics that are there, as live ones are shown."""
    return metrics.where("value IS NOT NULL").select(
        "document_id", label_of(F.col("name")).alias("metric"), F.col("end_year").alias("period"), metric_text(F.col("value"), F.col("unit")).alias("value"),
        F.when(F.col("rank") == HIGH, "ok").otherwise("low").alias("status"),
    )


def warning_counts(checks: DataFrame) -> DataFrame:
    return checks.groupBy("document_id").agg(F.count_if(F.col("status") == "warning").alias("warnings"))


def notices(basis: DataFrame, without_periods: DataFrame) -> DataFrame:
    """document_id, level, text: of each document's basis, and of those whose periods could not be told."""
    table = F.create_map(*[x for k, (level, said) in BASIS.items() for x in (F.lit(k), F.struct(F.lit(level).alias("level"), F.lit(said).alias("text")))])
    one = basis.select("document_id", F.element_at(table, F.col("basis")).alias("n")).select("document_id", "n.*")
    two = without_periods.select("document_id", F.lit("error").alias("level"), F.concat(F.lit("Periods: "), unavailable_text(F.col("na"))).alias("text"))
    return one.union(two)
