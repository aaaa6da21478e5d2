"""Fiscal-year labels beside dates (U4): a report may head one statement "Fiscal 2025" and another "February 1, 2026".

Columns are relabelled only by a sentence that binds one fiscal year to one date that heads a column; no date is computed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statera.functions.maybe import reason, text
from statera.functions.tokens import strip

#: Names of months, and how fiscal years and end dates are written.
MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
CENTURY = r"(?:19|20|21)[0-9]{2}"
MONTH_DAY = rf"(?i)\b({MONTHS})\s+([0-9]{{1,2}}),"
DATE = rf"({MONTHS})\s+([0-9]{{1,2}}),\s*({CENTURY})"
FISCAL, FISCAL_YEAR = r"(?i)\bfiscal\b", rf"(?i)\bfiscal\s+({CENTURY})\b"
YEAR_FIRST = rf"(?i)\bfiscal\s+({CENTURY})\b.*?\bended\s+{DATE}"
DATE_FIRST = rf"(?i)\bended\s+{DATE}.*?\bfiscal\s+({CENTURY})\b"
YEARS = rf"(?<![0-9])({CENTURY})(?![0-9])"


def bindings(pages: DataFrame) -> DataFrame:
    """document_id, fiscal_year, month, day, year, sentence, page: sentences that hold one fiscal year and one end date."""
    lines = pages.select("document_id", "page", F.explode(F.split("text", r"\r\n|\r|\n")).alias("line"))
    each = lines.select("document_id", "page", F.explode(F.split("line", r"(?<=[.;])\s+")).alias("sentence"))
    one = each.where((F.regexp_count("sentence", F.lit(FISCAL_YEAR)) == 1) & (F.regexp_count("sentence", F.lit(f"(?i){DATE}")) == 1))
    first, second = F.col("sentence").rlike(YEAR_FIRST), F.col("sentence").rlike(DATE_FIRST)
    part = lambda i, j: F.when(first, F.regexp_extract("sentence", YEAR_FIRST, i)).otherwise(F.regexp_extract("sentence", DATE_FIRST, j))
    return one.where(first | second).select(
        "document_id", part(1, 4).cast("int").alias("fiscal_year"), F.lower(part(2, 1)).alias("month"), part(3, 2).cast("int").alias("day"),
        part(4, 3).cast("int").alias("year"), strip(F.col("sentence")).alias("sentence"), "page",
    )


def header_blocks(headers: DataFrame, pages: DataFrame) -> DataFrame:
    """document_id, kind, years, block: the line of a statement's page that prints its header's years, and the line above.

    headers: document_id, kind, page, col, label. Statements whose years stand on no line are left out.
    """
    cells = F.transform(F.array_sort(F.collect_list(F.struct("col", strip(F.col("label")).alias("label")))), lambda c: c["label"])
    heads = headers.groupBy("document_id", "kind", "page").agg(cells.alias("years"))
    lines = pages.select("document_id", "page", F.split("text", r"\r\n|\r|\n").alias("lines"))
    rows = heads.join(lines, ["document_id", "page"])
    at = F.array_position(F.transform("lines", lambda x: F.regexp_extract_all(x, F.lit(YEARS), 1) == F.col("years")), True).cast("int")
    block = F.array_join(F.slice("lines", F.greatest(F.col("_at") - 1, F.lit(1)), F.least(F.col("_at"), F.lit(2))), "\n")
    return rows.withColumn("_at", at).where("_at > 0").select("document_id", "kind", "years", block.alias("block"))


def reconciled(columns: DataFrame, headers: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(columns with end_year and label by fiscal year where the document binds them, document_id and na of those it does not).

    columns: document_id, kind, col, end_year, label, as mapping.detect_periods gives them. Documents whose statements are
    all headed alike are untouched. A date bound to two years or the reverse, a date that no sentence binds, and two
    columns of a statement bound to one year each leave the whole document without periods.
    """
    blocks = header_blocks(headers, pages)
    days = F.arrays_zip(F.regexp_extract_all("block", F.lit(MONTH_DAY), 1).alias("month"), F.regexp_extract_all("block", F.lit(MONTH_DAY), 2).alias("day"))
    blocks = blocks.withColumn("_days", days)
    dated = F.size("_days") == F.size("years")
    fiscal = ~dated & (F.regexp_count("block", F.lit(FISCAL)) >= F.size("years"))
    kinds = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("kind")))), ", ")
    mixed = blocks.groupBy("document_id").agg(kinds(fiscal).alias("_f"), kinds(dated).alias("_d")).where("_f <> '' AND _d <> ''")
    mixed = mixed.select("document_id", text(F.col("_f"), " headed by fiscal year, ", F.col("_d"), " by end date").alias("_mixed"))

    found = bindings(pages).join(mixed, "document_id")
    per_year, per_date = Window.partitionBy("document_id", "fiscal_year"), Window.partitionBy("document_id", "month", "day", "year")
    date = F.struct("month", "day", "year")
    two = (F.size(F.collect_set(date).over(per_year)) > 1) | (F.size(F.collect_set("fiscal_year").over(per_date)) > 1)
    quoted = text("p", F.col("page"), ": '", F.col("sentence"), "'")
    clash = found.withColumn("_two", two).where("_two").groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", quoted.alias("q")))), lambda x: x["q"]), "; ").alias("_q"))
    clashes = clash.join(mixed, "document_id").select("document_id", reason("ambiguous", text(F.col("_mixed"), "; conflicting fiscal-year bindings: ", F.col("_q"))).alias("na"), F.lit(0).alias("_order"))

    places = blocks.where(dated).join(mixed, "document_id").select("document_id", "kind", "_mixed", "years", F.posexplode("_days").alias("_p", "_day"))
    places = places.select("document_id", "kind", "_mixed", (F.col("_p") + 1).alias("col"), F.lower("_day.month").alias("month"), F.col("_day.day").cast("int").alias("day"), F.get("years", F.col("_p")).try_cast("int").alias("year"))
    first = found.groupBy("document_id", "month", "day", "year").agg(F.min_by(F.struct("fiscal_year", "sentence", "page"), F.struct("page", "sentence")).alias("b"))
    bound = places.join(first, ["document_id", "month", "day", "year"], "left")
    said = text(F.initcap("month"), " ", F.col("day"), ", ", F.col("year"))
    unbound = bound.where("b IS NULL").groupBy("document_id").agg(F.min_by(reason("ambiguous", text(F.col("_mixed"), "; no sentence binds ", said, " to a fiscal year")), F.struct("kind", "col")).alias("na"), F.lit(1).alias("_order"))
    twice = bound.where("b IS NOT NULL").groupBy("document_id", "kind", "_mixed", "b.fiscal_year").agg(F.count("*").alias("n")).where("n > 1")
    twice = twice.groupBy("document_id").agg(F.min(F.struct("kind", reason("ambiguous", text(F.col("_mixed"), "; two ", F.col("kind"), " columns bind one year")).alias("na"))).alias("m")).select("document_id", "m.na", F.lit(2).alias("_order"))
    bad = clashes.union(unbound).union(twice).groupBy("document_id").agg(F.min_by("na", "_order").alias("na"))

    label = text("fiscal ", F.col("b.fiscal_year"), " (p", F.col("b.page"), ": '", F.col("b.sentence"), "')")
    new = bound.where("b IS NOT NULL").select("document_id", "kind", "col", F.col("b.fiscal_year").alias("_year"), label.alias("_label"))
    out = columns.join(bad.select("document_id"), "document_id", "left_anti").join(new, ["document_id", "kind", "col"], "left")
    return out.select("document_id", "kind", "col", F.coalesce("_year", "end_year").alias("end_year"), F.coalesce("_label", "label").alias("label")), bad
