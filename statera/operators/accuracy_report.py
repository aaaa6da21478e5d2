"""Evaluation of many companies as one job (E2, E5, E10, E12, E13, T11): which filing, which scopes, what to print."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statera.operators.evaluation import annual_facts, filing_as_of, scored, split, summary

#: A year at the end of a file's name: two or four digits, as "fy" or by itself.
FILE_YEAR = r"(?:fy|[^0-9]|^)((?:19|20|21)?[0-9]{2})$"


def filtered(companies: DataFrame, which: str = "all", bucket: str = "all", only: list[str] | None = None) -> DataFrame:
    """companies (ticker, bucket) with split, those of one split and bucket, or the tickers named whatever their split."""
    rows = companies.withColumn("split", split(F.col("ticker")))
    if only:
        return rows.where(F.col("ticker").isin(only))
    rows = rows if which == "all" else rows.where(F.col("split") == which)
    return rows if bucket == "all" else rows.where(F.col("bucket") == bucket)


def file_year(name: Column) -> Column:
    """The year that ends a file's name: apple_10k_2023.pdf, microsoft_fy24.pdf; null if there is none."""
    stem = F.lower(F.regexp_replace(F.regexp_extract(name, r"([^/\\]*)$", 1), r"\.[^.]*$", ""))
    year = F.regexp_extract(stem, FILE_YEAR, 1).try_cast("int")
    return F.when(year < 100, year + 2000).otherwise(year)


def selected_filings(companies: DataFrame, filings: DataFrame, cutoff: str) -> DataFrame:
    """ticker, accession, error: the one filing whose report year is that of a company's local file, if it has one, else the
    newest filed by the cut-off. A company without such a filing, or with several, has an error and never stops the rest.

    companies: ticker, local_pdf; filings: ticker, accession, filed, report_date.
    """
    rows = companies.select("ticker", F.nullif(F.col("local_pdf"), F.lit("")).alias("local_pdf")).withColumn("_year", file_year(F.col("local_pdf")))
    named = rows.where("local_pdf IS NOT NULL").join(filings.select("ticker", "accession", F.year("report_date").alias("_of")), "ticker", "left")
    hits = F.col("_of") == F.col("_year")
    named = named.groupBy("ticker", "local_pdf", "_year").agg(F.count_if(hits).alias("_n"), F.min(F.when(hits, F.col("accession"))).alias("_a"))
    why = F.when(F.col("_year").isNull(), F.concat(F.lit("no fiscal year at the end of "), "local_pdf")).when(F.col("_n") != 1, F.concat(F.col("_n").cast("string"), F.lit(" filings have the report year of "), "local_pdf"))
    local = named.select("ticker", F.when(why.isNull(), F.col("_a")).alias("accession"), why.alias("error"))
    latest = rows.where("local_pdf IS NULL").select("ticker").join(filing_as_of(filings, cutoff).select("ticker", "accession"), "ticker", "left")
    return local.union(latest.select("ticker", "accession", F.when(F.col("accession").isNull(), F.lit(f"no filing by {cutoff}"))))


def fiscal_year_check(facts: DataFrame) -> DataFrame:
    """accession, fys (distinct fy of all facts, sorted), latest_end (of annual ones): diagnostics, never a true year."""
    fys = facts.groupBy("accession").agg(F.array_sort(F.collect_set("fy")).alias("fys"))
    ends = annual_facts(facts).groupBy("accession").agg(F.max("end").alias("latest_end"))
    return fys.join(ends, "accession", "left")


def is_mismatch(fys: Column, latest_end: Column, offset: Column) -> Column:
    """Whether fy less the latest end's year is not the offset in use: a reader should look at that filing's headers."""
    other = (F.size(fys) != 1) | F.coalesce(F.get(fys, F.lit(0)) - F.year(latest_end) != offset, F.lit(True))
    return latest_end.isNotNull() & other


def evaluated(companies: DataFrame, values: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(companies with status and error, outcomes with bucket) of all companies in one job.

    companies: document_id, ticker, bucket, error (null where its analysis went well). One with an error has no outcomes.
    """
    status = companies.withColumn("status", F.when(F.col("error").isNull(), "ok").otherwise("error"))
    good = status.where("status = 'ok'").select("document_id", "ticker", "bucket")
    ids = good.select("document_id")
    found = scored(values.join(ids, "document_id", "left_semi"), known.join(ids, "document_id", "left_semi"))
    return status, found.join(good, "document_id")


def scopes(outcomes: DataFrame, exposed: DataFrame) -> DataFrame:
    """part, then the columns of evaluation.summary: all, each bucket, and exposed by itself.

    outcomes: document_id, concept, outcome, sub, ticker, bucket. Held-out companies whose results were looked at (exposed:
    ticker) are in no other part, so that what is held out stays unseen.
    """
    held = exposed.select("ticker").distinct().where(split(F.col("ticker")) == "holdout").withColumn("_seen", F.lit(True))
    rows = outcomes.join(held, "ticker", "left")
    part = F.when(F.col("_seen"), F.array(F.lit("exposed"))).otherwise(F.array(F.lit("all"), F.col("bucket")))
    return summary(rows.withColumn("part", F.explode(part)), "part")


def markdown_rows(frame: DataFrame, columns: list[str], *order: Column) -> DataFrame:
    """position, line: a Markdown table of the rows; bars inside a cell are escaped. Heads come first."""
    escaped = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit(r"\|")) for c in columns]
    line = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    spark = frame.sparkSession
    head = spark.createDataFrame([(-2, "| " + " | ".join(columns) + " |"), (-1, "| " + " | ".join(["---"] * len(columns)) + " |")], "position int, line string")
    from pyspark.sql.window import Window

    body = frame.select((F.row_number().over(Window.orderBy(*order)) - 1).alias("position"), line(escaped).alias("line"))
    return head.unionByName(body)


def report(companies: DataFrame, outcomes: DataFrame, exposed: DataFrame) -> DataFrame:
    """section, position, line: the report's tables: totals by part, concepts by wrong values, wrong values, errors."""
    found = scopes(outcomes, exposed)
    totals = markdown_rows(found.where("scope = 'all'"), ["part", "correct", "wrong", "withheld", "unverified", "precision", "coverage", "wrong_rate"], F.col("part"))
    concepts = markdown_rows(found.where("part = 'all' AND scope LIKE 'concept:%'"), ["scope", "correct", "wrong", "precision"], F.desc("wrong"), F.col("scope"))
    wrong = markdown_rows(outcomes.where("outcome = 'wrong'"), ["ticker", "concept", "end_year", "sub"], F.col("ticker"), F.col("concept"), F.col("end_year"))
    errors = markdown_rows(companies.where("status = 'error'"), ["ticker", "error"], F.col("ticker"))
    parts = [p.select(F.lit(name).alias("section"), "position", "line") for name, p in (("totals", totals), ("concepts", concepts), ("wrong", wrong), ("errors", errors))]
    return reduce(lambda a, b: a.union(b), parts)
