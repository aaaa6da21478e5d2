"""Annual reports of suppliers, made from order lines: pages, ruled tables and words, twelve kinds of them.

The order tables hold no reports. A supplier's sums by year become statements, printed as reports print them: scale and currency
at one level or another, tables over several pages, without ruling, without a header, with two currencies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statera.sources.scratch import settled

YEARS = [1998, 1997, 1996]
#: Statement to its title and lines: label, SQL over the sums of a year (a, c) and the supplier's number n, concept.
STATEMENTS = {
    "income": ("Statements of Operations", [("Net sales", "a", "revenue"), ("Cost of sales", "-c", "cogs"), ("Gross profit", "a - c", "gross_profit"), ("Net income", "a - 2 * c", "net_income")]),
    "balance": ("Balance Sheets", [("Total assets", "2 * a", "total_assets"), ("Total liabilities", "a + n", "total_liabilities"), ("Total stockholders'' equity", "a - n", "equity")]),
    "cash_flow": ("Statements of Cash Flows", [("Net cash provided by operating activities", "c", "operating_cash_flow"), ("Purchases of property and equipment", "-n", "capex"), ("Net cash left", "a", None)]),
}
#: Kinds of reports, n % 12.
PLAIN, ON_PAGE, ON_FIRST, NO_SCALE, TWO_CURRENCIES, CONTINUED, WORDS, BARE, TWICE, UNTITLED, COVERED, CRORES = range(12)
COVER = "Securities and Exchange Commission\nWashington, D.C. 20549\nForm 10-K"
EDGES = [300, 360, 420]
SUMS = """SELECT s_name AS document_id, s_suppkey AS n, y, coalesce(a, 0) AS a, coalesce(c, 0) AS c
    FROM (SELECT s_name, s_suppkey, y FROM supplier, (SELECT 1998 AS y UNION ALL SELECT 1997 UNION ALL SELECT 1996) years)
    LEFT JOIN (SELECT l_suppkey, year(l_shipdate) AS ly, CAST(floor(sum(CAST(l_extendedprice AS DECIMAL(18, 2)))) AS BIGINT) AS a, CAST(floor(sum(CAST(l_quantity AS DECIMAL(18, 2)))) AS BIGINT) AS c
        FROM lineitem GROUP BY l_suppkey, year(l_shipdate)) ON l_suppkey = s_suppkey AND ly = y"""


def sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, n, y, a, c: a row for each supplier and year."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("supplier", "lineitem")}
    return spark.sql(SUMS.replace("FROM supplier", "FROM {supplier}").replace("FROM lineitem", "FROM {lineitem}"), **tables)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, n, v (kind of report), kind, i, page, table_idx, cells (label and a token for each year)."""
    per = sums(spark, sf_dir).groupBy("document_id", "n").agg(F.map_from_entries(F.collect_list(F.struct("y", F.struct("a", "c")))).alias("m"))
    made = []
    for k, (kind, (_, rows)) in enumerate(STATEMENTS.items()):
        for i, (label, sql, _) in enumerate(rows):
            values = ", ".join(f"transform(array(m[{y}]), s -> {sql.replace('a', 's.a').replace('c', 's.c')})[0]" for y in YEARS)
            tokens = f"transform(array({values}), v -> CASE WHEN v < 0 THEN concat('(', format_number(-v, 0), ')') ELSE format_number(v, 0) END)"
            made.append(f"struct({k} AS k, '{kind}' AS kind, {i} AS i, concat(array('{label.replace(chr(39) * 2, chr(92) + chr(39))}'), {tokens}) AS cells)")
    out = per.withColumn("v", F.col("n") % 12).select("document_id", "n", "v", F.expr(f"inline(array({', '.join(made)}))"))
    split, later = (F.col("v") == CONTINUED) & (F.col("kind") == "income"), F.when(F.col("v") == CONTINUED, 2).otherwise(0)
    page = F.when(split, F.greatest(F.col("i") + 1, F.lit(2))).when(F.col("kind") == "income", 2).otherwise(F.col("k") + 2 + later)
    return out.withColumn("page", page.cast("int")).withColumn("table_idx", F.when(split & (F.col("page") == 3), 1).otherwise(0))


def frames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, raw, words) of all reports, as plans.analysis.analyse_reports takes them."""
    rows = settled(lines(spark, sf_dir), "report-lines")  # five branches read them
    years = F.when((F.col("v") == TWICE) & (F.col("kind") == "income"), F.array(F.lit("1998"), F.lit("FY 1997-98"), F.lit("1996"))).otherwise(F.array(*[F.lit(str(y)) for y in YEARS]))
    headed = ~((F.col("v") == BARE) & (F.col("kind") == "balance")) & ~((F.col("v") == CONTINUED) & (F.col("page") == 4) & (F.col("kind") == "income"))
    body = F.transform(F.array_sort(F.collect_list(F.struct("i", "cells"))), lambda r: r["cells"])
    tables = rows.groupBy("document_id", "v", "k", "kind", "page", "table_idx").agg(body.alias("body")).withColumn("head", F.when(headed, years))
    shift = F.col("k") * 20.0
    places = F.array(F.lit(10.0), *[F.lit(float(x)) + shift for x in EDGES])
    full = F.when(F.col("head").isNotNull(), F.concat(F.array(F.concat(F.array(F.lit("")), "head")), "body")).otherwise(F.col("body"))
    unruled = (F.col("v") == WORDS) & (F.col("kind") == "income")
    raw = tables.where(~unruled).select("document_id", "page", "table_idx", full.alias("rows"), places.alias("col_x"))
    beside = tables.where((F.col("v") == CONTINUED) & (F.col("page") == 3)).select("document_id", "page", F.lit(0).alias("table_idx"), F.expr("array(array('Region', 'x'), array('North', '1'))").alias("rows"), F.expr("array(10.0D, 90.0D)").alias("col_x"))

    scope = F.when(F.col("v") == COVERED, "").otherwise("Consolidated ")
    first = ~((F.col("v") == CONTINUED) & (F.col("kind") == "income") & (F.col("page") > 2))
    title = F.when((F.col("v") != UNTITLED) & first, F.concat(scope, F.element_at(F.create_map(*[F.lit(x) for k, (t, _) in STATEMENTS.items() for x in (k, t)]), F.col("kind"))))
    caption = F.when(F.col("v") == CRORES, "(in crores)").when(~F.col("v").isin(ON_PAGE, ON_FIRST, NO_SCALE), "(In millions of dollars)")
    below = F.when(F.col("v") == ON_PAGE, "All amounts are in thousands of dollars.").when((F.col("v") == TWO_CURRENCIES) & (F.col("kind") == "income"), "Some sales were made in ₹.")
    printed = F.array_join(F.transform("body", lambda r: F.array_join(r, " ")), "\n")
    pages = tables.select("document_id", "page", F.concat_ws("\n", title, caption, F.array_join("head", " "), printed, below).alias("text"))
    said = F.when(F.col("v") == ON_FIRST, "Annual report, in billions of dollars").when(F.col("v") == NO_SCALE, "Annual report in dollars").when(F.col("v") == COVERED, COVER).otherwise("Annual report")
    covers = rows.select("document_id", "v").distinct().select("document_id", F.lit(1).alias("page"), said.alias("text"))

    set_ = tables.where(unruled)
    word = lambda text, x0, x1, top: F.struct(text.alias("text"), x0.cast("double").alias("x0"), x1.cast("double").alias("x1"), top.cast("double").alias("top"))
    edge = F.array(*map(F.lit, EDGES))
    heads = F.transform("head", lambda y, j: word(y, F.get(edge, j) - 20, F.get(edge, j), F.lit(100)))
    labels = lambda r, i: F.transform(F.split(r[0], " "), lambda w, j: word(w, 10 + 40 * j, 40 + 40 * j, 120 + 12 * i))
    values = lambda r, i: F.transform(F.slice(r, 2, 3), lambda x, j: word(x, F.get(edge, j) - 40, F.get(edge, j), 120 + 12 * i))
    each = F.concat(heads, F.flatten(F.transform("body", lambda r, i: F.concat(labels(r, i), values(r, i)))))
    words = set_.select("document_id", "page", F.explode(each).alias("w")).select("document_id", "page", "w.*")
    return pages.unionByName(covers), raw.unionByName(beside), words
