"""Statement facts of synthetic issuers: nations as issuers, order years as periods, sums over order lines as figures.

The order tables hold no statements. These sums stand in for them so that every path runs: balance figures are absent in
the first year, some issuers lack an input, have a zero divisor, negative equity or a second currency.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statera.functions.vocabulary import CONCEPTS
from statera.operators import changes, checks, figures

#: Concept to SQL over the sums of one issuer and year (n: issuer's number, y: year); both engines read it alike.
FACTS = {
    "revenue": "CASE WHEN n = 7 AND y = 1998 THEN 0 ELSE net END",
    "cogs": "-returned",
    "gross_profit": "net - returned + CASE WHEN n % 4 = 1 THEN tax ELSE 0 END",
    "operating_income": "net - returned - 5 * discount",
    "d_and_a": "tax",
    "net_income": "net - returned - 5 * discount - CASE WHEN n % 3 = 0 THEN 0 ELSE opened END",
    "total_assets": "CASE WHEN y > 1995 THEN 2 * net END",
    "current_assets": "CASE WHEN y > 1995 THEN returned + tax END",
    "cash": "CASE WHEN y > 1995 THEN tax END",
    "total_liabilities": "CASE WHEN y > 1995 THEN net + CASE WHEN n % 6 = 0 THEN 3 * net ELSE 0 END END",
    "current_liabilities": "CASE WHEN y > 1995 THEN CASE WHEN n = 3 THEN 0 ELSE returned END END",
    "short_term_borrowings": "CASE WHEN y > 1995 THEN discount END",
    "long_term_borrowings": "CASE WHEN y > 1995 AND n % 8 <> 0 THEN 3 * discount END",
    "equity": "CASE WHEN y > 1995 THEN CASE WHEN n % 6 = 0 THEN -2 * net WHEN n % 5 = 2 THEN net + discount ELSE net END END",
    "operating_cash_flow": "net - returned - 5 * discount - CASE WHEN n % 3 = 0 THEN 0 ELSE opened END + tax",
    "capex": "CASE WHEN n % 7 <> 5 THEN -discount END",
}
#: The second currency of one issuer's borrowings.
CURRENCY = "CASE WHEN concept = 'long_term_borrowings' AND n = 11 THEN 'INR' ELSE 'USD' END"


def issuer_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, n, y and the sums: one shuffle of order lines to orders, then partial sums by issuer and year."""
    read = lambda name, *columns: spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)
    lines = read("lineitem", "l_orderkey", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    orders = read("orders", "o_orderkey", "o_custkey", "o_orderdate")
    customers = read("customer", "c_custkey", "c_nationkey")
    price, less, tax = F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_discount").cast("decimal(4,2)"), F.col("l_tax").cast("decimal(4,2)")
    whole = price * F.lit(1).cast("decimal(4,2)")
    placed = lines.select(
        "l_orderkey", (price * (F.lit(1).cast("decimal(4,2)") - less)).alias("net"), F.when(F.col("l_returnflag") == "R", whole).alias("returned"),
        F.when(F.col("l_linestatus") == "O", whole).alias("opened"), (price * less).alias("discount"), (price * tax).alias("tax"),
    )
    per_order = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey", F.year("o_orderdate").alias("y"))
    sums = placed.join(per_order, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("c_nationkey", "y")
    names = ["net", "returned", "opened", "discount", "tax"]
    rows = sums.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("decimal(30,4)").alias(c) for c in names])
    nations = read("nation", "n_nationkey", "n_name")
    return rows.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("document_id"), F.col("n_nationkey").alias("n"), "y", *names)


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts as mapped values, one row for each that is there."""
    cells = ", ".join(f"struct('{c}' AS concept, cast({sql} AS decimal(38,4)) AS value)" for c, sql in FACTS.items())
    rows = issuer_sums(spark, sf_dir).select("document_id", "n", F.col("y").alias("end_year"), F.expr(f"inline(array({cells}))")).where("value IS NOT NULL")
    return rows.select(
        "document_id", "concept", "end_year", "value", F.expr(CURRENCY).alias("currency"), F.lit(2).alias("rank"), F.lit("exact_match").alias("extraction"),
        F.array(F.concat_ws("@", "concept", "end_year")).alias("refs"), F.lit(None).cast(figures.NA).alias("na"),
    )


def analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each issuer and year: figures and ratios."""
    mapped = values(spark, sf_dir)
    return figures.analysed(mapped, mapped.select("document_id", "end_year"))


def changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``analysed`` with changes: for those who need no checks."""
    return changes.with_changes(analysed(spark, sf_dir))


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``analysed`` with checks: for those who need no changes."""
    return checks.with_checks(analysed(spark, sf_dir))


def analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each issuer and year: figures, ratios, changes and checks."""
    return checks.with_checks(changed(spark, sf_dir))


assert set(FACTS) | {"ebitda", "total_debt", "free_cash_flow"} == set(CONCEPTS)
