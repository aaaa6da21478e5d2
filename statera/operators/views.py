"""Display-ready results (V1-V15, T12): rounding happens here and only here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statera.functions.maybe import known
from statera.functions.tokens import multiplier
from statera.functions.vocabulary import CHANGES, RANKS
from statera.operators.changes import CHANGE

#: Cards and their labels, currency signs, charted series.
CARDS = {
    "net_margin": "Net margin", "operating_margin": "Operating margin", "current_ratio": "Current ratio",
    "debt_to_equity": "Debt to equity", "roe": "Return on equity", "ocf_to_net_income": "Cash backing of profit",
}
LABELS = CARDS | {"gross_margin": "Gross margin", "ebitda_margin": "EBITDA margin", "roa": "Return on assets"}
SIGNS = {"INR": "₹", "USD": "$"}
PERFORMANCE, MARGINS, BALANCE_PARTS = ["revenue", "gross_profit", "operating_income", "net_income"], ["gross_margin", "operating_margin", "net_margin"], ["total_assets", "total_liabilities", "equity"]


def fixed(x: Column, digits: int) -> Column:
    """Half-even, with that many decimals; a negative amount that rounds to zero keeps its sign."""
    shown = F.bround(x.cast("decimal(38,10)"), digits).cast(f"decimal(38,{digits})")
    return F.when((x < 0) & (shown == 0), F.concat(F.lit("-"), shown.cast("string"))).otherwise(shown.cast("string"))


def money_text(value: Column, currency: Column, scale_multiplier: Column, word: Column) -> Column:
    shown = F.format_number(F.bround(F.try_divide(value, scale_multiplier).cast("decimal(38,6)"), 2), 2)
    sign = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in SIGNS.items() for x in p]), currency), F.concat(currency, F.lit(" ")))
    return F.trim(F.concat(sign, shown, F.lit(" "), word))


def metric_text(value: Column, unit: Column) -> Column:
    return F.when(unit == "percent", F.concat(fixed(value * 100, 1), F.lit("%"))).when(unit == "ratio", F.concat(fixed(value, 2), F.lit("x"))).otherwise(F.format_number(F.bround(value, 2), 2))


def relative_text(value: Column) -> Column:
    shown = fixed(value * 100, 1)
    return F.when(value.isNull(), "n/a").otherwise(F.concat(F.when(F.bround(value * 100, 1) > 0, "+").otherwise(""), shown, F.lit("%")))


def unavailable_text(na: Column) -> Column:
    return F.concat(F.lit("N/A - "), F.replace(na["root_reason"], F.lit("_"), F.lit(" ")), F.lit(": "), na["root_detail"])


def latest(rows: DataFrame) -> DataFrame:
    newest = Window.partitionBy("document_id").orderBy(F.desc("end_year"))
    return rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def kpi_cards(rows: DataFrame) -> DataFrame:
    """document_id, position, name, label, period, value, delta, reads, status of the newest period; rows as in rules.flags."""
    cells = []
    for i, (name, label) in enumerate(CARDS.items()):
        m = F.col(name)
        c = F.col(f"change_{name}") if name in CHANGES else F.lit(None).cast(CHANGE)
        live = known(m) & c.isNotNull() & c["na"].isNull()
        status = F.when(~known(m), "na").when(m["rank"] == RANKS.index("high"), "ok").otherwise("low")
        cells.append(F.struct(
            F.lit(i).alias("position"), F.lit(name).alias("name"), F.lit(label).alias("label"), F.when(known(m), metric_text(m["value"], m["unit"])).otherwise("N/A").alias("value"),
            F.when(live, relative_text(c["relative"])).otherwise("").alias("delta"), F.when(live, c["economic"]).otherwise("neutral").alias("reads"), status.alias("status"),
        ))
    return latest(rows).select("document_id", F.col("end_year").alias("period"), F.explode(F.array(*cells)).alias("k")).select("document_id", "period", "k.*")


def metric_rows(metrics: DataFrame) -> DataFrame:
    """document_id, metric (label), period, value, inputs, status of available and unavailable metrics alike."""
    label = F.element_at(F.create_map(*[F.lit(x) for p in LABELS.items() for x in p]), F.col("name"))
    there = F.col("value").isNotNull()
    status = F.when(~there, "na").when(F.col("rank") == RANKS.index("high"), "ok").otherwise("low")
    return metrics.select(
        "document_id", label.alias("metric"), F.col("end_year").alias("period"), F.when(there, metric_text(F.col("value"), F.col("unit"))).otherwise(unavailable_text(F.col("na"))).alias("value"),
        F.when(there, F.array_join("refs", ", ")).otherwise("").alias("inputs"), status.alias("status"),
    )


def report_scale(cells: DataFrame, *key: str) -> DataFrame:
    """The most frequent scale of a report's cells; of equals the one seen first (cells have a place)."""
    counts = cells.groupBy(*key, "scale").agg(F.count("*").alias("_n"), F.min("place").alias("_first"))
    most = F.struct(-F.col("_n"), "_first")
    return counts.groupBy(*key).agg(F.min_by("scale", most).alias("scale"))


def units(cells: DataFrame) -> DataFrame:
    """document_id, scale, currency, label ("USD million") of reports, from the cells of their figures: document_id, scale,
    currency, place. The currency is that of the first; cells in single units have no word for it."""
    first = cells.groupBy("document_id").agg(F.min_by("currency", "place").alias("currency"))
    word = F.when(F.col("scale") == "unit", "").otherwise(F.coalesce("scale", F.lit("")))
    return report_scale(cells, "document_id").join(first, "document_id").withColumn("label", F.trim(F.concat(F.coalesce("currency", F.lit("")), F.lit(" "), word)))


def amounts(figures: DataFrame, units: DataFrame) -> DataFrame:
    """document_id, concept, end_year, amount (in the report's own scale, two decimals, half-even), label, text of the figures
    that are there: what charts and cards print."""
    held = figures.where("value IS NOT NULL").join(units.select("document_id", "scale", "label"), "document_id")
    each = multiplier(F.coalesce("scale", F.lit("unit")))
    amount = F.bround(F.try_divide(F.col("value"), each).cast("decimal(38,6)"), 2)
    word = F.when(F.col("scale") == "unit", "").otherwise(F.col("scale"))
    return held.select("document_id", "concept", "end_year", amount.alias("amount"), "label", money_text(F.col("value"), F.col("currency"), each, word).alias("text"))


def series(rows: DataFrame, names: list[str], kind: str) -> DataFrame:
    """document_id, period, series, value of the figures or ratios that are there, for a chart; two decimals, as double."""
    shown = (lambda x: F.bround(x["value"] * 100, 2)) if kind == "ratio" else (lambda x: F.bround(x["value"], 2))
    cells = F.array(*[F.struct(F.lit(n).alias("series"), F.when(known(F.col(n)), shown(F.col(n))).cast("double").alias("value")) for n in names])
    return rows.select("document_id", F.col("end_year").alias("period"), F.explode(cells).alias("c")).select("document_id", "period", "c.*").where("value IS NOT NULL")


def balance_series(rows: DataFrame) -> DataFrame:
    """series of the balance parts, for periods that have all of them."""
    whole = known(F.col("total_assets")) & known(F.col("total_liabilities")) & known(F.col("equity"))
    return series(rows.where(whole), BALANCE_PARTS, "figure")


def cash_waterfall(rows: DataFrame) -> DataFrame:
    """document_id, period, step, from_amount, to_amount, amount of the newest period: operating cash flow, capex, free cash flow."""
    ocf, capex, fcf = F.col("operating_cash_flow"), F.col("capex"), F.col("free_cash_flow")
    spent = -F.abs(capex["value"])
    step = lambda n, a, b, x: F.struct(F.lit(n).alias("step"), a.cast("double").alias("from_amount"), b.cast("double").alias("to_amount"), x.cast("double").alias("amount"))
    zero = F.lit(0)
    cells = F.array(step("operating_cash_flow", zero, ocf["value"], ocf["value"]), step("capex", ocf["value"], ocf["value"] + spent, spent), step("free_cash_flow", zero, fcf["value"], fcf["value"]))
    whole = known(ocf) & known(capex) & known(fcf)
    return latest(rows).where(whole).select("document_id", F.col("end_year").alias("period"), F.explode(cells).alias("c")).select("document_id", "period", "c.*")
