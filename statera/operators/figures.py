"""Derived figures and ratios of every period (C1-C11): one row per document and year, all formulas as expressions on it.

The only shuffles are the one that brings a year's concepts together and the window over a document's years.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statera.functions.maybe import (
    FIGURE, RATIO, absent, all_known, divide, figure, first_reason, joined_refs, known, missing, none, no_refs, ratio, reason, text, NA,
)
from statera.functions.vocabulary import CONCEPTS, METRICS

#: Names of what one row holds besides its keys: the figures, the ratios, and the years around it.
DERIVED = {"total_debt": ("short_term_borrowings", "long_term_borrowings"), "free_cash_flow": ("operating_cash_flow", "capex"), "ebitda": ("operating_income", "d_and_a")}


def by_year(values: DataFrame, periods: DataFrame) -> DataFrame:
    """document_id, end_year and a figure column for every concept, for every period of a document; _any: a value is there.

    values: document_id, concept, end_year, value, currency, extraction, rank, refs, na, at most one row for a concept and year.
    """
    cell = F.struct("value", "currency", "rank", "extraction", "refs", "na").cast(FIGURE)
    found = values.groupBy("document_id", "end_year").agg(*[F.max(F.when(F.col("concept") == c, cell)).alias(c) for c in CONCEPTS])
    some = F.coalesce(*[F.col(c)["value"] for c in CONCEPTS]).isNotNull()
    rows = periods.select("document_id", "end_year").distinct().join(found.withColumn("_any", some), ["document_id", "end_year"], "left")
    default = lambda c: absent(reason("missing_input", text(f"{c} not mapped for ", F.col("end_year"))))
    return rows.withColumns({c: F.coalesce(F.col(c), default(c)) for c in CONCEPTS})


def derive(name: str, inputs: tuple[str, ...], combine: Callable[..., Column]) -> Column:
    """A mapped figure wins; else all inputs are needed, in one currency, and their exact combination must fit."""
    direct, parts, year = F.col(name), [F.col(c) for c in inputs], F.col("end_year")
    value = combine(*[p["value"] for p in parts])
    refs = joined_refs(*parts)
    currencies = F.array_distinct(F.array(*[p["currency"] for p in parts]))
    made = figure(value, parts[0]["currency"], F.least(*[p["rank"] for p in parts]), F.lit("exact_match"), F.array(*map(F.lit, inputs)))
    return (
        F.when(known(direct), direct)
        .when(~all_known(*parts), absent(missing(name, year, *parts)))
        .when(F.size(currencies) != 1, absent(reason("conflict", text(f"{name} ", year, ": inputs in different currencies"), refs)))
        .when(value.isNull(), absent(reason("unparseable", text(f"{name} ", year, ": inputs exceed exact precision"), refs)))
        .otherwise(made)
    )


def quotient(name: str, a: Column, b: Column, b_name: Column | str, guard: Column | None = None) -> Column:
    """a / b as a ratio. A reason "ambiguous" passes through unchanged; a zero divisor is a reason of its own."""
    year, unit = F.col("end_year"), METRICS[name]
    passed = F.coalesce(*[F.when(x["na"]["reason"] == "ambiguous", x["na"]) for x in (a, b)])
    zero = reason("division_by_zero", text(f"{name} ", year, ": ", b_name, " is zero"), b["refs"])
    out = (
        F.when(passed.isNotNull(), absent(passed, RATIO))
        .when(~all_known(a, b), absent(missing(name, year, a, b), RATIO))
        .when(b["value"] == 0, absent(zero, RATIO))
        .otherwise(ratio(divide(a["value"], b["value"]), unit, F.least(a["rank"], b["rank"]), joined_refs(a, b)))
    )
    return out if guard is None else F.when(guard.isNotNull(), absent(guard, RATIO)).otherwise(out)


def _not_meaningful(name: str, x: Column, when: Column, said: str, what: str = "ratio") -> Column:
    return F.when(known(x) & when, reason("ambiguous", text(f"{name} ", F.col("end_year"), f": {said}; {what} not meaningful"), x["refs"]))


def _average(name: str, concept: str) -> Column:
    """The mean of this and the prior period's figure of the document; one period never stands in for two."""
    now, before, year = F.col(concept), F.col(f"_prior_{concept}"), F.col("end_year")
    needed = text(f"{name} ", year, f": prior-period {concept} required for average")
    mean = F.try_add(now["value"], before["value"]) / 2
    return (
        F.when(~known(now), now)
        .when(before.isNull(), absent(reason("missing_input", needed, now["refs"])))
        .when(~known(before), absent(reason("missing_input", needed, now["refs"], before["na"])))
        .when(now["currency"] != before["currency"], absent(reason("conflict", f"{name}: currency differs across periods")))
        .when(mean < 0, absent(reason("ambiguous", text(f"{name} ", year, f": average {concept} is negative; ratio not meaningful"), joined_refs(now, before))))
        .otherwise(figure(mean, now["currency"], F.least(now["rank"], before["rank"]), F.lit("exact_match"), F.array(text(f"{concept}_", year), text(f"{concept}_", F.col("_prior_year")))))
    )


def analysed(values: DataFrame, periods: DataFrame) -> DataFrame:
    """by_year with derived figures, a ratio column for every metric, and what the mapping itself gave (mapped_<concept>)."""
    rows = by_year(values, periods)
    rows = rows.withColumns({f"mapped_{c}": F.col(c) for c in ("revenue", "net_income")})
    rows = rows.withColumns({
        "total_debt": derive("total_debt", DERIVED["total_debt"], lambda a, b: F.try_add(a, b)),
        "free_cash_flow": derive("free_cash_flow", DERIVED["free_cash_flow"], lambda a, b: F.try_subtract(a, F.abs(b))),
        "ebitda": derive("ebitda", DERIVED["ebitda"], lambda a, b: F.try_add(a, b)),
    })
    years = Window.partitionBy("document_id").orderBy("end_year")
    rows = rows.withColumns({"_prior_year": F.lag("end_year").over(years), **{f"_prior_{c}": F.lag(c).over(years) for c in ("total_assets", "equity")}})
    revenue, net, equity = F.col("revenue"), F.col("net_income"), F.col("equity")

    def margin(name: str, part: str) -> Column:
        return quotient(name, F.col(part), revenue, "revenue", _not_meaningful(name, revenue, revenue["value"] < 0, "revenue is negative", "margin"))

    out = rows.withColumns({
        "gross_margin": margin("gross_margin", "gross_profit"),
        "operating_margin": margin("operating_margin", "operating_income"),
        "net_margin": margin("net_margin", "net_income"),
        "ebitda_margin": margin("ebitda_margin", "ebitda"),
        "current_ratio": quotient("current_ratio", F.col("current_assets"), F.col("current_liabilities"), "current_liabilities"),
        "debt_to_equity": quotient("debt_to_equity", F.col("total_debt"), equity, "equity", _not_meaningful("debt_to_equity", equity, equity["value"] < 0, "equity is negative")),
        "roa": quotient("roa", net, _average("roa", "total_assets"), "total_assets"),
        "roe": quotient("roe", net, _average("roe", "equity"), "equity"),
        "ocf_to_net_income": quotient("ocf_to_net_income", F.col("operating_cash_flow"), net, "net_income", _not_meaningful("ocf_to_net_income", net, net["value"] <= 0, "net income is not positive")),
    })
    return out.drop("_prior_year", "_prior_total_assets", "_prior_equity")


def _long(rows: DataFrame, names: list[str], kind: str) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast(kind).alias("x")) for n in names])
    return rows.select("document_id", "end_year", F.explode(cells).alias("c"))


def figures_long(rows: DataFrame) -> DataFrame:
    """document_id, concept, end_year, value, currency, rank, extraction, refs, na of every concept and period."""
    return _long(rows, list(CONCEPTS), FIGURE).select("document_id", F.col("c.name").alias("concept"), "end_year", "c.x.*")


def metrics_long(rows: DataFrame) -> DataFrame:
    """document_id, name, end_year, value, unit, rank, refs, na of every metric and period."""
    unit = F.create_map(*[F.lit(x) for pair in METRICS.items() for x in pair])
    out = _long(rows, list(METRICS), RATIO).select("document_id", F.col("c.name").alias("name"), "end_year", "c.x.*")
    return out.withColumn("unit", F.element_at(unit, F.col("name")))


def is_broken() -> Column:
    """Not exactly one of value and reason is there."""
    return F.col("value").isNull() == F.col("na").isNull()


def watched(rows: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """rows (value, na) that count, while something else reads them, how many are ``broken``; the count is there afterwards."""
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    return rows.observe(seen, F.count_if(is_broken()).alias("broken"), F.count("*").alias("rows")), seen


def lookup(figures: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (document_id, concept, end_year) with what is known of each; what was never recorded is missing input."""
    out = wanted.join(figures, ["document_id", "concept", "end_year"], "left")
    default = reason("missing_input", text(F.col("concept"), " unavailable for ", F.col("end_year")))
    return out.withColumn("na", F.when(F.col("value").isNull(), F.coalesce(F.col("na").cast(NA), default)).otherwise(none(NA))).withColumn("refs", F.coalesce("refs", no_refs()))


__all__ = ["analysed", "by_year", "derive", "figures_long", "first_reason", "is_broken", "lookup", "metrics_long", "quotient", "watched"]
