"""Reconciliation of figures within a tolerance (C14-C17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statera.functions.maybe import NA, all_known, first_reason, joined_refs, none, no_refs, text
from statera.functions.vocabulary import BALANCE, CASH_FLOW, CHECKS, INCOME, TOLERANCE

MONEY, LIMIT = "decimal(38,4)", "decimal(38,7)"


def _check(*parts: Column) -> Column:
    names = ("name", "status", "left", "right", "delta", "tolerance", "detail", "refs", "na")
    return F.struct(*[p.alias(n) for n, p in zip(names, parts, strict=True)])


def check(name: str, left: Column, parts: list[Column], right: Column, base: Column, exact: bool, suspects: Column) -> Column:
    """Passed, warning or unavailable; the tolerance is inclusive. A warning names the cells whose dash was read as zero."""
    items = [left, *parts, base]
    cause = first_reason(*items)
    delta = F.try_subtract(left["value"], right)
    tolerance = F.lit(0).cast(LIMIT) if exact else (F.abs(base["value"]).cast("decimal(33,4)") * F.lit(TOLERANCE).cast("decimal(4,3)")).cast(LIMIT)
    passed = F.abs(delta) <= tolerance
    said = text(f"{CHECKS[name]}: ", left["value"], " vs ", right)
    over = text(said, ", delta ", delta, " exceeds tolerance ", tolerance)
    over = F.when(F.size(suspects) > 0, text(over, "; dash-zero cells applied on this statement: ", F.array_join(suspects, ", "))).otherwise(over)
    money = lambda x: x.try_cast(MONEY)
    live = _check(F.lit(name), F.when(passed, "passed").otherwise("warning"), money(left["value"]), money(right), money(delta), tolerance, F.when(passed, said).otherwise(over), joined_refs(*items), none(NA))
    dead = _check(F.lit(name), F.lit("unavailable"), left["value"], none(MONEY), none(MONEY), F.lit(0).cast(LIMIT), text("cannot check: ", cause["root_detail"]), joined_refs(*items), cause)
    return F.when(all_known(*items), live).otherwise(dead)


def with_checks(analysed: DataFrame, dash_zeros: DataFrame | None = None) -> DataFrame:
    """A column ``checks`` (array of three) on the rows of figures.analysed. dash_zeros: document_id, kind, refs."""
    rows = analysed
    if dash_zeros is not None:
        found = dash_zeros.groupBy("document_id").agg(F.map_from_entries(F.collect_list(F.struct("kind", "refs"))).alias("_zeros"))
        rows = rows.join(found, "document_id", "left")
    else:
        rows = rows.withColumn("_zeros", F.lit(None).cast("map<string,array<string>>"))
    suspects = lambda kind: F.coalesce(F.try_element_at("_zeros", F.lit(kind)), no_refs())
    c = F.col
    assets, gross, fcf = list(CHECKS)
    value = lambda name: c(name)["value"]
    made = F.array(
        check(assets, c("total_assets"), [c("total_liabilities"), c("equity")], F.try_add(value("total_liabilities"), value("equity")), c("total_assets"), False, suspects(BALANCE)),
        check(gross, c("gross_profit"), [c("revenue"), c("cogs")], F.try_subtract(value("revenue"), F.abs(value("cogs"))), c("revenue"), False, suspects(INCOME)),
        check(fcf, c("free_cash_flow"), [c("operating_cash_flow"), c("capex")], F.try_subtract(value("operating_cash_flow"), F.abs(value("capex"))), c("operating_cash_flow"), True, suspects(CASH_FLOW)),
    )
    return rows.withColumn("checks", made).drop("_zeros")


def checks_long(rows: DataFrame) -> DataFrame:
    """document_id, end_year, name, status, left, right, delta, tolerance, detail, refs, na."""
    return rows.select("document_id", "end_year", F.explode("checks").alias("c")).select("document_id", "end_year", "c.*")
