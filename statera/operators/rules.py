"""Red-flag rules over the latest period of each document (R1-R13); each is fired, clear or not evaluated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statera.functions.maybe import NA, divide, first_reason, known, merged_refs, no_refs, none, reason, text
from statera.functions.vocabulary import RULES

FLAG = f"struct<rule_id:string,outcome:string,severity:string,message:string,refs:array<string>,na:{NA}>"
#: The limits of the rules.
COMPRESSION, LEVERAGE_RISE, LEVERAGE_FLOOR, HIGH_LEVERAGE, LIQUIDITY, EARNINGS, JUMP, TURNOVER = "0.02", "0.25", "1.0", "2.0", "1.0", "0.7", 100, 20


def number(x: Column) -> Column:
    """From 1000 on: no decimals, with commas; below: four at most, without trailing zeros; half to even."""
    large = F.format_number(F.bround(x, 0), 0)
    small = F.regexp_replace(F.regexp_replace(F.bround(x, 4).cast("decimal(38,4)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(F.abs(x) >= 1000, large).otherwise(small)


def limit(x: str) -> Column:
    return F.lit(x).cast("decimal(6,3)")


def verdict(fired: Column, refs: Column, detail: Column | str, na: Column | None = None) -> Column:
    """What a rule found; where na is not null, only that it could not be evaluated."""
    said = F.lit(detail) if isinstance(detail, str) else detail
    if na is None:
        return _verdict(fired, refs, said, none(NA))
    live = na.isNull()
    return _verdict(F.when(live, fired), F.when(live, refs).otherwise(F.coalesce(na["refs"], no_refs())), F.when(live, said), na)


def _verdict(*parts: Column) -> Column:
    return F.struct(*[p.alias(n) for n, p in zip(("fired", "refs", "detail", "na"), parts, strict=True)])


def _change(subject: str) -> Column:
    """A change of the latest period, or that there is none."""
    x = F.col(f"change_{subject}")
    return x, F.when(x.isNull(), reason("missing_input", text(f"{subject} change unavailable for ", F.col("end_year")))).otherwise(x["na"])


def _limit_rule(name: str, fires) -> Column:
    x = F.col(name)
    return verdict(fires(x["value"]), merged_refs(x), text(f"{name} ", number(x["value"])), x["na"])


def _magnitude() -> Column:
    """A hundredfold jump against the newest older period that has any value, or revenue beyond 20 times total assets."""
    year, old = F.col("end_year"), F.col("_old_year")
    jumps, seen, causes = [], [], []
    for concept in ("revenue", "total_assets", "equity"):
        a, b = F.col(concept), F.col(f"_old_{concept}")
        none_before = reason("missing_input", text("no period before ", year))
        cause = F.coalesce(a["na"], F.when(b.isNull(), none_before).otherwise(b["na"]))
        zero = F.when(cause.isNull() & ((a["value"] == 0) | (b["value"] == 0)), reason("division_by_zero", text(f"{concept} ", F.when(a["value"] == 0, year).otherwise(old), " is zero"), merged_refs(a, b)))
        cause = F.coalesce(cause, zero)
        big, small = F.greatest(F.abs(a["value"]), F.abs(b["value"])), F.least(F.abs(a["value"]), F.abs(b["value"]))
        hit = cause.isNull() & (F.try_multiply(small.cast("decimal(34,4)"), F.lit(JUMP).cast("decimal(3,0)")) <= big)
        said = text(f"{concept} ", old, "->", year, " changed ", number(divide(big, small)), "x")
        jumps.append(F.when(hit, F.struct(said.alias("said"), merged_refs(a, b).alias("refs"))))
        seen.append(F.when(cause.isNull(), merged_refs(a, b)))
        causes.append(cause)
    revenue, assets = F.col("revenue"), F.col("total_assets")
    cause = first_reason(revenue, assets)
    cause = F.coalesce(cause, F.when(assets["value"] <= 0, reason("division_by_zero", text("total_assets ", year, " is not positive"), merged_refs(assets))))
    turnover = divide(revenue["value"], assets["value"])
    jumps.append(F.when(cause.isNull() & (turnover > TURNOVER), F.struct(text("revenue/total_assets ", year, " is ", number(turnover)).alias("said"), merged_refs(revenue, assets).alias("refs"))))
    seen.append(F.when(cause.isNull(), merged_refs(revenue, assets)))
    causes.append(cause)
    hits = F.filter(F.array(*jumps), lambda h: h.isNotNull())
    looked = F.filter(F.array(*seen), lambda r: r.isNotNull())
    nothing = F.when(F.size(looked) == 0, reason("missing_input", "no magnitude check could run", None, F.coalesce(*causes)))
    refs = F.when(F.size(hits) > 0, F.array_distinct(F.flatten(F.transform(hits, lambda h: h["refs"])))).otherwise(F.array_distinct(F.flatten(looked)))
    return verdict(F.size(hits) > 0, refs, F.array_join(F.transform(hits, lambda h: h["said"]), "; "), nothing)


def _verdicts() -> dict[str, Column]:
    revenue, ocf, net, fcf = F.col("revenue"), F.col("operating_cash_flow"), F.col("net_income"), F.col("free_cash_flow")
    d_e, quality = F.col("debt_to_equity"), F.col("ocf_to_net_income")
    fell, fell_na = _change("revenue")
    margins = [(name, *_change(name)) for name in ("gross_margin", "operating_margin")]
    some = [F.when(na.isNull(), F.struct((x["absolute"] < -limit(COMPRESSION)).alias("hit"), merged_refs(F.col(name)).alias("refs"), text(f"{name} ", number(x["absolute"])).alias("said"))) for name, x, na in margins]
    found = F.filter(F.array(*some), lambda m: m.isNotNull())
    no_margin = F.when(F.size(found) == 0, margins[0][2])
    rise, rise_na = _change("debt_to_equity")
    leverage_na = F.coalesce(rise_na, d_e["na"])
    negative = lambda name, x: verdict(x["value"] < 0, merged_refs(x), text(f"{name} ", number(x["value"])), x["na"])
    live = F.filter("checks", lambda c: c["status"] != "unavailable")
    warned = F.filter("checks", lambda c: c["status"] == "warning")
    weak = F.array(*[F.when(~known(F.col(f"mapped_{c}")), F.lit(f"{c} unmapped")).when(F.col(f"mapped_{c}")["extraction"] == "llm_mapped", F.lit(f"{c} llm_mapped")) for c in ("revenue", "net_income")])
    weak = F.filter(weak, lambda w: w.isNotNull())
    model_refs = F.flatten(F.array(*[F.when(F.col(f"mapped_{c}")["extraction"] == "llm_mapped", F.col(f"mapped_{c}")["refs"]).otherwise(no_refs()) for c in ("revenue", "net_income")]))
    return {
        "revenue_decline": verdict(fell["absolute"] < 0, merged_refs(revenue), text("revenue change ", fell["absolute"].cast("decimal(38,4)")), fell_na),
        "margin_compression": verdict(F.exists(found, lambda m: m["hit"]), F.array_distinct(F.flatten(F.transform(found, lambda m: m["refs"]))), F.array_join(F.transform(found, lambda m: m["said"]), ", "), no_margin),
        "leverage_increase": verdict((rise["absolute"] > limit(LEVERAGE_RISE)) & (d_e["value"] > limit(LEVERAGE_FLOOR)), merged_refs(d_e), text("D/E ", number(d_e["value"]), ", change ", number(rise["absolute"])), leverage_na),
        "high_leverage": _limit_rule("debt_to_equity", lambda v: v > limit(HIGH_LEVERAGE)),
        "negative_fcf": negative("free_cash_flow", fcf),
        "negative_ocf": negative("operating_cash_flow", ocf),
        "weak_liquidity": _limit_rule("current_ratio", lambda v: v < limit(LIQUIDITY)),
        "earnings_quality": verdict((ocf["value"] > 0) & (net["value"] > 0) & (quality["value"] < limit(EARNINGS)), merged_refs(quality), text("OCF/NI ", number(quality["value"])), first_reason(ocf, net, quality)),
        "reconciliation_warning": verdict(F.size(warned) > 0, F.array_distinct(F.flatten(F.transform(warned, lambda c: c["refs"]))), F.array_join(F.transform(warned, lambda c: c["name"]), "; "), F.when(F.size(live) == 0, reason("missing_input", "no reconciliation could run"))),
        "low_confidence_kpi": verdict(F.size(weak) > 0, model_refs, F.array_join(weak, ", ")),
        "implausible_magnitude": _magnitude(),
    }


def latest(rows: DataFrame) -> DataFrame:
    """The newest period of each document, with revenue, assets and equity of the newest older period that has any value."""
    older = Window.partitionBy("document_id").orderBy("end_year").rowsBetween(Window.unboundedPreceding, -1)
    names = ("revenue", "total_assets", "equity")
    old = F.struct(F.col("end_year").alias("year"), *names)
    rows = rows.withColumn("_old", F.last(F.when(F.col("_any"), old), ignorenulls=True).over(older))
    newest = Window.partitionBy("document_id").orderBy(F.desc("end_year"))
    rows = rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1")
    return rows.withColumns({"_old_year": F.col("_old.year"), **{f"_old_{n}": F.col(f"_old.{n}") for n in names}}).drop("_n", "_old")


def flags(rows: DataFrame) -> DataFrame:
    """document_id, rule_id, outcome, severity, message, refs, na for all rules of each document's latest period.

    rows: figures.analysed with changes and checks.
    """
    cells = F.array(*[F.struct(F.lit(rule).alias("rule_id"), v.alias("v")) for rule, v in _verdicts().items()])
    found = latest(rows).select("document_id", F.explode(cells).alias("f")).select("document_id", "f.rule_id", "f.v")
    table = F.create_map(*[x for r, (s, fired, clear) in RULES.items() for x in (F.lit(r), F.struct(F.lit(s).alias("severity"), F.lit(fired).alias("fired"), F.lit(clear).alias("clear")))])
    found = found.withColumn("rule", F.element_at(table, F.col("rule_id")))
    fired, na = F.col("v.fired"), F.col("v.na")
    message = F.when(na.isNotNull(), text("Could not evaluate: ", na["root_detail"])).when(fired, F.replace(F.col("rule.fired"), F.lit("{detail}"), F.col("v.detail"))).otherwise(F.col("rule.clear"))
    outcome = F.when(na.isNotNull(), "not_evaluated").when(fired, "fired").otherwise("clear")
    return found.select("document_id", "rule_id", outcome.alias("outcome"), F.col("rule.severity").alias("severity"), message.alias("message"), F.col("v.refs").alias("refs"), F.col("v.na").alias("na"))


def without_periods(documents: DataFrame) -> DataFrame:
    """All rules not evaluated, for documents (document_id, na) whose periods could not be told."""
    why = F.coalesce(F.col("na").cast(NA), reason("missing_input", "no periods detected"))
    cells = F.array(*[F.struct(F.lit(r), F.lit("not_evaluated"), F.lit(s), F.lit("No periods."), no_refs(), why).cast(FLAG) for r, (s, _, _) in RULES.items()])
    return documents.select("document_id", F.explode(cells).alias("f")).select("document_id", "f.*")


def ordered(found: DataFrame) -> DataFrame:
    """Fired first, then not evaluated, then clear; by rule name within."""
    place = F.when(F.col("outcome") == "fired", 0).when(F.col("outcome") == "not_evaluated", 1).otherwise(2)
    return found.orderBy("document_id", place, "rule_id")
