"""Queries over the issuers' years, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statera.functions.vocabulary import CHANGES, CONCEPTS, METRICS, RULES
from statera.operators import changes, checks, figures, rules, views
from statera.plans.issuer_years import CURRENCY, FACTS, analysed, analysis, changed, checked, values

D = "double"
RATIO_DIGITS = 6


def _rounded(x: str) -> Column:
    return F.round(F.col(x).cast(D), RATIO_DIGITS).alias(x)


def issuer_year_values(spark: SparkSession, d: str) -> DataFrame:
    return values(spark, d).select("document_id", "concept", F.col("end_year").cast("long").alias("end_year"), F.col("value").cast(D).alias("value"), "currency")


def period_union_ordered(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    years = values(spark, d).select("document_id", "end_year").distinct()
    place = F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("end_year")))
    return years.select("document_id", F.col("end_year").cast("long").alias("end_year"), place.cast("long").alias("ord"))


def derived_values(spark: SparkSession, d: str) -> DataFrame:
    found = figures.figures_long(analysed(spark, d)).where(F.col("concept").isin("total_debt", "free_cash_flow", "ebitda"))
    return found.select("document_id", "concept", F.col("end_year").cast("long").alias("end_year"), F.col("value").cast(D).alias("value"), F.col("na.reason").alias("reason"))


def metrics_long_with_reasons(spark: SparkSession, d: str) -> DataFrame:
    found = figures.metrics_long(analysed(spark, d))
    return found.select("document_id", "name", F.col("end_year").cast("long").alias("end_year"), _rounded("value"), "unit", F.col("na.reason").alias("reason"), F.col("na.detail").alias("detail"))


def _one_metric(*names: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        found = figures.metrics_long(analysed(spark, d)).where(F.col("name").isin(*names))
        return found.select("document_id", "name", F.col("end_year").cast("long").alias("end_year"), _rounded("value"), F.col("na.reason").alias("reason"))

    return query


def yoy_changes(spark: SparkSession, d: str) -> DataFrame:
    found = changes.changes_long(changed(spark, d))
    return found.select(
        "document_id", "subject", F.col("from_year").cast("long").alias("from_year"), F.col("to_year").cast("long").alias("to_year"),
        _rounded("absolute"), _rounded("relative"), "direction", "economic", F.col("na.reason").alias("reason"),
    )


def reconciliation_checks(spark: SparkSession, d: str) -> DataFrame:
    found = checks.checks_long(checked(spark, d))
    return found.select("document_id", F.col("end_year").cast("long").alias("end_year"), "name", "status", F.col("delta").cast(D).alias("delta"), F.col("tolerance").cast(D).alias("tolerance"))


def red_flags_latest(spark: SparkSession, d: str) -> DataFrame:
    return rules.flags(analysis(spark, d)).select("document_id", "rule_id", "outcome", "severity")


def red_flag_messages(spark: SparkSession, d: str) -> DataFrame:
    return rules.flags(analysis(spark, d)).select("document_id", "rule_id", "message", F.array_join("refs", ",").alias("refs"))


def kpi_cards(spark: SparkSession, d: str) -> DataFrame:
    out = views.kpi_cards(analysis(spark, d))
    return out.select("document_id", F.col("position").cast("long").alias("position"), "name", "label", F.col("period").cast("long").alias("period"), "reads", "status", (F.col("value") == "N/A").alias("missing"), (F.col("delta") == "").alias("no_delta"))


def kpi_texts(spark: SparkSession, d: str) -> DataFrame:
    return views.kpi_cards(analysis(spark, d)).select("document_id", "name", "value", "delta")


def metric_rows(spark: SparkSession, d: str) -> DataFrame:
    out = views.metric_rows(figures.metrics_long(analysed(spark, d)))
    return out.select("document_id", "metric", F.col("period").cast("long").alias("period"), "status", F.when(F.col("status") == "na", F.col("value")).alias("why"))


def flag_order(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    found = rules.flags(analysis(spark, d))
    place = F.when(F.col("outcome") == "fired", 0).when(F.col("outcome") == "not_evaluated", 1).otherwise(2)
    order = Window.partitionBy("document_id").orderBy(place, "rule_id")
    return found.select("document_id", "rule_id", F.row_number().over(order).cast("long").alias("position"))


def _chart(build):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return build(analysis(spark, d)).withColumn("period", F.col("period").cast("long"))

    return query


def chart_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    rows = views.latest(analysis(spark, d)).select("document_id", "end_year", F.explode("checks").alias("c"))
    return rows.select("document_id", F.col("end_year").cast("long").alias("period"), "c.name", "c.status", F.col("c.left").cast(D).alias("left"), F.col("c.right").cast(D).alias("right"))


# --- SQL ---------------------------------------------------------------------------------------------------------------

_SUMS = """
    sums AS (
        SELECT n_name AS document_id, n_nationkey AS n, year(o_orderdate) AS y,
            sum(l_extendedprice::DECIMAL(18,2) * (1 - l_discount::DECIMAL(4,2)))::DECIMAL(30,4) AS net,
            coalesce(sum(l_extendedprice::DECIMAL(18,2)) FILTER (l_returnflag = 'R'), 0)::DECIMAL(30,4) AS returned,
            coalesce(sum(l_extendedprice::DECIMAL(18,2)) FILTER (l_linestatus = 'O'), 0)::DECIMAL(30,4) AS opened,
            sum(l_extendedprice::DECIMAL(18,2) * l_discount::DECIMAL(4,2))::DECIMAL(30,4) AS discount,
            sum(l_extendedprice::DECIMAL(18,2) * l_tax::DECIMAL(4,2))::DECIMAL(30,4) AS tax
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        GROUP BY ALL)"""
_WIDE = ", ".join(f"({sql})::DECIMAL(38,4) AS {c}" for c, sql in FACTS.items())
#: One row for each issuer and year; derived figures and ratios, each with the reason for its absence (r_...).
_ROWS = f"""
    {_SUMS},
    mapped AS (SELECT document_id, n, y, {_WIDE} FROM sums),
    derived AS (
        SELECT *,
            CASE WHEN n = 11 THEN NULL ELSE short_term_borrowings + long_term_borrowings END AS total_debt,
            operating_cash_flow - abs(capex) AS free_cash_flow, operating_income + d_and_a AS ebitda,
            CASE WHEN short_term_borrowings IS NULL OR long_term_borrowings IS NULL THEN 'missing_input' WHEN n = 11 THEN 'conflict' END AS r_total_debt,
            CASE WHEN capex IS NULL THEN 'missing_input' END AS r_free_cash_flow, NULL AS r_ebitda,
            lag(y) OVER w AS p, lag(total_assets) OVER w AS p_assets, lag(equity) OVER w AS p_equity
        FROM mapped WINDOW w AS (PARTITION BY document_id ORDER BY y)),
    prepared AS (SELECT *, (total_assets + p_assets) / 2 AS mean_assets, (equity + p_equity) / 2 AS mean_equity FROM derived),
    rows AS (
        SELECT *,
            CASE WHEN revenue > 0 THEN gross_profit::DOUBLE / revenue::DOUBLE END AS gross_margin,
            CASE WHEN revenue > 0 THEN operating_income::DOUBLE / revenue::DOUBLE END AS operating_margin,
            CASE WHEN revenue > 0 THEN net_income::DOUBLE / revenue::DOUBLE END AS net_margin,
            CASE WHEN revenue > 0 THEN ebitda::DOUBLE / revenue::DOUBLE END AS ebitda_margin,
            CASE WHEN current_liabilities <> 0 THEN current_assets::DOUBLE / current_liabilities::DOUBLE END AS current_ratio,
            CASE WHEN equity > 0 THEN total_debt::DOUBLE / equity::DOUBLE END AS debt_to_equity,
            CASE WHEN mean_assets > 0 THEN net_income::DOUBLE / mean_assets::DOUBLE END AS roa,
            CASE WHEN mean_equity > 0 THEN net_income::DOUBLE / mean_equity::DOUBLE END AS roe,
            CASE WHEN net_income > 0 THEN operating_cash_flow::DOUBLE / net_income::DOUBLE END AS ocf_to_net_income,
            CASE WHEN revenue = 0 THEN 'division_by_zero' END AS r_gross_margin, CASE WHEN revenue = 0 THEN 'division_by_zero' END AS r_operating_margin,
            CASE WHEN revenue = 0 THEN 'division_by_zero' END AS r_net_margin, CASE WHEN revenue = 0 THEN 'division_by_zero' END AS r_ebitda_margin,
            CASE WHEN current_assets IS NULL THEN 'missing_input' WHEN current_liabilities = 0 THEN 'division_by_zero' END AS r_current_ratio,
            CASE WHEN equity < 0 THEN 'ambiguous' WHEN r_total_debt IS NOT NULL OR equity IS NULL THEN 'missing_input' WHEN equity = 0 THEN 'division_by_zero' END AS r_debt_to_equity,
            CASE WHEN mean_assets IS NULL THEN 'missing_input' WHEN mean_assets = 0 THEN 'division_by_zero' END AS r_roa,
            CASE WHEN mean_equity IS NULL THEN 'missing_input' WHEN mean_equity < 0 THEN 'ambiguous' WHEN mean_equity = 0 THEN 'division_by_zero' END AS r_roe,
            CASE WHEN net_income <= 0 THEN 'ambiguous' END AS r_ocf_to_net_income
        FROM prepared)"""


def _unpivot(names: list[str], first: str, template: str) -> str:
    return " UNION ALL ".join(f"SELECT {template.format(x=x)} FROM {first}" for x in names)


_DETAIL = {
    **{f"{m}_margin": f"CASE WHEN revenue = 0 THEN '{m}_margin ' || y || ': revenue is zero' END" for m in ("gross", "operating", "net", "ebitda")},
    "current_ratio": "CASE WHEN current_assets IS NULL THEN 'current_ratio ' || y || ': current_assets not mapped for ' || y WHEN current_liabilities = 0 THEN 'current_ratio ' || y || ': current_liabilities is zero' END",
    "debt_to_equity": """CASE WHEN equity < 0 THEN 'debt_to_equity ' || y || ': equity is negative; ratio not meaningful'
        WHEN short_term_borrowings IS NULL THEN 'debt_to_equity ' || y || ': total_debt ' || y || ': short_term_borrowings not mapped for ' || y
        WHEN long_term_borrowings IS NULL THEN 'debt_to_equity ' || y || ': total_debt ' || y || ': long_term_borrowings not mapped for ' || y
        WHEN n = 11 THEN 'debt_to_equity ' || y || ': total_debt ' || y || ': inputs in different currencies'
        WHEN equity = 0 THEN 'debt_to_equity ' || y || ': equity is zero' END""",
    "roa": "CASE WHEN total_assets IS NULL THEN 'roa ' || y || ': total_assets not mapped for ' || y WHEN p_assets IS NULL THEN 'roa ' || y || ': roa ' || y || ': prior-period total_assets required for average' WHEN mean_assets = 0 THEN 'roa ' || y || ': total_assets is zero' END",
    "roe": "CASE WHEN equity IS NULL THEN 'roe ' || y || ': equity not mapped for ' || y WHEN p_equity IS NULL THEN 'roe ' || y || ': roe ' || y || ': prior-period equity required for average' WHEN mean_equity < 0 THEN 'roe ' || y || ': average equity is negative; ratio not meaningful' WHEN mean_equity = 0 THEN 'roe ' || y || ': equity is zero' END",
    "ocf_to_net_income": "CASE WHEN net_income <= 0 THEN 'ocf_to_net_income ' || y || ': net income is not positive; ratio not meaningful' END",
}
_METRICS = "WITH " + _ROWS + ", metrics AS (" + " UNION ALL ".join(
    f"SELECT document_id, '{m}' AS name, y AS end_year, round({m}, {RATIO_DIGITS}) AS value, '{unit}' AS unit, r_{m} AS reason, {_DETAIL[m]} AS detail FROM rows" for m, unit in METRICS.items()
) + ")"


def _metric_sql(*names: str) -> str:
    listed = ", ".join(f"'{n}'" for n in names)
    return f"{_METRICS} SELECT document_id, name, end_year, value, reason FROM metrics WHERE name IN ({listed})"


def _change_sql() -> str:
    out = []
    for s, sense in CHANGES.items():
        good, bad = ("positive", "negative") if sense > 0 else ("negative", "positive")
        money = s in CONCEPTS
        cast = "::DOUBLE" if money else ""
        out.append(f"""SELECT document_id, '{s}' AS subject, p AS from_year, y AS to_year, round(({s} - b){cast}, {RATIO_DIGITS}) AS absolute,
            CASE WHEN b <> 0 THEN round(({s} - b)::DOUBLE / abs(b)::DOUBLE, {RATIO_DIGITS}) END AS relative,
            CASE WHEN {s} > b THEN 'up' WHEN {s} < b THEN 'down' WHEN {s} = b THEN 'flat' END AS direction,
            CASE WHEN {s} > b THEN '{good}' WHEN {s} < b THEN '{bad}' WHEN {s} = b THEN 'neutral' END AS economic,
            CASE WHEN {s} IS NULL OR b IS NULL THEN 'missing_input' END AS reason
            FROM (SELECT *, lag({s}) OVER (PARTITION BY document_id ORDER BY y) AS b FROM rows) WHERE p IS NOT NULL""")
    return "WITH " + _ROWS + " " + " UNION ALL ".join(out)


_CHECKS = "WITH " + _ROWS + """, checks AS (
    SELECT document_id, y AS end_year, 'assets_equal_liabilities_plus_equity' AS name, total_assets - (total_liabilities + equity) AS delta, abs(total_assets) * 0.005 AS tolerance FROM rows
    UNION ALL SELECT document_id, y, 'gross_profit_equals_revenue_minus_cogs', gross_profit - (revenue - abs(cogs)), abs(revenue) * 0.005 FROM rows
    UNION ALL SELECT document_id, y, 'fcf_equals_ocf_minus_capex', free_cash_flow - (operating_cash_flow - abs(capex)), CASE WHEN free_cash_flow IS NULL THEN NULL ELSE 0 END FROM rows),
    judged AS (SELECT *, CASE WHEN delta IS NULL THEN 'unavailable' WHEN abs(delta) <= tolerance THEN 'passed' ELSE 'warning' END AS status FROM checks)"""  # fmt: skip

_FLAGS = _CHECKS + """,
    paired AS (SELECT *, lag(revenue) OVER w AS b_revenue, lag(gross_margin) OVER w AS b_gross, lag(operating_margin) OVER w AS b_operating, lag(debt_to_equity) OVER w AS b_leverage,
        lag(total_assets) OVER w AS b_assets, lag(equity) OVER w AS b_equity, row_number() OVER (PARTITION BY document_id ORDER BY y DESC) AS k
        FROM rows WINDOW w AS (PARTITION BY document_id ORDER BY y)),
    newest AS (SELECT paired.*, (SELECT count(*) FROM judged j WHERE j.document_id = paired.document_id AND j.end_year = y AND status <> 'unavailable') AS live,
        (SELECT count(*) FROM judged j WHERE j.document_id = paired.document_id AND j.end_year = y AND status = 'warning') AS warned FROM paired WHERE k = 1),
    found AS (
        SELECT document_id, 'revenue_decline' AS rule_id, revenue < b_revenue AS fired FROM newest
        UNION ALL SELECT document_id, 'margin_compression', CASE WHEN gross_margin - b_gross IS NULL AND operating_margin - b_operating IS NULL THEN NULL
            ELSE coalesce(gross_margin - b_gross < -0.02, false) OR coalesce(operating_margin - b_operating < -0.02, false) END FROM newest
        UNION ALL SELECT document_id, 'leverage_increase', debt_to_equity - b_leverage > 0.25 AND CASE WHEN b_leverage IS NOT NULL THEN debt_to_equity > 1.0 END FROM newest
        UNION ALL SELECT document_id, 'high_leverage', debt_to_equity > 2.0 FROM newest
        UNION ALL SELECT document_id, 'negative_fcf', free_cash_flow < 0 FROM newest
        UNION ALL SELECT document_id, 'negative_ocf', operating_cash_flow < 0 FROM newest
        UNION ALL SELECT document_id, 'weak_liquidity', current_ratio < 1.0 FROM newest
        UNION ALL SELECT document_id, 'earnings_quality', CASE WHEN ocf_to_net_income IS NOT NULL THEN operating_cash_flow > 0 AND net_income > 0 AND ocf_to_net_income < 0.7 END FROM newest
        UNION ALL SELECT document_id, 'reconciliation_warning', CASE WHEN live > 0 THEN warned > 0 END FROM newest
        UNION ALL SELECT document_id, 'low_confidence_kpi', revenue IS NULL OR net_income IS NULL FROM newest
        UNION ALL SELECT document_id, 'implausible_magnitude', coalesce(greatest(abs(revenue), abs(b_revenue)) >= 100 * nullif(least(abs(revenue), abs(b_revenue)), 0), false)
            OR coalesce(greatest(abs(total_assets), abs(b_assets)) >= 100 * nullif(least(abs(total_assets), abs(b_assets)), 0), false)
            OR coalesce(greatest(abs(equity), abs(b_equity)) >= 100 * nullif(least(abs(equity), abs(b_equity)), 0), false)
            OR coalesce(revenue::DOUBLE / nullif(total_assets, 0)::DOUBLE > 20, false) FROM newest),
    severities(rule_id, severity) AS (VALUES """ + ", ".join(f"('{r}', '{s}')" for r, (s, _, _) in RULES.items()) + "),"  # fmt: skip
_FLAGS += " flags AS (SELECT document_id, rule_id, CASE WHEN fired IS NULL THEN 'not_evaluated' WHEN fired THEN 'fired' ELSE 'clear' END AS outcome, severity FROM found JOIN severities USING (rule_id))"

_VALUES = f"WITH {_SUMS}, facts AS (" + _unpivot(list(FACTS), "sums", "document_id, n, y AS end_year, '{x}' AS concept, ") .replace(" FROM sums", "§ FROM sums") + ")"
for _c, _sql in FACTS.items():
    _VALUES = _VALUES.replace(f"'{_c}' AS concept, §", f"'{_c}' AS concept, ({_sql})::DECIMAL(38,4) AS value", 1)

QUERIES = {
    "issuer_year_values": issuer_year_values,
    "period_union_ordered": period_union_ordered,
    "derived_values": derived_values,
    "margins": _one_metric("gross_margin", "operating_margin", "net_margin", "ebitda_margin"),
    "current_ratio": _one_metric("current_ratio"),
    "debt_to_equity": _one_metric("debt_to_equity"),
    "ocf_to_net_income": _one_metric("ocf_to_net_income"),
    "roa_roe_average": _one_metric("roa", "roe"),
    "metrics_long_with_reasons": metrics_long_with_reasons,
    "yoy_changes": yoy_changes,
    "reconciliation_checks": reconciliation_checks,
    "red_flags_latest": red_flags_latest,
    "red_flag_messages": red_flag_messages,
    "kpi_cards": kpi_cards,
    "kpi_texts": kpi_texts,
    "metric_rows": metric_rows,
    "flag_order": flag_order,
    "chart_performance": _chart(lambda rows: views.series(rows, views.PERFORMANCE, "figure")),
    "chart_margins": _chart(lambda rows: views.series(rows, views.MARGINS, "ratio")),
    "chart_balance": _chart(views.balance_series),
    "chart_cash": _chart(views.cash_waterfall),
    "chart_reconciliation": chart_reconciliation,
}
_CARDS_SQL = " UNION ALL ".join(
    f"""SELECT document_id, {i} AS position, '{n}' AS name, '{views.LABELS[n]}' AS label, y AS period,
        CASE WHEN {n} IS NULL OR b IS NULL THEN 'neutral' WHEN {n} > b THEN '{"positive" if CHANGES[n] > 0 else "negative"}' WHEN {n} < b THEN '{"negative" if CHANGES[n] > 0 else "positive"}' ELSE 'neutral' END AS reads,
        CASE WHEN {n} IS NULL THEN 'na' ELSE 'ok' END AS status, {n} IS NULL AS missing, {n} IS NULL OR b IS NULL AS no_delta
        FROM (SELECT *, lag({n}) OVER (PARTITION BY document_id ORDER BY y) AS b, row_number() OVER (PARTITION BY document_id ORDER BY y DESC) AS k FROM rows) WHERE k = 1"""
    if n in CHANGES else f"""SELECT document_id, {i}, '{n}', '{views.LABELS[n]}', y, 'neutral', CASE WHEN {n} IS NULL THEN 'na' ELSE 'ok' END, {n} IS NULL, true
        FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY y DESC) AS k FROM rows) WHERE k = 1"""
    for i, n in enumerate(views.CARDS)
)

ORACLE = {
    "kpi_cards": "WITH " + _ROWS + " " + _CARDS_SQL,
    "flag_order": f"{_FLAGS} SELECT document_id, rule_id, row_number() OVER (PARTITION BY document_id ORDER BY CASE outcome WHEN 'fired' THEN 0 WHEN 'not_evaluated' THEN 1 ELSE 2 END, rule_id) AS position FROM flags",
    "chart_performance": "WITH " + _ROWS + " SELECT * FROM (" + _unpivot(views.PERFORMANCE, "rows", "document_id, y AS period, '{x}' AS series, round_even({x}, 2)::DOUBLE AS value") + ") WHERE value IS NOT NULL",
    "chart_balance": "WITH " + _ROWS + ", whole AS (SELECT * FROM rows WHERE total_assets + total_liabilities + equity IS NOT NULL) " + _unpivot(views.BALANCE_PARTS, "whole", "document_id, y AS period, '{x}' AS series, round_even({x}, 2)::DOUBLE AS value"),
    "chart_cash": "WITH " + _ROWS + """, newest AS (SELECT * FROM rows QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY y DESC) = 1), c AS (SELECT * FROM newest WHERE free_cash_flow IS NOT NULL)
        SELECT document_id, y AS period, 'operating_cash_flow' AS step, 0::DOUBLE AS from_amount, operating_cash_flow::DOUBLE AS to_amount, operating_cash_flow::DOUBLE AS amount FROM c
        UNION ALL SELECT document_id, y, 'capex', operating_cash_flow::DOUBLE, (operating_cash_flow - abs(capex))::DOUBLE, -abs(capex)::DOUBLE FROM c
        UNION ALL SELECT document_id, y, 'free_cash_flow', 0, free_cash_flow::DOUBLE, free_cash_flow::DOUBLE FROM c""",
    "issuer_year_values": f"{_VALUES} SELECT document_id, concept, end_year, value::DOUBLE AS value, {CURRENCY} AS currency FROM facts WHERE value IS NOT NULL",
    "period_union_ordered": "SELECT n_name AS document_id, year(o_orderdate) AS end_year, row_number() OVER (PARTITION BY n_name ORDER BY year(o_orderdate) DESC) AS ord FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, year(o_orderdate)",
    "derived_values": "WITH " + _ROWS + " " + _unpivot(["total_debt", "free_cash_flow", "ebitda"], "rows", "document_id, '{x}' AS concept, y AS end_year, {x}::DOUBLE AS value, r_{x} AS reason"),
    "margins": _metric_sql("gross_margin", "operating_margin", "net_margin", "ebitda_margin"),
    "current_ratio": _metric_sql("current_ratio"),
    "debt_to_equity": _metric_sql("debt_to_equity"),
    "ocf_to_net_income": _metric_sql("ocf_to_net_income"),
    "roa_roe_average": _metric_sql("roa", "roe"),
    "metrics_long_with_reasons": f"{_METRICS} SELECT * FROM metrics",
    "yoy_changes": _change_sql(),
    "reconciliation_checks": f"{_CHECKS} SELECT document_id, end_year, name, status, delta::DOUBLE AS delta, CASE WHEN status = 'unavailable' THEN 0 ELSE tolerance::DOUBLE END AS tolerance FROM judged",
    "red_flags_latest": f"{_FLAGS} SELECT * FROM flags",
}
