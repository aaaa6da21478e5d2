"""Statements of three invented reports with answers worked out by hand."""

from decimal import Decimal

import pytest

from statera.plans.analysis import analyse

ROWS = {
    "income": (["2024", "2023"], [
        ("Net sales", "1,000", "800"), ("Cost of sales", "(600)", "(500)"), ("Gross profit", "400", "300"), ("Operating income", "150", "90"),
        ("Depreciation and amortization", "50", "40"), ("Net income", "100", "60"),
    ]),
    "balance": (["2024", "2023"], [
        ("Assets", "", ""), ("Cash and cash equivalents", "30", "20"), ("Total current assets", "300", "250"), ("Total assets", "900", "700"), ("Total current liabilities", "150", "125"),
        ("Short-term debt", "20", "—"), ("Long-term debt", "180", "200"), ("Total liabilities", "500", "400"), ("Total stockholders' equity", "400", "300"),
    ]),
    "cash_flow": (["2024", "2023"], [("Net cash provided by operating activities", "60", "90"), ("Purchases of property and equipment", "(70)", "(30)")]),
}


def frames(spark, documents):
    rows, heads = [], []
    for doc, kinds in documents.items():
        for p, (kind, (header, lines)) in enumerate(kinds.items()):
            heads += [(doc, kind, i + 1, h) for i, h in enumerate(header)]
            rows += [(doc, kind, f"page_{p}_table_0_row_{i}", i, line[0], list(line[1:]), "million", "USD") for i, line in enumerate(lines)]
    return (
        spark.createDataFrame(rows, "document_id string, kind string, ref_id string, row_idx int, label string, cells array<string>, scale string, currency string"),
        spark.createDataFrame(heads, "document_id string, kind string, col int, label string"),
    )


@pytest.fixture(scope="module")
def result(spark):
    twice = dict(ROWS, income=(["2024", "FY 2023-24"], ROWS["income"][1]))
    totals = {"income": (["2024", "2023"], [("Sales", "", ""), ("Net sales", "5", "4"), ("Sales", "1", "2"), ("Total", "9", "8"), ("Net income", "x,y", "1")])}
    out = analyse(*frames(spark, {"good": ROWS, "twice": twice, "totals": totals}))
    return {name: getattr(out, name).collect() for name in ("figures", "metrics", "changes", "checks", "flags", "notes", "conflicts", "unmapped", "without_periods")}


def value(rows, doc, name, year, key):
    return next(r for r in rows if r["document_id"] == doc and r[key] == name and r["end_year"] == year)


def test_figures_in_base_units(result):
    get = lambda c, y: value(result["figures"], "good", c, y, "concept")
    assert get("revenue", 2024).value == Decimal(1_000_000_000)
    assert get("free_cash_flow", 2024).value == Decimal(-10_000_000) and get("free_cash_flow", 2024).refs == ["operating_cash_flow", "capex"]
    assert get("total_debt", 2023).value == Decimal(200_000_000)  # a dash is zero
    assert get("ebitda", 2024).value == Decimal(200_000_000)


def test_ratios_and_reasons(result):
    get = lambda c, y: value(result["metrics"], "good", c, y, "name")
    assert get("gross_margin", 2024).value == Decimal("0.4") and get("debt_to_equity", 2024).value == Decimal("0.5")
    assert get("roa", 2024).value == Decimal("0.125") and get("roe", 2023).value is None
    assert get("roe", 2023).na.reason == "missing_input" and "prior-period equity" in get("roe", 2023).na.detail
    assert all((r.value is None) != (r.na is None) for r in result["metrics"])


def test_changes(result):
    get = lambda s: next(r for r in result["changes"] if r.document_id == "good" and r.subject == s)
    assert get("revenue").absolute == 200_000_000 and get("revenue").relative == Decimal("0.25") and get("revenue").economic == "positive"
    assert get("debt_to_equity").direction == "down" and get("debt_to_equity").economic == "positive"
    assert get("roe").na.reason == "missing_input"


def test_checks(result):
    got = {(r.name, r.end_year): r.status for r in result["checks"] if r.document_id == "good"}
    assert got[("assets_equal_liabilities_plus_equity", 2024)] == "passed" and got[("gross_profit_equals_revenue_minus_cogs", 2023)] == "passed"
    assert got[("fcf_equals_ocf_minus_capex", 2024)] == "passed"


def test_flags(result):
    got = {r.rule_id: r.outcome for r in result["flags"] if r.document_id == "good"}
    assert len(got) == 11 and got["negative_fcf"] == "fired" and got["earnings_quality"] == "fired"
    assert got["revenue_decline"] == "clear" and got["low_confidence_kpi"] == "clear"
    message = next(r.message for r in result["flags"] if r.document_id == "good" and r.rule_id == "earnings_quality")
    assert message == "Operating cash flow covers less than 70% of net income (OCF/NI 0.6)."


def test_two_columns_for_a_year_leave_no_periods(result):
    assert not any(r.document_id == "twice" for r in result["figures"])
    flags = [r for r in result["flags"] if r.document_id == "twice"]
    assert len(flags) == 11 and {r.outcome for r in flags} == {"not_evaluated"}
    assert "both resolve to 2024" in result["without_periods"][0].na.detail


def test_claims(result):
    # "Net sales", "Sales" and the bare "Total" under the heading "Sales": "total sales" is no alias, so two rows claim revenue
    assert [(r.document_id, r.concept) for r in result["conflicts"]] == [("totals", "revenue")]
    lost = value(result["figures"], "totals", "revenue", 2024, "concept")
    assert lost.value is None and lost.na.reason == "conflict"
    bad = value(result["figures"], "totals", "net_income", 2024, "concept")
    assert bad.na.root_reason == "unparseable" and value(result["figures"], "totals", "net_income", 2023, "concept").value == 1_000_000
    assert {r.concept for r in result["unmapped"] if r.document_id == "good"} == {"ebitda", "free_cash_flow", "total_debt"}
