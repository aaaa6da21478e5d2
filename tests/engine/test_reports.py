"""Rows of reports and of the evaluation's report, worked out by hand."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from statera.operators import accuracy_report, mapping, reports
from statera.plans.analysis import analyse

from .test_analysis import ROWS, frames


@pytest.fixture(scope="module")
def analysed(spark):
    totals = dict(ROWS, income=(["2024", "2023"], [("Net sales", "1,000", "800"), ("Total", "9", "8")]))
    rows, heads = frames(spark, {"good": ROWS, "noted": totals})
    return rows, heads, analyse(rows, heads)


def test_value_rows(analysed):
    rows, _, result = analysed
    got = {(r.document_id, r.concept, r.period): r for r in reports.value_rows(result.figures, rows).collect()}
    revenue, debt = got[("good", "Revenue", 2024)], got[("good", "Total debt", 2023)]
    assert (revenue.page, revenue.source_row, revenue.ref_id) == ("0", "Net sales", "page_0_table_0_row_0") and revenue.value.startswith("$1,000,000,000.00")
    assert debt.page == "" and debt.ref_id == "" and debt.source_row.startswith("derived from ") and debt.how_found == "derived"


def test_trends_checks_flags_and_warnings(analysed):
    _, _, result = analysed
    trends = {(r.document_id, r.subject, r.to_year): r for r in reports.trend_rows(result.changes).collect()}
    assert (trends[("good", "Revenue", 2024)].change, trends[("good", "Revenue", 2024)].reads_as) == ("+25.0%", "positive")
    found = reports.reconciliation_rows(result.checks).where("document_id = 'good' AND period = 2024").collect()
    assert {r.check: r.status for r in found}["Assets equal liabilities plus equity"] == "passed"
    assert {r.document_id: r.warnings for r in reports.warning_counts(result.checks).collect()}["good"] == 0
    assert {"Revenue decline", "High leverage"} <= {r.rule for r in reports.red_flag_rows(result.flags).collect()}
    metrics = {(r.metric, r.period): r.value for r in reports.history_metric_rows(result.metrics).where("document_id = 'good'").collect()}
    assert metrics[("Net margin", 2024)] == "10.0%" and metrics[("Current ratio", 2024)] == "2.00x"


def test_provenance(spark, analysed):
    rows, heads, result = analysed
    columns, _ = mapping.detect_periods(heads)
    tokens = rows.select("document_id", "kind", "ref_id", "scale", "currency", F.posexplode("cells").alias("_p", "token")).withColumn("col", F.col("_p") + 1)
    cells = mapping.normalised_cells(tokens.join(columns, ["document_id", "kind", "col"]))
    wanted = spark.createDataFrame([("good", "page_0_table_0_row_0"), ("good", "page_9_table_9_row_9")], "document_id string, ref_id string")
    row = reports.provenance(wanted, result.figures, cells, rows, result.notes).collect()
    assert [(r.page, r.row_idx, r.col, r.row_label, r.raw_text, r.concept, r.period, r.notes) for r in row] == [(0, 0, 1, "Net sales", "1,000", "revenue", 2024, [])]


def test_notices(spark):
    basis = spark.createDataFrame([("a", "consolidated"), ("b", "unknown")], "document_id string, basis string")
    bad = spark.createDataFrame([("a", ("ambiguous", "two years", [], "ambiguous", "two years"))], "document_id string, na struct<reason:string,detail:string,refs:array<string>,root_reason:string,root_detail:string>")
    got = sorted((r.document_id, r.level, r.text[:8]) for r in reports.notices(basis, bad).collect())
    assert got == [("a", "error", "Periods:"), ("a", "info", "Figures "), ("b", "error", "The basi")]


def test_filings_by_local_file_or_date(spark):
    companies = spark.createDataFrame([("A", "x/apple_10k_2023.pdf"), ("B", "b_fy24.PDF"), ("C", ""), ("D", "nothing.pdf"), ("E", None)], "ticker string, local_pdf string")
    rows = [("A", "a1", date(2024, 1, 1), date(2023, 9, 30)), ("A", "a2", date(2023, 1, 1), date(2022, 9, 30)), ("B", "b1", date(2024, 9, 1), date(2024, 6, 30)), ("B", "b2", date(2024, 12, 1), date(2024, 9, 30)),
            ("C", "c1", date(2023, 5, 1), date(2023, 1, 1)), ("C", "c2", date(2025, 5, 1), date(2025, 1, 1)), ("D", "d1", date(2023, 5, 1), date(2023, 1, 1))]
    filings = spark.createDataFrame(rows, "ticker string, accession string, filed date, report_date date")
    got = {r.ticker: (r.accession, r.error) for r in accuracy_report.selected_filings(companies, filings, "2024-12-31").collect()}
    assert got["A"] == ("a1", None) and got["C"] == ("c1", None)
    assert got["B"][0] is None and got["B"][1].startswith("2 filings") and "no fiscal year" in got["D"][1] and got["E"] == (None, "no filing by 2024-12-31")


def test_scopes_and_report(spark):
    rows = [(t, "revenue", 2024, o, "value" if o == "wrong" else None, t, b) for t, o, b in [("AAPL", "correct", "general"), ("JPM", "wrong", "financial"), ("X|Y", "wrong", "general")]]
    outcomes = spark.createDataFrame(rows, "document_id string, concept string, end_year int, outcome string, sub string, ticker string, bucket string")
    companies = spark.createDataFrame([("AAPL", "ok", None), ("BAD", "error", "no tables")], "ticker string, status string, error string")
    held = outcomes.select("ticker", accuracy_report.split(F.col("ticker")).alias("s")).where("s = 'holdout'").select("ticker")
    found = {r.part: (r.correct, r.wrong) for r in accuracy_report.scopes(outcomes, held).where("scope = 'all'").collect()}
    hidden = {r.ticker for r in held.collect()}
    assert found["all"] == (sum(o == "correct" for t, _, _, o, *_ in rows if t not in hidden), sum(o == "wrong" for t, _, _, o, *_ in rows if t not in hidden))
    assert ("exposed" in found) == bool(hidden)
    lines = [(r.section, r.line) for r in accuracy_report.report(companies, outcomes, held.limit(0)).orderBy("section", "position").collect()]
    assert ("errors", "| BAD | no tables |") in lines and ("wrong", r"| X\|Y | revenue | 2024 | value |") in lines
    some = accuracy_report.filtered(spark.createDataFrame([("AAPL", "general"), ("JPM", "financial")], "ticker string, bucket string"), bucket="financial")
    assert [r.ticker for r in some.collect()] == ["JPM"]
    assert [r.ticker for r in accuracy_report.filtered(some, "dev", "general", ["JPM"]).collect()] == ["JPM"]
