"""Whole invented reports, from pages, tables and words to figures and reasons."""

from decimal import Decimal

import pytest

from statera.operators import locate
from statera.plans.analysis import analyse_reports

HEAD = ["", "2024", "2023"]
INCOME = [["Net sales", "1,000", "800"], ["Cost of sales", "(600)", "(500)"], ["Gross profit", "400", "300"], ["Operating income", "150", "90"], ["Net income", "100", "60"]]
BALANCE = [["Total current assets", "300", "250"], ["Total assets", "900", "700"], ["Total current liabilities", "150", "125"], ["Total liabilities", "500", "400"], ["Total stockholders' equity", "400", "300"]]
CASH = [["Net cash provided by operating activities", "60", "90"], ["Purchases of property and equipment", "(70)", "(30)"], ["Cash at end of year", "30", "40"]]
KINDS = {"income": ("Consolidated Statements of Operations", INCOME), "balance": ("Consolidated Balance Sheets", BALANCE), "cash_flow": ("Consolidated Statements of Cash Flows", CASH)}
PLACES = [10.0, 300.0, 400.0]


def report(caption="(In millions of dollars)", first="Annual report", heads=HEAD):
    """Pages 1 to 4 and one ruled table on each but the first."""
    pages, tables = {1: first}, []
    for p, (title, body) in enumerate(KINDS.values(), 2):
        pages[p] = f"{title}\n{caption}\n{' '.join(x for x in heads if x)}\n" + "\n".join(" ".join(r) for r in body)
        tables.append((p, 0, [heads, *body], PLACES))
    return pages, tables


def words_of(page, body, top=100):
    """The same table set without ruling."""
    out = [(page, y, x - 20.0, float(x), top - 20.0) for y, x in zip(HEAD[1:], (300, 400), strict=True)]
    for i, (label, *values) in enumerate(body):
        out += [(page, w, 10.0 + 40 * j, 40.0 + 40 * j, top + 12.0 * i) for j, w in enumerate(label.split())]
        out += [(page, v, x - 30.0, float(x), top + 12.0 * i) for v, x in zip(values, (300, 400), strict=True)]
    return out


def documents():
    out = {"plain": report()}
    pages, tables = report()
    rest = [["Net sales", "7", "7"]]
    # the balance sheet goes on over two pages more, beside an unrelated table; a new heading ends it
    pages = {**{p: t for p, t in pages.items() if p != 4}, 4: "continued\nother", 5: "notes", 6: pages[4]}
    tables = [
        tables[0], (3, 0, [HEAD, *BALANCE[:2]], PLACES), (4, 0, [["Region", "x"], ["North", "1"]], [10.0, 90.0]), (4, 1, [HEAD, BALANCE[2]], [30.0, 303.0, 398.0]),
        (5, 0, BALANCE[3:], PLACES), (6, 0, [HEAD, *CASH], PLACES), (7, 0, rest, [10.0, 360.0, 460.0]),
    ]
    out["continued"] = ({**pages, 7: "a table at other places"}, tables)
    out["page scale"] = ({p: f"{t}\nall amounts in thousands of dollars" for p, t in report("")[0].items()}, report()[1])
    out["first page's scale"] = report("", "Annual report, in billions of US dollars")
    out["no scale"] = report("", "Annual report of a company that reports in dollars")
    out["no currency"] = report("(In millions)")
    pages, tables = report()
    out["two currencies"] = ({**pages, 2: pages[2].replace("Operations", "Operations\nsome in ₹, as stated below\n")}, tables)
    out["own scale"] = report("", "A report in dollars")
    out["own scale"][1][0] = (2, 0, [HEAD, ["Net sales", "1,000", "800"], ["Other", "x", "3 million"], *INCOME[1:]], PLACES)
    pages, tables = report()
    out["words"] = (pages, [(2, 0, [["one", "cell"]], [0.0, 1.0]), *tables[1:]])
    pages, tables = report()
    out["bare"] = (pages, [(2, 0, INCOME, PLACES), *tables[1:]])
    out["twice"] = report(heads=["", "2024", "FY 2023-24"])
    pages, tables = report()
    by_date, by_year = ["", "2026", "2025"], ["", "2025", "2024"]
    tables = [(p, i, [by_year if p == 2 else by_date, *rows[1:]], x) for p, i, rows, x in tables]
    pages = {p: t.replace("2024 2023", "Fiscal Fiscal\n2025 2024" if p == 2 else "February 1, February 2,\n2026 2025") for p, t in pages.items()}
    bound = 'Our fiscal year ended February 1, 2026 ("fiscal 2025"). Fiscal 2024 is the year ended February 2, 2025.'
    out["fiscal"] = ({**pages, 9: bound}, tables)
    out["unbound"] = ({**pages, 9: bound.split(" Fiscal")[0]}, tables)
    out["nothing"] = ({1: "no statement here"}, [])
    return out


@pytest.fixture(scope="module")
def frames(spark):
    docs = documents()
    pages = spark.createDataFrame([(d, p, t) for d, (texts, _) in docs.items() for p, t in texts.items()], "document_id string, page int, text string")
    raw = spark.createDataFrame([(d, p, i, rows, x) for d, (_, tables) in docs.items() for p, i, rows, x in tables], "document_id string, page int, table_idx int, rows array<array<string>>, col_x array<double>")
    words = spark.createDataFrame([("words", *w) for w in words_of(2, INCOME)], "document_id string, page int, text string, x0 double, x1 double, top double")
    return pages, raw, words


@pytest.fixture(scope="module")
def result(frames):
    out = analyse_reports(*frames)
    return {name: getattr(out, name).collect() for name in ("figures", "flags", "statements", "without_periods", "unmapped")}


def figure(result, doc, concept, year=2024):
    found = [r for r in result["figures"] if (r.document_id, r.concept, r.end_year) == (doc, concept, year)]
    return found[0].value if found else None


def status(result, doc, kind="income"):
    return next(r for r in result["statements"] if (r.document_id, r.kind) == (doc, kind))


def test_a_report_in_one_call(result):
    assert figure(result, "plain", "revenue") == Decimal(1_000_000_000) and figure(result, "plain", "free_cash_flow", 2023) == Decimal(60_000_000)
    s = status(result, "plain")
    assert (s.basis, s.table_id, s.scale, s.scale_source, s.currency, s.na) == ("consolidated", "page_2_table_0", "million", "table", "USD", None)


def test_tables_go_on_over_pages(frames, result):
    assert figure(result, "continued", "equity") == Decimal(400_000_000) and figure(result, "continued", "current_liabilities") == Decimal(150_000_000)
    assert list(status(result, "continued", "balance").pages) == [3, 4, 5]
    assert status(result, "continued", "cash_flow").table_id == "page_6_table_0" and figure(result, "continued", "revenue") == Decimal(1_000_000_000)
    pages, raw, _ = frames
    rows = locate.whole_tables(locate.table_rows(raw.where("document_id = 'continued'")), pages).where("table_id = 'page_3_table_0' AND row_idx IS NOT NULL").orderBy("row_idx").collect()
    assert [(r.ref_id, r.row_page) for r in rows] == [("page_3_table_0_row_0", 3), ("page_3_table_0_row_1", 3), ("page_4_table_1_row_0", 4), ("page_5_table_0_row_0", 5), ("page_5_table_0_row_1", 5)]


def test_levels_of_scale(result):
    assert figure(result, "page scale", "revenue") == Decimal(1_000_000) and status(result, "page scale").scale_source == "statement"
    assert figure(result, "first page's scale", "revenue") == Decimal(1_000_000_000_000) and status(result, "first page's scale").scale_source == "document"


@pytest.mark.parametrize("doc, reason, said", [("no scale", "ambiguous", "no scale phrase"), ("no currency", "ambiguous", "no currency"), ("two currencies", "conflict", "two currencies"), ("twice", "ambiguous", "periods could not")])
def test_statements_say_why_they_give_no_figures(result, doc, reason, said):
    s = status(result, doc)
    assert s.na.reason == reason and said in s.na.detail and s.currency is None
    assert figure(result, doc, "revenue") is None


def test_a_withheld_statement_leaves_the_others(result):
    assert figure(result, "two currencies", "total_assets") == Decimal(900_000_000) and status(result, "two currencies", "balance").na is None
    lost = next(r for r in result["figures"] if (r.document_id, r.concept, r.end_year) == ("two currencies", "revenue", 2024))
    assert lost.na.reason == "missing_input"  # the statement's own reason goes no further


def test_a_cell_with_a_scale_keeps_its_statement(result):
    assert status(result, "own scale").na is None and figure(result, "own scale", "revenue") is None
    found = next(r for r in result["figures"] if (r.document_id, r.concept, r.end_year) == ("own scale", "revenue", 2024))
    assert found.na.root_reason == "ambiguous" and "no scale stated at cell" in found.na.root_detail


def test_words_stand_in_for_a_table_that_is_none(result):
    assert status(result, "words").table_id == "page_2_table_1" and figure(result, "words", "gross_profit", 2023) == Decimal(300_000_000)
    assert status(result, "words", "balance").table_id == "page_3_table_0"


def test_documents_without_periods_have_flags_only(result):
    why = {r.document_id: r.na for r in result["without_periods"]}
    assert set(why) == {"bare", "twice", "unbound", "nothing"}
    assert why["bare"].detail == "income statement has no header row to read periods from" and why["nothing"] is None
    for doc in why:
        assert {r.outcome for r in result["flags"] if r.document_id == doc} == {"not_evaluated"}
        assert figure(result, doc, "total_assets") is None
    assert status(result, "nothing").na.reason == "not_located"


def test_dates_are_read_as_fiscal_years(result):
    assert figure(result, "fiscal", "revenue", 2025) == Decimal(1_000_000_000) and figure(result, "fiscal", "total_assets", 2025) == Decimal(900_000_000)
    assert figure(result, "fiscal", "total_assets", 2026) is None
    assert "no sentence binds February 2, 2025" in next(r.na.detail for r in result["without_periods"] if r.document_id == "unbound")


def test_no_reports(frames):
    pages, raw, words = (f.limit(0) for f in frames)
    out = analyse_reports(pages, raw, words)
    assert out.figures.count() == out.flags.count() == out.statements.count() == 0


def test_units_are_those_of_most_cells(spark):
    from statera.operators import views

    rows = [("a", "million", "USD", 3), ("a", "crore", "INR", 1), ("a", "million", "USD", 2), ("tie", "lakh", "INR", 2), ("tie", "crore", "USD", 1), ("tie", "lakh", "INR", 4), ("tie", "crore", "USD", 3), ("one", "unit", "USD", 0)]
    got = views.units(spark.createDataFrame(rows, "document_id string, scale string, currency string, place int")).collect()
    assert {(r.document_id, r.scale, r.label) for r in got} == {("a", "million", "INR million"), ("tie", "crore", "USD crore"), ("one", "unit", "USD")}


def test_amounts_in_the_report_s_own_scale(frames):
    got = {(r.document_id, r.concept, r.end_year): (str(r.amount), r.label, r.text) for r in analyse_reports(*frames).amounts.collect()}
    assert got[("plain", "revenue", 2024)] == ("1000.00", "USD million", "$1,000.00 million")
    assert got[("first page's scale", "capex", 2023)] == ("-30.00", "USD billion", "$-30.00 billion")
