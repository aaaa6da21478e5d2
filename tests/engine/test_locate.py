"""Statements found among the tables of invented reports."""

import pytest

from statera.operators import fiscal, locate

INCOME = [["", "2024", "2023"], ["Net sales", "1,000", "800"], ["Cost of sales", "600", "500"], ["Profit", "100", "60"]]
BALANCE = [["", "2024", "2023"], ["Total assets", "900", "700"], ["Total liabilities", "500", "400"], ["Total equity", "400", "300"]]
CASH = [["", "2024", "2023"], ["Operating activities", "60", "90"], ["Net cash", "10", "20"]]
NOTE = [["", "2024", "2023"], ["Widgets", "1", "2"], ["Gadgets", "3", "4"]]
DENSE = "1 2 3 4 5 6 7 8 9 10 net cash"
COVER = "Securities and Exchange Commission\nWashington, D.C. 20549\nForm 10-K"


@pytest.fixture
def frames(spark):
    def make(documents):
        pages = [(d, p, text) for d, (texts, _) in documents.items() for p, text in texts.items()]
        raw = [(d, p, i, rows) for d, (_, tables) in documents.items() for p, i, rows in tables]
        return (
            spark.createDataFrame(raw, "document_id string, page int, table_idx int, rows array<array<string>>"),
            spark.createDataFrame(pages, "document_id string, page int, text string"),
        )

    return make


def located(raw, pages):
    return {(r.document_id, r.kind): (r.basis, r.table_id, r.na is None) for r in locate.statements(raw, pages).collect()}


def test_consolidated_pages_win(frames):
    texts = {1: "Standalone Balance Sheet", 2: "Consolidated Balance Sheet\nAs at 2024", 3: "Consolidated Statement of Profit and Loss", 40: DENSE}
    got = located(*frames({"a": (texts, [(1, 0, BALANCE), (2, 0, BALANCE), (3, 0, INCOME), (40, 0, CASH)])}))
    assert got == {("a", "balance"): ("consolidated", "page_2_table_0", True), ("a", "income"): ("consolidated", "page_3_table_0", True), ("a", "cash_flow"): ("consolidated", "page_40_table_0", True)}


def test_basis_of_unprefixed_and_of_none(frames):
    tables = [(2, 0, BALANCE)]
    got = located(*frames({
        "plain": ({1: "x", 2: "Balance Sheet"}, tables), "cover": ({1: COVER, 2: "Balance Sheet"}, tables), "alone": ({1: COVER, 2: "Standalone Balance Sheet"}, tables),
        "none": ({1: "x", 2: "no heading"}, tables),
    }))
    assert {d: b for (d, k), (b, _, _) in got.items() if k == "balance"} == {"plain": "standalone_fallback", "cover": "consolidated", "alone": "standalone_fallback", "none": "unknown"}
    assert [x for (d, k), (_, x, _) in got.items() if d == "none"] == [None] * 3


def test_headings_and_tables_of_a_page(frames):
    """As many headings as tables: in order. Otherwise the better table wins."""
    raw, pages = frames({"a": ({1: "Balance Sheet\nIncome Statement"}, [(1, 0, BALANCE), (1, 1, INCOME)]), "b": ({1: "Balance Sheet"}, [(1, 0, NOTE), (1, 1, BALANCE)])})
    tables = locate.built(locate.table_rows(raw))
    pairs = {(r.document_id, r.kind, r.table_id) for r in locate.anchored(tables, pages).collect()}
    assert pairs == {("a", "balance", "page_1_table_0"), ("a", "income", "page_1_table_1"), ("b", "balance", "page_1_table_0"), ("b", "balance", "page_1_table_1")}
    assert located(raw, pages)[("b", "balance")][1] == "page_1_table_1"


def test_fallback_needs_a_dense_page_without_headings(frames):
    texts = {1: DENSE, 3: "Balance Sheet\n" + DENSE, 5: "few words"}  # apart, or the tables would continue each other
    got = located(*frames({"a": (texts, [(1, 0, CASH), (1, 1, NOTE), (5, 0, INCOME), (3, 0, BALANCE)])}))
    assert got[("a", "cash_flow")][1] == "page_1_table_0" and got[("a", "income")][1] is None and got[("a", "balance")][1] == "page_3_table_0"


def test_rows_captions_and_usable_tables(frames):
    rows = [[None, " "], *INCOME, ["", "", ""]]
    text = "Consolidated Income Statement\n(in millions)\n 2024 2023\nNet sales 1,000 800".replace("\n 2024", "\n2024")
    raw, pages = frames({"a": ({7: text}, [(7, 2, rows)])})
    each = locate.table_rows(raw).orderBy("row_idx").collect()
    assert [(r.ref_id, r.label) for r in each] == [(None, ""), ("page_7_table_2_row_0", "Net sales"), ("page_7_table_2_row_1", "Cost of sales"), ("page_7_table_2_row_2", "Profit")]
    table = locate.built(locate.table_rows(raw))
    row = table.select("*", locate.is_usable(table["header"], table["n_rows"], table["columns"]).alias("u")).collect()[0]
    assert row.header == ["", "2024", "2023"] and row.n_columns == 3 and row.columns == [["1,000", "600", "100"], ["800", "500", "60"]] and row.u
    assert [r.caption for r in locate.captions(table, pages).collect()] == ["(in millions)"]
    assert [r.headings for r in locate.anchor_lines(pages).collect()] == [["consolidated income statement"]]


@pytest.fixture
def fiscal_report(spark):
    def make(sentence, balance_days="February 1, February 2,"):
        pages = [("a", 1, "Fiscal Fiscal\n2025 2024"), ("a", 2, f"{balance_days}\n2026 2025"), ("a", 3, sentence)]
        heads = [("a", "income", 1, 1, "2025"), ("a", "income", 1, 2, "2024"), ("a", "balance", 2, 1, "2026"), ("a", "balance", 2, 2, "2025")]
        columns = [("a", k, c, int(y), y) for _, k, _, c, y in heads]
        out, bad = fiscal.reconciled(
            spark.createDataFrame(columns, "document_id string, kind string, col int, end_year int, label string"),
            spark.createDataFrame(heads, "document_id string, kind string, page int, col int, label string"),
            spark.createDataFrame(pages, "document_id string, page int, text string"),
        )
        return {(r.kind, r.col): r.end_year for r in out.collect()}, [r.na.detail for r in bad.collect()]

    return make


BOTH = 'Our fiscal year ended February 1, 2026 ("fiscal 2025"). Fiscal 2024 is the year ended February 2, 2025.'


def test_dates_become_fiscal_years(fiscal_report):
    assert fiscal_report(BOTH) == ({("income", 1): 2025, ("income", 2): 2024, ("balance", 1): 2025, ("balance", 2): 2024}, [])


def test_what_nothing_binds_is_ambiguous(fiscal_report):
    columns, why = fiscal_report('Our fiscal year ended February 1, 2026 ("fiscal 2025").')
    assert columns == {} and "no sentence binds February 2, 2025" in why[0]
    columns, why = fiscal_report(BOTH + " Fiscal 2023 ended February 1, 2026.")
    assert columns == {} and "conflicting" in why[0]


def test_headers_of_one_kind_are_untouched(fiscal_report):
    columns, why = fiscal_report(BOTH, "Fiscal Fiscal")
    assert columns[("balance", 1)] == 2026 and not why
