"""Closed vocabularies. All names, labels, aliases, templates and limits here are fixed values that results must equal."""

from __future__ import annotations

INCOME, BALANCE, CASH_FLOW = "income", "balance", "cash_flow"
KINDS = [INCOME, BALANCE, CASH_FLOW]

#: Concept to the statement it may come from, in the order of the vocabulary.
CONCEPTS = {
    "revenue": INCOME, "gross_profit": INCOME, "cogs": INCOME, "operating_income": INCOME, "d_and_a": INCOME, "ebitda": INCOME, "net_income": INCOME,
    "total_assets": BALANCE, "current_assets": BALANCE, "cash": BALANCE, "total_liabilities": BALANCE, "current_liabilities": BALANCE,
    "short_term_borrowings": BALANCE, "long_term_borrowings": BALANCE, "total_debt": BALANCE, "equity": BALANCE,
    "operating_cash_flow": CASH_FLOW, "capex": CASH_FLOW, "free_cash_flow": CASH_FLOW,
}

#: Metrics and their units.
METRICS = {
    "gross_margin": "percent", "operating_margin": "percent", "net_margin": "percent", "ebitda_margin": "percent", "current_ratio": "ratio",
    "debt_to_equity": "ratio", "roa": "percent", "roe": "percent", "ocf_to_net_income": "ratio",
}

#: Subjects of changes, and whether a rise is good (1) or bad (-1).
CHANGES = {
    "revenue": 1, "gross_profit": 1, "operating_income": 1, "net_income": 1, "ebitda": 1, "operating_cash_flow": 1, "free_cash_flow": 1,
    "total_debt": -1, "cash": 1, "equity": 1, "gross_margin": 1, "operating_margin": 1, "net_margin": 1, "current_ratio": 1,
    "debt_to_equity": -1, "roa": 1, "roe": 1,
}

RANKS = ["low", "medium", "high"]

#: Scales in the order in which a text is searched for them, with their multipliers.
SCALES = {
    "crore": (r"\bcrores?\b", 10_000_000),
    "lakh": (r"\b(?:lakhs?|lacs?)\b", 100_000),
    "million": (r"\bmillions?\b|\bmn\b", 1_000_000),
    "billion": (r"\bbillions?\b|\bbn\b", 1_000_000_000),
    "thousand": (r"\bthousands?\b|[’']000\b|\b000s\b", 1_000),
}
#: Currencies in the order in which a text is searched for them, and what implies one.
CURRENCIES = {"INR": r"₹|\brs\.?(?=\s|$|\))|\binr\b|\brupees?\b", "USD": r"\$|\busd\b|\bu\.?s\.? ?dollars?\b|\bdollars?\b"}
IMPLIED = {"INR": r"\b(?:crores?|lakhs?|lacs?|ind\s*as)\b", "USD": r"\bform\s+10-k\b|\b10-k\b|\bus-?gaap\b"}

#: Labels in normalised form; canonical first, then Indian, then US aliases.
CANONICAL = {
    "revenue": ["revenue", "revenues", "total revenue", "total revenues"],
    "gross_profit": ["gross profit"],
    "cogs": ["cost of goods sold"],
    "operating_income": ["operating income", "operating profit"],
    "d_and_a": ["depreciation and amortization", "depreciation and amortisation"],
    "ebitda": ["ebitda"],
    "net_income": ["net income", "net profit"],
    "total_assets": ["total assets"],
    "current_assets": ["total current assets", "current assets"],
    "cash": ["cash and cash equivalents"],
    "total_liabilities": ["total liabilities"],
    "current_liabilities": ["total current liabilities", "current liabilities"],
    "short_term_borrowings": ["short term borrowings"],
    "long_term_borrowings": ["long term borrowings"],
    "total_debt": ["total debt", "total borrowings"],
    "equity": ["total equity"],
    "operating_cash_flow": ["net cash from operating activities", "operating cash flow"],
    "capex": ["capital expenditure", "capital expenditures"],
    "free_cash_flow": ["free cash flow"],
}
INDIAN = {
    "revenue": ["revenue from operations", "income from operations", "revenue from operations net"],
    "cogs": ["cost of materials consumed", "cost of goods sold and services rendered"],
    "operating_income": ["profit from operations", "profit before finance costs and tax"],
    "d_and_a": ["depreciation and amortisation expense", "depreciation and amortization expense", "depreciation amortisation and impairment expense"],
    "net_income": ["profit for the year", "profit for the period", "profit after tax"],
    "cash": ["cash and bank balances"],
    "short_term_borrowings": ["current borrowings"],
    "long_term_borrowings": ["non current borrowings"],
    "equity": ["equity attributable to owners of the parent", "total equity attributable to owners"],
    "operating_cash_flow": [
        "net cash generated from operating activities", "net cash flow from operating activities",
        "net cash flows from operating activities", "net cash generated from operations",
    ],
    "capex": [
        "purchase of property plant and equipment", "payments for property plant and equipment",
        "purchase of property plant and equipment including capital work in progress",
    ],
}
US = {
    "revenue": ["net sales", "total net sales", "net revenues", "net revenue", "sales", "total net sales and revenues"],
    "cogs": [
        "cost of sales", "cost of revenues", "cost of revenue", "cost of products sold", "total cost of revenue",
        "total cost of revenues", "total cost of sales", "total cost of products and services sold",
    ],
    "gross_profit": ["gross margin"],
    "operating_income": ["income from operations", "operating income loss"],
    "d_and_a": ["depreciation depletion and amortization", "depreciation and amortization"],
    "net_income": ["net earnings", "net income loss", "net earnings loss"],
    "short_term_borrowings": ["short term debt", "notes payable"],
    "long_term_borrowings": ["long term debt", "long term debt net of current portion"],
    "equity": ["total stockholders equity", "total shareholders equity", "total stockholders equity attributable to parent"],
    "operating_cash_flow": [
        "net cash provided by operating activities", "cash provided by operating activities", "net cash provided by used in operating activities",
        "cash generated by operating activities", "net cash flows from operating activities", "net cash from operations",
    ],
    "capex": [
        "purchases of property and equipment", "purchases of property plant and equipment", "purchase of property and equipment",
        "additions to property and equipment", "payments for acquisition of property plant and equipment", "purchases of property plant and equipment net",
    ],
}
#: Labels that must not become the concept.
BLOCKED = {
    "revenue": ["total income", "other income", "total revenue and other income"],
    "total_liabilities": ["total current liabilities", "total non current liabilities", "total equity and liabilities"],
    "cash": [
        "cash and cash equivalents at the end of the year", "cash and cash equivalents at end of period",
        "cash and cash equivalents at the end of the period", "cash and cash equivalents at the beginning of the year",
    ],
    "equity": ["total equity and liabilities", "total liabilities and stockholders equity"],
    "operating_income": ["profit before tax", "income before income taxes"],
    "net_income": ["profit before tax", "income before income taxes"],
}


def aliases() -> list[tuple[str, str, str, str, int]]:
    """(label, statement, concept, how it was matched, precedence), the first for each label and statement."""
    out: dict[tuple[str, str], tuple[str, str, str, str, int]] = {}
    for table, extraction in ((CANONICAL, "exact_match"), (INDIAN, "synonym_match"), (US, "synonym_match")):
        for concept, labels in table.items():
            for label in labels:
                out.setdefault((label, CONCEPTS[concept]), (label, CONCEPTS[concept], concept, extraction, len(out)))
    return list(out.values())


#: Rules with severity and messages, in order.
RULES = {
    "revenue_decline": ("warning", "Revenue fell year over year ({detail}).", "Revenue did not fall year over year."),
    "margin_compression": ("warning", "Margin compressed more than 200 bps ({detail}).", "No margin compression beyond 200 bps."),
    "leverage_increase": ("warning", "Debt-to-equity rose more than 0.25 and exceeds 1.0 ({detail}).", "No material leverage increase."),
    "high_leverage": ("critical", "Debt-to-equity above 2.0 ({detail}).", "Debt-to-equity at or below 2.0."),
    "negative_fcf": ("warning", "Free cash flow is negative ({detail}).", "Free cash flow is not negative."),
    "negative_ocf": ("critical", "Operating cash flow is negative ({detail}).", "Operating cash flow is not negative."),
    "weak_liquidity": ("warning", "Current ratio below 1.0 ({detail}).", "Current ratio at or above 1.0."),
    "earnings_quality": ("warning", "Operating cash flow covers less than 70% of net income ({detail}).", "Operating cash flow adequately backs net income."),
    "reconciliation_warning": ("warning", "A reconciliation check is outside tolerance ({detail}).", "All reconciliation checks that could run passed."),
    "low_confidence_kpi": ("info", "A headline KPI is not deterministically sourced ({detail}).", "Revenue and net income are deterministically sourced."),
    "implausible_magnitude": ("info", "A figure is implausible relative to the rest of the report ({detail}).", "No figure is implausibly large relative to the others."),
}
#: Checks and how their detail begins.
CHECKS = {
    "assets_equal_liabilities_plus_equity": "assets vs liabilities + equity",
    "gross_profit_equals_revenue_minus_cogs": "gross profit vs revenue - |cogs|",
    "fcf_equals_ocf_minus_capex": "fcf vs ocf - |capex|",
}
TOLERANCE = "0.005"
