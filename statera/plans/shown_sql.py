"""SQL of queries that return what readers see: messages, cards, chart values; and of pages, columns and compared evaluations."""

from __future__ import annotations

from statera.functions.vocabulary import CHANGES, METRICS, RULES
from statera.operators import evaluation, layout, views
from statera.plans.statement_queries import _FLAGS, _ROWS
from statera.plans.text_queries import _PAGES_SQL, _SCORE_SQL, _SHARE, _WORDS_SQL

#: Of each ratio: when it is absent, the root cause and its text.
_LOST = {
    **{m: [("revenue = 0", "division_by_zero", f"'{m} ' || y || ': revenue is zero'")] for m in METRICS if m.endswith("margin")},
    "current_ratio": [
        ("current_assets IS NULL", "missing_input", "'current_assets not mapped for ' || y"),
        ("current_liabilities = 0", "division_by_zero", "'current_ratio ' || y || ': current_liabilities is zero'"),
    ],
    "debt_to_equity": [
        ("equity < 0", "ambiguous", "'debt_to_equity ' || y || ': equity is negative; ratio not meaningful'"),
        ("short_term_borrowings IS NULL", "missing_input", "'short_term_borrowings not mapped for ' || y"),
        ("long_term_borrowings IS NULL", "missing_input", "'long_term_borrowings not mapped for ' || y"),
        ("n = 11", "conflict", "'total_debt ' || y || ': inputs in different currencies'"),
        ("equity = 0", "division_by_zero", "'debt_to_equity ' || y || ': equity is zero'"),
    ],
    **{
        m: [
            (f"{c} IS NULL", "missing_input", f"'{c} not mapped for ' || y"),
            ("p IS NULL", "missing_input", f"'{m} ' || y || ': prior-period {c} required for average'"),
            (f"p_{short} IS NULL", "missing_input", f"'{c} not mapped for ' || p"),
            (f"mean_{short} < 0", "ambiguous", f"'{m} ' || y || ': average {c} is negative; ratio not meaningful'"),
            (f"mean_{short} = 0", "division_by_zero", f"'{m} ' || y || ': {c} is zero'"),
        ]
        for m, c, short in (("roa", "total_assets", "assets"), ("roe", "equity", "equity"))
    },
    "ocf_to_net_income": [("net_income <= 0", "ambiguous", "'ocf_to_net_income ' || y || ': net income is not positive; ratio not meaningful'")],
}


def _lost(name: str, shown: bool) -> str:
    """Why a ratio is absent: the text alone, or as tables show it."""
    said = lambda why, text: f"'N/A - {why.replace('_', ' ')}: ' || {text}" if shown else text
    return "CASE " + " ".join(f"WHEN {when} THEN {said(why, text)}" for when, why, text in _LOST[name]) + " END"


def _newest(columns: str) -> str:
    return f"SELECT {columns} FROM rows QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY y DESC) = 1"


def _ratio_text(name: str) -> str:
    return f"format('{{:.1f}}%', round_even({name} * 100, 1))" if METRICS[name] == "percent" else f"format('{{:.2f}}x', round_even({name}, 2))"


def _card(name: str) -> str:
    if name not in CHANGES:
        delta = "''"
    else:
        moved = f"round_even(({name} - b_{name}) / abs(b_{name}) * 100, 1)"
        delta = f"CASE WHEN {name} IS NULL OR b_{name} IS NULL THEN '' WHEN b_{name} = 0 THEN 'n/a' ELSE CASE WHEN {moved} > 0 THEN '+' ELSE '' END || format('{{:.1f}}%', {moved}) END"
    return f"SELECT document_id, '{name}' AS name, coalesce({_ratio_text(name)}, 'N/A') AS value, {delta} AS delta FROM newest"


_BEFORE = ", ".join(f"lag({m}) OVER w AS b_{m}" for m in views.CARDS if m in CHANGES)
_CARDS_SQL = f"""WITH {_ROWS}, newest AS (SELECT *, {_BEFORE} FROM rows WINDOW w AS (PARTITION BY document_id ORDER BY y)
    QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY y DESC) = 1) """ + " UNION ALL ".join(map(_card, views.CARDS))

_METRIC_ROWS_SQL = f"WITH {_ROWS} " + " UNION ALL ".join(
    f"SELECT document_id, '{views.LABELS[m]}' AS metric, y AS period, CASE WHEN {m} IS NULL THEN 'na' ELSE 'ok' END AS status, CASE WHEN {m} IS NULL THEN {_lost(m, True)} END AS why FROM rows" for m in METRICS
)

_MARGINS_SQL = f"WITH {_ROWS} SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT document_id, y AS period, '{m}' AS series, round_even({m} * 100, 2) AS value FROM rows" for m in views.MARGINS
) + ") WHERE value IS NOT NULL"

_RECONCILED_SQL = f"""WITH {_ROWS}, newest AS ({_newest("*")}), sides AS (
        SELECT document_id, y, 'assets_equal_liabilities_plus_equity' AS name, total_assets AS l, total_liabilities + equity AS r, abs(total_assets) * 0.005 AS slack FROM newest
        UNION ALL SELECT document_id, y, 'gross_profit_equals_revenue_minus_cogs', gross_profit, revenue - abs(cogs), abs(revenue) * 0.005 FROM newest
        UNION ALL SELECT document_id, y, 'fcf_equals_ocf_minus_capex', free_cash_flow, operating_cash_flow - abs(capex), 0 FROM newest)
    SELECT document_id, y AS period, name, CASE WHEN l IS NULL OR r IS NULL THEN 'unavailable' WHEN abs(l - r) <= slack THEN 'passed' ELSE 'warning' END AS status,
        l::DOUBLE AS "left", CASE WHEN l IS NOT NULL THEN r::DOUBLE END AS "right" FROM sides"""


def _number(x: str) -> str:
    return f"CASE WHEN abs({x}) >= 1000 THEN format('{{:,.0f}}', round_even(({x})::DOUBLE, 0)) ELSE rtrim(rtrim(format('{{:.4f}}', round_even(({x})::DOUBLE, 4) + 0.0), '0'), '.') END"


def _at(*names: str, year: str = "y") -> str:
    return " || ',' || ".join(f"'{n}@' || {year}" for n in names)


#: Why debt_to_equity is absent, with the cells that say so; of a row and of the one before it.
_LEVERAGE = f"""leverage AS (SELECT *, {_lost("debt_to_equity", False)} AS why, CASE WHEN equity < 0 OR equity = 0 AND r_total_debt IS NULL THEN {_at("equity")} WHEN r_total_debt = 'conflict' THEN {_at("short_term_borrowings", "long_term_borrowings")} ELSE '' END AS why_refs FROM rows),
    told AS (SELECT leverage.*, lag(why) OVER w AS b_why, lag(why_refs) OVER w AS b_why_refs, lag(revenue) OVER w AS b_revenue, lag(gross_margin) OVER w AS b_gross, lag(operating_margin) OVER w AS b_operating,
            lag(debt_to_equity) OVER w AS b_leverage FROM leverage WINDOW w AS (PARTITION BY document_id ORDER BY y)
        QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY y DESC) = 1),
    warnings AS (SELECT document_id, end_year AS y, list(name ORDER BY place) AS names, string_agg(cells, ',' ORDER BY place) AS cells FROM (
        SELECT *, CASE name WHEN 'assets_equal_liabilities_plus_equity' THEN 0 WHEN 'gross_profit_equals_revenue_minus_cogs' THEN 1 ELSE 2 END AS place,
            CASE name WHEN 'assets_equal_liabilities_plus_equity' THEN {_at("total_assets", "total_liabilities", "equity", year="end_year")}
                WHEN 'gross_profit_equals_revenue_minus_cogs' THEN {_at("gross_profit", "revenue", "cogs", year="end_year")} ELSE 'operating_cash_flow,capex,operating_cash_flow@' || end_year || ',capex@' || end_year END AS cells
        FROM judged WHERE status = 'warning') GROUP BY ALL)"""
_LEVERAGE_REFS = "'short_term_borrowings,long_term_borrowings,' || " + _at("equity")
_PAIR = lambda c, old: f"CASE WHEN {c} <> 0 AND {old} <> 0 THEN '{c}@' || y || ',{c}@' || p END"
_SEEN = f"concat_ws(',', {_PAIR('revenue', 'b_revenue')}, CASE WHEN revenue <> 0 AND b_revenue <> 0 THEN NULL WHEN total_assets > 0 THEN 'revenue@' || y END, {_PAIR('total_assets', 'p_assets')}, CASE WHEN total_assets <> 0 AND p_assets <> 0 THEN NULL WHEN total_assets > 0 THEN 'total_assets@' || y END, {_PAIR('equity', 'p_equity')})"
#: Of each rule: the reason why it can't be evaluated and its cells; detail and cells of one that can.
_TOLD = {
    "revenue_decline": ("CASE WHEN p IS NULL THEN 'revenue change unavailable for ' || y END", "''", "'revenue change ' || (revenue - b_revenue)::DECIMAL(38,4)", _at("revenue")),
    "margin_compression": (
        "CASE WHEN p IS NULL THEN 'gross_margin change unavailable for ' || y WHEN revenue = 0 THEN 'gross_margin ' || y || ': revenue is zero' WHEN b_revenue = 0 THEN 'gross_margin ' || p || ': revenue is zero' END",
        "CASE WHEN p IS NULL THEN '' ELSE 'revenue@' || CASE WHEN revenue = 0 THEN y ELSE p END END",
        f"'gross_margin ' || {_number('gross_margin - b_gross')} || ', operating_margin ' || {_number('operating_margin - b_operating')}", _at("gross_profit", "revenue", "operating_income"),
    ),
    "leverage_increase": (
        "CASE WHEN p IS NULL THEN 'debt_to_equity change unavailable for ' || y ELSE coalesce(why, b_why) END", "CASE WHEN p IS NULL THEN '' WHEN why IS NOT NULL THEN why_refs ELSE b_why_refs END",
        f"'D/E ' || {_number('debt_to_equity')} || ', change ' || {_number('debt_to_equity - b_leverage')}", _LEVERAGE_REFS,
    ),
    "high_leverage": ("why", "why_refs", f"'debt_to_equity ' || {_number('debt_to_equity')}", _LEVERAGE_REFS),
    "negative_fcf": ("CASE WHEN capex IS NULL THEN 'capex not mapped for ' || y END", "''", f"'free_cash_flow ' || {_number('free_cash_flow')}", "'operating_cash_flow,capex'"),
    "negative_ocf": ("NULL", "''", f"'operating_cash_flow ' || {_number('operating_cash_flow')}", _at("operating_cash_flow")),
    "weak_liquidity": (_lost("current_ratio", False), f"CASE WHEN current_liabilities = 0 THEN {_at('current_liabilities')} ELSE '' END", f"'current_ratio ' || {_number('current_ratio')}", _at("current_assets", "current_liabilities")),
    "earnings_quality": (_lost("ocf_to_net_income", False), _at("net_income"), f"'OCF/NI ' || {_number('ocf_to_net_income')}", _at("operating_cash_flow", "net_income")),
    "reconciliation_warning": ("NULL", "''", "array_to_string(names, '; ')", "coalesce(cells, '')"),
    "low_confidence_kpi": ("NULL", "''", "''", "''"),
    "implausible_magnitude": ("NULL", "''", "''", _SEEN),
}


def _told(rule: str) -> str:
    na, na_refs, detail, refs = _TOLD[rule]
    return f"SELECT document_id, '{rule}' AS rule_id, {na} AS na, {na_refs} AS na_refs, {detail} AS detail, {refs} AS refs FROM told LEFT JOIN warnings USING (document_id, y)"


_WORDING = "wording(rule_id, if_fired, if_clear) AS (VALUES " + ", ".join(f"('{r}', '{fired}', '{clear}')" for r, (_, fired, clear) in RULES.items()) + ")"
_MESSAGES_SQL = f"{_FLAGS}, {_LEVERAGE}, {_WORDING}, details AS (" + " UNION ALL ".join(map(_told, RULES)) + """)
    SELECT document_id, rule_id, CASE outcome WHEN 'not_evaluated' THEN 'Could not evaluate: ' || na WHEN 'fired' THEN replace(if_fired, '{detail}', detail) ELSE if_clear END AS message,
        CASE outcome WHEN 'not_evaluated' THEN na_refs ELSE refs END AS refs FROM flags JOIN details USING (document_id, rule_id) JOIN wording USING (rule_id)"""

_COUNTS = ", ".join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in evaluation.OUTCOMES)
_SCOPES = """(SELECT document_id, concept, end_year, outcome, unnest(['all', 'concept:' || concept, 'document:' || document_id % 20]) AS scope FROM outcomes)"""
_COMPARED_SQL = f"""{_SCORE_SQL}, n AS (SELECT scope, {_COUNTS} FROM {_SCOPES} GROUP BY scope), o AS (SELECT scope, {_COUNTS} FROM {_SCOPES} WHERE end_year > 1996 GROUP BY scope),
    a AS (SELECT *, TRY_CAST({_SHARE("correct", "correct + wrong")} AS DOUBLE) AS prec FROM n), b AS (SELECT *, TRY_CAST({_SHARE("correct", "correct + wrong")} AS DOUBLE) AS prec FROM o)
    SELECT scope, a.correct - coalesce(b.correct, 0) AS correct, a.wrong - coalesce(b.wrong, 0) AS wrong, coalesce(a.wrong > b.wrong OR a.prec < b.prec, a.wrong > b.wrong, false) AS regressed FROM a LEFT JOIN b USING (scope)"""

_COLUMNS_SQL = f"""WITH e AS (SELECT l_suppkey % 50 AS key, l_orderkey || '-' || l_linenumber AS id, (floor(l_quantity) * 20 + l_linenumber)::DOUBLE AS x FROM lineitem),
    g AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY key ORDER BY x) <= {layout.COLUMN_GAP} THEN 0 ELSE 1 END AS fresh FROM e),
    k AS (SELECT key, x, sum(fresh) OVER (PARTITION BY key ORDER BY x RANGE UNBOUNDED PRECEDING) AS col FROM g),
    s AS (SELECT key, col, min(x) - {layout.SLACK} AS low, max(x) + {layout.SLACK} AS high FROM k GROUP BY key, col HAVING count(*) > 1),
    f AS (SELECT key, id, min(col) AS col FROM e JOIN s USING (key) WHERE x BETWEEN low AND high GROUP BY key, id)
    SELECT key, col::BIGINT AS "column", count(*) AS n FROM f GROUP BY key, col"""

_HEADS = ["Consolidated Balance Sheets", "Statements of Cash Flows", "STATEMENTS OF CONSOLIDATED INCOME", "Standalone Statement of Profit and Loss"]
_TITLE = "|".join(layout.TITLES.values())
_WITHIN = "|".join(layout.INNER.values())
_CANDIDATES_SQL = rf"""WITH {_PAGES_SQL}, t AS (SELECT document_id, page, CASE WHEN (document_id * 3 + page) % 7 = 0 THEN ([{", ".join(f"'{h}'" for h in _HEADS)}])[document_id % 4 + 1] || chr(10) || text ELSE text END AS text FROM pages_of),
    l AS (SELECT document_id, page, unnest(string_split(text, chr(10))) AS text FROM t),
    heads AS (SELECT DISTINCT document_id, page FROM l WHERE len({_WORDS_SQL}) <= 8 AND regexp_matches(text, '(?i)^\s*(?:statements?\s+of\s+consolidated\s+(?:{_WITHIN})|(?:(?:consolidated|standalone)\s+)?(?:{_TITLE}))\b')),
    near AS (SELECT document_id, page FROM t SEMI JOIN (SELECT document_id, page + unnest([-1, 0, 1]) AS page FROM heads) USING (document_id, page)),
    w AS (SELECT document_id, page, {_WORDS_SQL} AS w FROM t), c AS (SELECT document_id, page, len(list_filter(w, lambda x: regexp_full_match(x, '\(?[0-9][0-9,]*(?:\.[0-9]+)?\)?'))) AS k, len(w) AS n FROM w)
    SELECT document_id, page FROM near UNION SELECT document_id, page FROM c WHERE k >= 8 AND k * 4 >= n"""

ORACLE = {
    "kpi_texts": _CARDS_SQL,
    "metric_rows": _METRIC_ROWS_SQL,
    "chart_margins": _MARGINS_SQL,
    "chart_reconciliation": _RECONCILED_SQL,
    "red_flag_messages": _MESSAGES_SQL,
    "eval_compare": _COMPARED_SQL,
    "token_column_range_join": _COLUMNS_SQL,
    "candidate_pages": _CANDIDATES_SQL,
}
