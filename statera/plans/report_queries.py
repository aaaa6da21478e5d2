"""Queries of locating, fiscal years, reports and evaluation over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statera.operators import accuracy_report, changes, checks, fiscal, gates, locate, reports, rules
from statera.plans import statement_queries, text_queries
from statera.plans.issuer_years import analysis, changed, checked


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: Labels of invented tables; both engines pick by the same numbers.
_LABELS = ["Revenue from sales", "Total assets", "Other equity", "Net cash", "Widgets", "Inventories", "Income tax expense"]


def table_scores(spark: SparkSession, d: str) -> DataFrame:
    """Orders as tables, their lines as rows: what each table scores as each statement."""
    lines = table(spark, d, "lineitem").where("l_linenumber < 8").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("_lines"))
    label = lambda i: F.element_at(F.array(*map(F.lit, _LABELS)), ((i * 3 + F.col("l_orderkey") % 7) % 7 + 1).cast("int"))
    cell = lambda i: F.when((F.col("l_orderkey") + i) % 3 == 0, "n/a").otherwise(F.concat(F.lit("1,"), F.lpad((F.col("l_orderkey") % 1000).cast("string"), 3, "0")))
    head = F.array(F.lit(""), F.lit("2024"), F.when(F.col("l_orderkey") % 4 == 0, "2024").otherwise("FY 2023"))
    body = F.transform("_lines", lambda i: F.array(label(i), cell(i), F.lit("7")))
    raw = lines.select(F.col("l_orderkey").cast("string").alias("document_id"), F.lit(1).alias("page"), F.lit(0).alias("table_idx"), F.concat(F.array(head), body).alias("rows"))
    found = locate.scores(locate.built_whole(raw))
    return found.select(F.col("document_id").cast("long").alias("document_id"), "kind", F.col("hits").cast("long").alias("hits"), F.col("score").cast("long").alias("score"))


def _said(names: list[str]) -> str:
    return " OR ".join(f"contains(lower(label), '{k}')" for k in names)


_TABLE_SCORES_SQL = f"""WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber < 8),
    r AS (SELECT l_orderkey, ([{", ".join(f"'{x}'" for x in _LABELS)}])[(l_linenumber * 3 + l_orderkey % 7) % 7 + 1] AS label, (l_orderkey + l_linenumber) % 3 <> 0 AS amount FROM l),
    t AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (amount) AS amounts, {", ".join(f"count(*) FILTER ({_said(v)}) AS {k}" for k, v in locate.KEYWORDS.items())} FROM r GROUP BY l_orderkey),
    k AS ({" UNION ALL ".join(f"SELECT *, '{k}' AS kind, {k} AS hits FROM t" for k in locate.KEYWORDS)})
    SELECT l_orderkey::BIGINT AS document_id, kind, hits, 10 * hits + (1 + CASE WHEN amounts * 2 > n THEN 1 ELSE 0 END) + least(n, 30) + 10 - CASE WHEN l_orderkey % 4 = 0 THEN 20 ELSE 0 END AS score FROM k"""


#: A sentence for each customer; the third kind names two years and the fourth none, so neither binds one.
_SENTENCES = [
    "concat('Our fiscal year ended ', m, ' ', d, ', ', y, ' (\"fiscal ', y - 1, '\").')", "concat('Fiscal ', y - 1, ' means the 52 weeks ended ', m, ' ', d, ', ', y, ';')",
    "concat('Fiscal ', y - 1, ' and fiscal ', y, ' ended ', m, ' ', d, ', ', y, '.')", "concat('The year ended ', m, ' ', d, ', ', y, '.')",
]
_MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]


def fiscal_bindings(spark: SparkSession, d: str) -> DataFrame:
    month = F.element_at(F.array(*map(F.lit, _MONTHS)), (F.col("c_custkey") % 12 + 1).cast("int"))
    rows = table(spark, d, "customer").select("c_custkey", month.alias("m"), (F.col("c_custkey") % 28 + 1).alias("d"), (F.col("c_custkey") % 40 + 1990).alias("y"))
    said = F.element_at(F.array(*map(F.expr, _SENTENCES)), (F.col("c_custkey") % 4 + 1).cast("int"))
    pages = rows.select(F.col("c_custkey").alias("document_id"), F.lit(3).alias("page"), F.concat(F.lit("Notes.\n"), said, F.lit(" More of it.\nNo date")).alias("text"))
    return fiscal.bindings(pages).select("document_id", *[F.col(c).cast("long").alias(c) for c in ("fiscal_year", "day", "year")], "month", "sentence")


_BINDINGS_SQL = f"""WITH r AS (SELECT c_custkey, ([{", ".join(f"'{m}'" for m in _MONTHS)}])[c_custkey % 12 + 1] AS m, c_custkey % 28 + 1 AS d, c_custkey % 40 + 1990 AS y FROM customer)
    SELECT c_custkey AS document_id, (y - 1)::BIGINT AS fiscal_year, d::BIGINT AS day, y::BIGINT AS year, lower(m) AS month, CASE c_custkey % 4 WHEN 0 THEN {_SENTENCES[0]} ELSE {_SENTENCES[1]} END AS sentence
    FROM r WHERE c_custkey % 4 < 2"""


def fiscal_year_mismatches(spark: SparkSession, d: str) -> DataFrame:
    """Customers as filings, orders as facts whose year ends on the order's date, or lasts too long to be annual."""
    orders = table(spark, d, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("end"), "o_orderkey")
    long = F.col("o_orderkey") % 5 == 0
    facts = orders.select(
        F.col("o_custkey").alias("accession"), (F.year("end") + F.when(F.col("o_custkey") % 3 == 0, -1).otherwise(0)).alias("fy"), "end",
        F.date_sub("end", F.when(long, 400).otherwise(364)).alias("start"), F.lit("duration").alias("kind"),
    )
    found = accuracy_report.fiscal_year_check(facts.where(F.month("end") < 4))
    return found.select("accession", F.size("fys").cast("long").alias("n_fys"), F.col("latest_end").cast("string").alias("latest_end"), accuracy_report.is_mismatch(F.col("fys"), F.col("latest_end"), F.lit(0)).alias("mismatch"))


_MISMATCH_SQL = """WITH f AS (SELECT o_custkey AS accession, year(o_orderdate) - CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 0 END AS fy, o_orderdate::DATE AS e, o_orderkey % 5 <> 0 AS annual FROM orders WHERE month(o_orderdate) < 4),
    g AS (SELECT accession, count(DISTINCT fy) AS n_fys, min(fy) AS fy, max(e) FILTER (annual) AS latest_end FROM f GROUP BY accession)
    SELECT accession, n_fys, latest_end::VARCHAR AS latest_end, latest_end IS NOT NULL AND (n_fys <> 1 OR fy <> year(latest_end)) AS mismatch FROM g"""


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    rows = text_queries._scored(spark, d)
    return rows.withColumns({"ticker": F.concat(F.lit("T"), (F.col("document_id") % 40).cast("string")), "bucket": F.when(F.col("document_id") % 40 % 3 == 0, "financial").otherwise("general")})


def eval_scopes(spark: SparkSession, d: str) -> DataFrame:
    """Totals of all, of each bucket and of the held-out companies that were looked at (T0 to T9, if they are held out)."""
    exposed = spark.range(10).select(F.concat(F.lit("T"), F.col("id").cast("string")).alias("ticker"))
    found = accuracy_report.scopes(_outcomes(spark, d).withColumn("document_id", F.col("ticker")), exposed)
    return found.where("scope = 'all'").select("part", *[F.col(c).cast("long").alias(c) for c in ("correct", "wrong", "withheld", "unverified")])


_HOLDOUT_SQL = "list_reduce(list_transform(string_split(sha256(ticker), ''), lambda c: instr('0123456789abcdef', c) - 1), lambda a, x: (a * 16 + x) % 10) % 10 < 3"
_SCOPES_SQL = f"""{text_queries._SCORE_SQL}, o AS (SELECT *, 'T' || (document_id % 40) AS ticker, CASE WHEN document_id % 40 % 3 = 0 THEN 'financial' ELSE 'general' END AS bucket FROM outcomes),
    s AS (SELECT *, document_id % 40 < 10 AND {_HOLDOUT_SQL} AS seen FROM o),
    p AS (SELECT *, unnest(CASE WHEN seen THEN ['exposed'] ELSE ['all', bucket] END) AS part FROM s)
    SELECT part, {", ".join(f"count(*) FILTER (outcome = '{x}') AS {x}" for x in ("correct", "wrong", "withheld", "unverified"))} FROM p GROUP BY part"""


def trend_rows(spark: SparkSession, d: str) -> DataFrame:
    found = reports.trend_rows(changes.changes_long(changed(spark, d)).withColumn("subject", F.concat(F.lit("the "), "subject")))
    return found.select("document_id", "subject", F.col("from_year").cast("long").alias("from_year"), F.col("to_year").cast("long").alias("to_year"), "direction", "reads_as", "status")


def reconciliation_rows(spark: SparkSession, d: str) -> DataFrame:
    found = reports.reconciliation_rows(checks.checks_long(checked(spark, d)))
    return found.select("document_id", "check", F.col("period").cast("long").alias("period"), "status")


def warning_counts(spark: SparkSession, d: str) -> DataFrame:
    return reports.warning_counts(checks.checks_long(checked(spark, d)))


def red_flag_rows(spark: SparkSession, d: str) -> DataFrame:
    return reports.red_flag_rows(rules.flags(analysis(spark, d))).select("document_id", "rule", "status", "severity")


_SPOKEN = lambda x: f"upper(replace({x}, '_', ' ')[1]) || replace({x}, '_', ' ')[2:]"


def answer_gate_columns(spark: SparkSession, d: str) -> DataFrame:
    """Answers made of an event's columns: the row of its user, a level by its number."""
    level = F.element_at(F.array(*map(F.lit, ["high", "medium", "low", "sure"])), (F.col("event_id") % 4 + 1).cast("int"))
    raw = F.concat(F.lit('{"source_row_id": "r'), (F.col("user_id") % 5).cast("string"), F.lit('", "confidence": "'), level, F.lit('"}'))
    ids = lambda *x: F.array(*map(F.lit, x))
    mapped = F.when(F.col("event_id") % 7 == 0, ids("r0"))
    return table(spark, d, "events").select("event_id", gates.answer_status(raw, ids("r0", "r1", "r2"), ids("r0", "r1"), mapped).alias("status"))


_ANSWER_SQL = """SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 'not text' WHEN user_id % 5 > 2 THEN 'unknown row' WHEN user_id % 5 = 2 THEN 'outside the statement'
    WHEN user_id % 5 = 0 AND event_id % 7 = 0 THEN 'already mapped' ELSE 'accepted' END AS status FROM events"""


def summary_gate_columns(spark: SparkSession, d: str) -> DataFrame:
    """Summaries made of documents' own texts: what a plain text that shows no number may be."""
    status = gates.summary_status(F.col("text"), F.array().cast("array<string>"))
    return table(spark, d, "documents").select("doc_id", status.alias("status"))


_SUMMARY_GATE_SQL = r"""SELECT doc_id, CASE WHEN text IS NULL THEN 'no text' WHEN length(text) > 600 THEN 'too long'
    WHEN NOT regexp_full_match(text, '[A-Za-z0-9 .,;:%''"()\-/&+₹$\n]*') THEN 'characters' WHEN regexp_matches(text, '[0-9]') THEN 'number not shown' ELSE 'accepted' END AS status FROM documents"""

QUERIES = {f.__name__: f for f in (
    table_scores, fiscal_bindings, fiscal_year_mismatches, eval_scopes, trend_rows, reconciliation_rows, warning_counts, red_flag_rows, answer_gate_columns, summary_gate_columns,
)}

_OLD = statement_queries.ORACLE
ORACLE = {
    "table_scores": _TABLE_SCORES_SQL,
    "fiscal_bindings": _BINDINGS_SQL,
    "fiscal_year_mismatches": _MISMATCH_SQL,
    "eval_scopes": _SCOPES_SQL,
    "trend_rows": f"SELECT document_id, 'The ' || replace(subject, '_', ' ') AS subject, from_year, to_year, direction, economic AS reads_as, CASE WHEN relative IS NULL THEN 'na' ELSE 'ok' END AS status FROM ({_OLD['yoy_changes']}) WHERE reason IS NULL",
    "reconciliation_rows": f"SELECT document_id, {_SPOKEN('name')} AS \"check\", end_year AS period, status FROM ({_OLD['reconciliation_checks']})",
    "warning_counts": f"SELECT document_id, count(*) FILTER (status = 'warning') AS warnings FROM ({_OLD['reconciliation_checks']}) GROUP BY document_id",
    "red_flag_rows": f"SELECT document_id, {_SPOKEN('rule_id')} AS rule, outcome AS status, severity FROM ({_OLD['red_flags_latest']})",
    "answer_gate_columns": _ANSWER_SQL,
    "summary_gate_columns": _SUMMARY_GATE_SQL,
}
