"""Token, layout, evaluation and gate queries over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statera.functions import tokens as t
from statera.functions.vocabulary import CONCEPTS, CURRENCIES, IMPLIED, SCALES, aliases
from statera.operators import evaluation, gates, layout, mapping
from statera.sources.scratch import settled


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: Cells of a report, rendered from order lines; both engines read the same CASE over the printed price p and key k.
_RENDERED = """CASE k WHEN 0 THEN '(' || p || ')' WHEN 1 THEN p || '-' WHEN 2 THEN '$ ' || p WHEN 3 THEN '—' WHEN 4 THEN '' WHEN 5 THEN p || '*'
    WHEN 6 THEN '1,2345' WHEN 7 THEN 'n/a' WHEN 8 THEN 'Rs. 12,34,567.5' WHEN 9 THEN '+' || p WHEN 10 THEN '-' || p ELSE p END"""
_KEY = "(l_orderkey * 7 + l_linenumber * 3 + l_suppkey) % 13"
_CELLS_SQL = f"""cells AS (SELECT l_orderkey, l_linenumber, l_suppkey % 40 AS tbl, k, {_RENDERED} AS token
    FROM (SELECT *, {_KEY} AS k, format('{{:,.2f}}', l_extendedprice) AS p FROM lineitem))"""
_STRIPPED = "regexp_replace(regexp_replace(trim(token), '(?i)^(?:rs\\.?|inr|usd|us\\$|\\$|₹|€|£)\\s*', ''), '[*†‡§]+$', '')"
_GROUPED = r"^(?:[0-9]{1,3}(?:,[0-9]{3})*|[0-9]{1,2}(?:,[0-9]{2})+,[0-9]{3}|[0-9]+)(?:\.[0-9]+)?$"
_PARSED_SQL = rf"""{_CELLS_SQL},
    bare AS (SELECT *, {_STRIPPED} AS s FROM cells),
    signed AS (SELECT *, starts_with(s, '(') AND ends_with(s, ')') OR ends_with(s, '-') OR starts_with(s, '-') AS neg, trim(s, '()+-') AS inner_text FROM bare),
    parsed AS (SELECT *, CASE WHEN regexp_matches(inner_text, '{_GROUPED}') THEN CASE WHEN neg THEN -1 ELSE 1 END * replace(inner_text, ',', '')::DECIMAL(30,4) END AS value FROM signed),
    numeric_cols AS (SELECT tbl, l_linenumber, count(*) FILTER (value IS NOT NULL) * 2 > count(*) AS is_numeric
        FROM parsed WHERE trim(token) NOT IN ('', '—') GROUP BY ALL),
    classed AS (SELECT p.*, is_numeric, CASE WHEN s = '' THEN 'missing' WHEN s = '—' THEN CASE WHEN is_numeric THEN 'dash_zero' ELSE 'text' END
        WHEN value IS NOT NULL THEN 'number' WHEN is_numeric THEN 'unparseable' ELSE 'text' END AS kind FROM parsed p JOIN numeric_cols USING (tbl, l_linenumber))"""


def cells(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    rows = lines.withColumn("k", F.expr(_KEY)).withColumn("p", F.format_number("l_extendedprice", 2)).withColumn("token", F.expr(_RENDERED))
    return rows.select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 40).alias("tbl"), "k", "token")


def parse_number_tokens(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark, d).select("l_orderkey", "l_linenumber", "token", t.parse_number(F.col("token")).cast("double").alias("value"))


def column_numericness(spark: SparkSession, d: str) -> DataFrame:
    return mapping.numeric_columns(cells(spark, d), "tbl", "l_linenumber")


def classify_cells(spark: SparkSession, d: str) -> DataFrame:
    rows = cells(spark, d)
    rows = rows.join(mapping.numeric_columns(rows, "tbl", "l_linenumber"), ["tbl", "l_linenumber"])
    return rows.groupBy("tbl", "l_linenumber", t.classify(F.col("token"), F.col("is_numeric")).alias("kind")).agg(F.count("*").alias("n"))


_SCALE_OF_TABLE = ["crore", "lakh", "million", "billion", "thousand", "unit"]


def normalized_cells(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, _SCALE_OF_TABLE))
    rows = cells(spark, d).withColumn("scale", F.element_at(names, (F.col("tbl") % 6 + 1).cast("int"))).withColumn("ref_id", t.ref_id(F.col("tbl"), F.lit(0), F.col("l_linenumber")))
    out = mapping.normalised_cells(rows)
    return out.select("l_orderkey", "l_linenumber", "scale", F.col("value").cast("double").alias("value"), "dash_zero", F.col("na.reason").alias("reason"))


#: Captions of tables and statements, by part number.
_TEXTS = ["(Rs. in crore)", "In millions, except per share data", "Amounts in US dollars", "(₹ in lakhs)", "$ in billions", "Form 10-K for the year", "as per Ind AS", "in '000s", "plain text", "USD thousands and INR"]


def _texts(spark: SparkSession, d: str) -> DataFrame:
    texts = F.array(*map(F.lit, _TEXTS))
    pick = lambda n: F.element_at(texts, ((F.col("p_partkey") * n + F.floor(F.col("p_partkey") / n)) % 10 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", pick(1).alias("a"), pick(3).alias("b"), pick(7).alias("c"))


def _texts_sql() -> str:
    listed = ", ".join("'" + x.replace("'", "''") + "'" for x in _TEXTS)
    pick = lambda n: f"([{listed}])[((p_partkey * {n} + p_partkey // {n}) % 10) + 1]"
    return f"texts AS (SELECT p_partkey, {pick(1)} AS a, {pick(3)} AS b, {pick(7)} AS c FROM part)"


def _first_match_sql(x: str, patterns: dict[str, str]) -> str:
    quoted = {k: p.replace("'", "''").replace(r"(?=\s|$|\))", r"(?:\s|$|\))") for k, p in patterns.items()}
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '(?i){p}') THEN '{k}'" for k, p in quoted.items()) + " END"


def scale_resolution(spark: SparkSession, d: str) -> DataFrame:
    found = t.resolve_scale(F.lit(""), F.col("a"), F.col("b"), F.col("c"))
    return _texts(spark, d).withColumn("r", found).select("p_partkey", F.col("r.scale").alias("scale"), F.col("r.source").alias("source"))


def currency_resolution(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("p_partkey", t.resolve_currency(F.col("a"), F.col("b"), F.col("c")).alias("currency"))


_SCALE = {k: p for k, (p, _) in SCALES.items()}
_SCALE_SQL = f"""WITH {_texts_sql()}, s AS (SELECT p_partkey, {_first_match_sql("a", _SCALE)} AS a, {_first_match_sql("b", _SCALE)} AS b, {_first_match_sql("c", _SCALE)} AS c FROM texts)
    SELECT p_partkey, coalesce(a, b, c) AS scale, CASE WHEN a IS NOT NULL THEN 'table' WHEN b IS NOT NULL THEN 'statement' WHEN c IS NOT NULL THEN 'document' END AS source FROM s"""
_CURRENCY_SQL = f"""WITH {_texts_sql()}, s AS (SELECT p_partkey, {_first_match_sql("a", CURRENCIES)} AS a, {_first_match_sql("b", CURRENCIES)} AS b, {_first_match_sql("c", CURRENCIES)} AS c,
    {_first_match_sql("a", IMPLIED)} AS ia, {_first_match_sql("b", IMPLIED)} AS ib, {_first_match_sql("c", IMPLIED)} AS ic FROM texts)
    SELECT p_partkey, CASE WHEN a <> b THEN 'conflict' ELSE coalesce(a, b, c, ia, ib, ic, 'ambiguous') END AS currency FROM s"""

#: Row labels as printed.
_LABELS = ["Net sales", "(a) Revenue from operations*", "1. Cost of sales (note 4)", "Total stockholders' equity", "Short-term debt", "Cash & cash equivalents", "Total current assets(a)", "EBITDA", "Research and development", "Income from operations", "Total income", "Purchases of property, plant and equipment"]
_KINDS = ["income", "balance", "cash_flow"]


def _labels(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", pick(_LABELS, F.col("p_partkey") % 12).alias("label"), pick(_KINDS, F.floor(F.col("p_partkey") / 12) % 3).alias("kind"))


_LABELS_SQL = "labels_of AS (SELECT p_partkey, ([" + ", ".join("'" + x.replace("'", "''") + "'" for x in _LABELS) + "])[p_partkey % 12 + 1] AS label, (['income', 'balance', 'cash_flow'])[(p_partkey // 12) % 3 + 1] AS kind FROM part)"
_NORM_SQL = r"""norms AS (SELECT *, trim(regexp_replace(regexp_replace(replace(replace(regexp_replace(regexp_replace(lower(trim(label)),
    '[*†‡§¹²³]+|\(note [0-9]+[a-z]?\)|\(refer note [^)]*\)|(?:\([a-z]\))+$', ' ', 'g'), '^(?:\(?[0-9ivx]+[.)]|\(?[a-z][.)])\s+', ''), '&', ' and '), '''', ''), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')) AS norm FROM labels_of)"""
_ALIAS_SQL = "aliases(norm, kind, concept, extraction) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', '{e}')" for a, b, c, e, _ in aliases()) + ")"


def label_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d).select("p_partkey", "label", t.normalise_label(F.col("label")).alias("norm"))


def label_match(spark: SparkSession, d: str) -> DataFrame:
    return mapping.match_labels(_labels(spark, d)).select("p_partkey", "kind", "norm", "concept", "extraction")


def _claims(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Claims of order lines as rows of a statement: order as document, line as row; labels by key."""
    labels = F.array(*map(F.lit, ["Net sales", "Total", "Cost of sales", "Sales"]))
    place = F.struct("_metadata.file_path", "_metadata.row_index")  # of rows with one key the first in the files stays, as in the SQL
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") + F.col("l_suppkey")).alias("n"), place.alias("place"))
    first = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min_by("n", "place").alias("n"))
    rows = first.select(F.col("l_orderkey").cast("string").alias("document_id"), F.lit("income").alias("kind"), F.concat(F.lit("r"), "l_linenumber").alias("ref_id"), F.element_at(labels, (F.col("n") % 4 + 1).cast("int")).alias("label"))
    concept = F.when(F.col("label") == "Cost of sales", "cogs").otherwise("revenue")
    return rows.select("document_id", concept.alias("concept"), "ref_id", "kind", "label", F.lit("synonym_match").alias("extraction")), rows


_CLAIMS_SQL = """rows AS (SELECT DISTINCT ON (l_orderkey, l_linenumber) l_orderkey::VARCHAR AS document_id, 'r' || l_linenumber AS ref_id, (['Net sales', 'Total', 'Cost of sales', 'Sales'])[(l_partkey + l_suppkey) % 4 + 1] AS label FROM lineitem),
    counted AS (SELECT document_id, CASE WHEN label = 'Cost of sales' THEN 'cogs' ELSE 'revenue' END AS concept, count(*) AS n, count(*) FILTER (label = 'Total') AS totals,
        min(ref_id) FILTER (label = 'Total') AS total_ref, min(ref_id) FILTER (label <> 'Total') AS other_ref FROM rows GROUP BY ALL)"""


def claim_conflicts(spark: SparkSession, d: str) -> DataFrame:
    found, rows = _claims(spark, d)
    return mapping.resolve_claims(found, rows)[1].select("document_id", "concept", F.col("na.detail").alias("detail"), F.size("na.refs").cast("long").alias("n_refs"))


def total_wins_notes(spark: SparkSession, d: str) -> DataFrame:
    found, rows = _claims(spark, d)
    return mapping.resolve_claims(found, rows)[2].select("document_id", "concept", "kept_ref", "dropped_ref")


def unmapped_concepts(spark: SparkSession, d: str) -> DataFrame:
    found, rows = _claims(spark, d)
    return mapping.unmapped(mapping.resolve_claims(found, rows)[0], rows).groupBy("concept").agg(F.count("*").alias("n"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Documents of a source as pages of one report, eight to a report."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return docs.select(F.floor(F.col("doc_id") / 8).alias("document_id"), (F.col("doc_id") % 8 + 1).cast("int").alias("page"), F.coalesce("text", F.lit("")).alias("text"))


_PAGES_SQL = "pages_of AS (SELECT doc_id // 8 AS document_id, doc_id % 8 + 1 AS page, coalesce(text, '') AS text FROM documents)"


def space_ratio(spark: SparkSession, d: str) -> DataFrame:
    out = layout.space_ratio(_pages(spark, d))
    return out.select("document_id", F.round("ratio", 9).alias("ratio"), "reread")


def text_layer_probe(spark: SparkSession, d: str) -> DataFrame:
    return layout.text_layer(_pages(spark, d)).select("document_id", "n_pages", "status")


def numeric_density(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("doc_id", t.numeric_tokens(F.col("text")).cast("long").alias("n_numeric"), F.size(t.words(F.col("text"))).cast("long").alias("n_tokens"), t.is_dense(F.col("text")).alias("dense"))


def heading_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return rows.groupBy("doc_id").agg(F.count_if(t.is_heading(F.col("line"))).alias("headings"), F.count("*").alias("n_lines"))


def candidate_pages(spark: SparkSession, d: str) -> DataFrame:
    heads = ["Consolidated Balance Sheets", "Statements of Cash Flows", "STATEMENTS OF CONSOLIDATED INCOME", "Standalone Statement of Profit and Loss"]
    pick = F.element_at(F.array(*map(F.lit, heads)), (F.col("document_id") % 4 + 1).cast("int"))
    rows = _pages(spark, d).withColumn("text", F.when((F.col("document_id") * 3 + F.col("page")) % 7 == 0, F.concat(pick, F.lit("\n"), "text")).otherwise(F.col("text")))
    return layout.candidate_pages(rows).select("document_id", F.col("page").cast("long").alias("page"))


def page_clusters(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", (F.unix_timestamp("ts") / 3600).cast("long").alias("at"))
    found = layout.clusters(rows, "user_id", "at", 24, "cluster")
    return found.groupBy("user_id", "cluster").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n"))


def token_column_range_join(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "lineitem").select((F.col("l_suppkey") % 50).alias("key"), "l_orderkey", "l_linenumber", (F.floor(F.col("l_quantity")) * 20 + F.col("l_linenumber")).cast("double").alias("x"))
    spans = layout.column_spans(edges.select("key", "x"))
    found = layout.in_columns(edges.select("key", F.struct("l_orderkey", "l_linenumber").alias("id"), "x"), spans)
    return found.groupBy("key", "column").agg(F.count("*").alias("n"))


def choose_statement_set(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array(*map(F.lit, _KINDS))
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("document_id"), F.element_at(kinds, (F.col("l_linenumber") % 3 + 1).cast("int")).alias("kind"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("table_id"), (F.col("l_partkey") % 500).alias("page"), F.col("l_quantity").cast("long").alias("score"))
    return layout.choose(rows).select("document_id", "kind", F.col("page").cast("long").alias("page"), "score")


_CHOOSE_SQL = """WITH c AS (SELECT l_suppkey AS document_id, (['income', 'balance', 'cash_flow'])[l_linenumber % 3 + 1] AS kind, l_orderkey || '-' || l_linenumber AS table_id, l_partkey % 500 AS page, l_quantity::BIGINT AS score FROM lineitem),
    g AS (SELECT *, CASE WHEN page - lag(page) OVER (PARTITION BY document_id ORDER BY page) <= 15 THEN 0 ELSE 1 END AS fresh FROM c),
    k AS (SELECT *, sum(fresh) OVER (PARTITION BY document_id ORDER BY page RANGE UNBOUNDED PRECEDING) AS cluster FROM g),
    b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY document_id, cluster, kind ORDER BY score DESC, page, table_id) = 1),
    t AS (SELECT document_id, cluster, sum(score) + 25 * count(*) AS total FROM b GROUP BY ALL), s AS (SELECT document_id, cluster FROM t QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY total DESC, cluster) = 1)
    SELECT document_id, kind, page, score FROM b JOIN s USING (document_id, cluster)"""


def split_assignment(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_name", evaluation.split(F.col("c_name")).alias("split"))


def filing_asof_selection(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("ticker"), F.col("o_orderkey").alias("accession"), F.to_date("o_orderdate").alias("filed"))
    return evaluation.filing_as_of(rows, "1999-06-30")


def _facts(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    end = F.to_date("l_shipdate")
    return lines.select(
        (F.col("l_suppkey") % 30).alias("document_id"), F.concat(F.lit("c"), F.col("l_partkey") % 5).alias("concept"), F.concat(F.lit("t"), F.col("l_linenumber") % 2).alias("tag"),
        F.when(F.col("l_orderkey") % 4 > 0, F.date_sub(end, 300 + (F.col("l_orderkey") % 100).cast("int"))).alias("start"), end.alias("end"), F.col("l_quantity").cast("decimal(18,0)").alias("value"),
        F.when(F.col("l_partkey") % 5 == 0, "instant").otherwise("duration").alias("kind"), "l_orderkey",
    )


_FACTS_SQL = """f AS (SELECT l_suppkey % 30 AS document_id, 'c' || (l_partkey % 5) AS concept, 't' || (l_linenumber % 2) AS tag, CASE WHEN l_orderkey % 4 > 0 THEN l_shipdate::DATE - (300 + l_orderkey % 100)::INTEGER END AS start,
        l_shipdate::DATE AS "end", l_quantity::DECIMAL(18,0) AS value, CASE WHEN l_partkey % 5 = 0 THEN 'instant' ELSE 'duration' END AS kind, l_orderkey FROM lineitem),
    annual AS (SELECT *, year("end") AS end_year FROM f WHERE CASE WHEN kind = 'instant' THEN start IS NULL ELSE start IS NOT NULL AND "end" - start BETWEEN 350 AND 380 END)"""


def truth_extract(spark: SparkSession, d: str) -> DataFrame:
    rows = evaluation.annual_facts(_facts(spark, d))
    return rows.groupBy("document_id", "concept", F.col("end_year").cast("long").alias("end_year"), "tag").agg(F.count("*").alias("n"), F.sum("value").cast("double").alias("total"))


def truth_conflicts(spark: SparkSession, d: str) -> DataFrame:
    rows = evaluation.truth(_few_facts(spark, d))
    return rows.select("document_id", "concept", F.col("end_year").cast("long").alias("end_year"), F.array_join(F.transform("values", lambda v: v.cast("string")), ",").alias("values"), F.array_join("tags", ",").alias("tags"))


def _few_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts with a document for each order, so that few share a tag and year; a document's concept is in one task."""
    return evaluation.annual_facts(_facts(spark, d)).withColumn("document_id", F.floor(F.col("l_orderkey") / 2)).repartition(_tasks(spark, d), "document_id", "concept")


#: Order lines whose facts one task holds: its memory stays the same at any size.
_LINES = 500_000


def _tasks(spark: SparkSession, d: str) -> int:
    return max(1, -(-table(spark, d, "lineitem").count() // _LINES))


_TRUTH_SQL = f"""WITH {_FACTS_SQL}, g AS (SELECT l_orderkey // 2 AS document_id, concept, end_year, tag, list(DISTINCT value) AS vals FROM annual GROUP BY ALL),
    truth AS (SELECT document_id, concept, end_year, list_sort(list_distinct(flatten(list(vals)))) AS vals, list_sort(list(DISTINCT tag)) AS tags FROM g GROUP BY ALL HAVING max(len(vals)) = 1)"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    known = settled(evaluation.truth(_few_facts(spark, d)), "truth")
    first = F.element_at("values", 1)
    values = known.where("(document_id + end_year) % 5 <> 0").select(
        "document_id", "concept", "end_year", F.when(F.col("document_id") % 4 == 1, -first).when(F.col("document_id") % 4 == 2, first + 7).otherwise(first).alias("value"),
        F.lit(0.5).cast("decimal(2,1)").alias("tolerance"), (F.col("concept") == "c1").alias("agnostic"),
    )
    extra = values.where("document_id % 9 = 0").withColumn("end_year", F.col("end_year") + 50)
    return evaluation.scored(values.union(extra), known, _tasks(spark, d))


def score_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).withColumn("end_year", F.col("end_year").cast("long"))


def eval_summary(spark: SparkSession, d: str) -> DataFrame:
    out = evaluation.summary(_scored(spark, d).withColumn("document_id", (F.col("document_id") % 20).cast("string")))
    return out.select("scope", *evaluation.OUTCOMES, *evaluation.SUBS, "precision", "coverage", "wrong_rate")


_SCORE_SQL = f"""{_TRUTH_SQL},
    vals AS (SELECT document_id, concept, end_year, CASE document_id % 4 WHEN 1 THEN -vals[1] WHEN 2 THEN vals[1] + 7 ELSE vals[1] END AS value, concept = 'c1' AS agnostic FROM truth WHERE (document_id + end_year) % 5 <> 0),
    every AS (SELECT * FROM vals UNION ALL SELECT document_id, concept, end_year + 50, value, agnostic FROM vals WHERE document_id % 9 = 0),
    matched AS (SELECT t.document_id, t.concept, t.end_year, v.value,
            len(list_filter(t.vals, lambda x: abs(v.value - x) <= 0.5 OR (v.agnostic AND abs(abs(v.value) - abs(x)) <= 0.5))) > 0 AS hit,
            len(list_filter(t.vals, lambda x: abs(abs(v.value) - abs(x)) <= 0.5)) > 0 AS sized,
            EXISTS (SELECT 1 FROM truth o WHERE o.document_id = t.document_id AND o.concept = t.concept AND o.end_year <> t.end_year
                AND len(list_filter(o.vals, lambda x: abs(v.value - x) <= 0.5 OR (v.agnostic AND abs(abs(v.value) - abs(x)) <= 0.5))) > 0) AS elsewhere
        FROM truth t LEFT JOIN every v USING (document_id, concept, end_year)),
    outcomes AS (SELECT document_id, concept, end_year, CASE WHEN value IS NULL THEN 'withheld' WHEN hit THEN 'correct' ELSE 'wrong' END AS outcome,
            CASE WHEN value IS NOT NULL AND NOT hit THEN CASE WHEN sized THEN 'sign_mismatch' WHEN elsewhere THEN 'wrong_period' ELSE 'value' END END AS sub FROM matched
        UNION ALL SELECT document_id, concept, end_year, 'unverified', NULL FROM every ANTI JOIN truth USING (document_id, concept, end_year))"""
_SHARE = lambda a, b: f"CASE WHEN ({b}) = 0 THEN 'n/a' ELSE format('{{:.4f}}', round_even(({a})::DOUBLE / ({b}), 4)) END"
_SUMMARY_SQL = f"""{_SCORE_SQL}, s AS (SELECT CASE grouping_id(concept, doc) WHEN 3 THEN 'all' WHEN 1 THEN 'concept:' || concept ELSE 'document:' || doc END AS scope,
        {", ".join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in evaluation.OUTCOMES)}, {", ".join(f"count(*) FILTER (sub = '{x}') AS {x}" for x in evaluation.SUBS)}
    FROM (SELECT *, (document_id % 20)::VARCHAR AS doc FROM outcomes) GROUP BY GROUPING SETS ((), (concept), (doc)))
    SELECT *, {_SHARE("correct", "correct + wrong")} AS precision, {_SHARE("correct + wrong", "correct + wrong + withheld")} AS coverage, {_SHARE("wrong", "correct + wrong + withheld")} AS wrong_rate FROM s"""


def eval_compare(spark: SparkSession, d: str) -> DataFrame:
    rows = _scored(spark, d)
    now = evaluation.summary(rows.withColumn("document_id", (F.col("document_id") % 20).cast("string")))
    before = evaluation.summary(rows.where("end_year > 1996").withColumn("document_id", (F.col("document_id") % 20).cast("string")))
    return evaluation.compared(now, before)


def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat_ws(" | ", F.col("c_name"), F.col("c_mktsegment"))
    rows = table(spark, d, "customer")
    now = rows.where("c_custkey % 7 <> 0").select(line.alias("line"))
    before = rows.where("c_custkey % 11 <> 0").select(F.concat_ws(" | ", "c_name", F.when(F.col("c_custkey") % 50 == 0, "changed").otherwise(F.col("c_mktsegment"))).alias("line"))
    return evaluation.snapshot_difference(now, before)


#: Answers of a model, by event number: accepted, declined, a number, an unknown row, no JSON, a repeated key, a wrong shape.
_ANSWERS = [
    '{"source_row_id": "r1", "confidence": "high", "reasoning": "label"}', '{"source_row_id": null, "confidence": "low", "reasoning": ""}', '{"source_row_id": 12}',
    '{"source_row_id": "r99"}', "not json", '{"source_row_id": "r1", "source_row_id": "r2"}', '["r1"]', '{"source_row_id": "r2", "value": "3"}', '{"confidence": "high"}', '{"source_row_id": "1,200"}',
]
_STATUS = ["accepted", "declined", "number", "unknown row", "not JSON", "not JSON", "not an object", "unexpected field", "no row", "unknown row"]


def answer_gate(spark: SparkSession, d: str) -> DataFrame:
    pick = F.element_at(F.array(*map(F.lit, _ANSWERS)), (F.col("event_id") % 10 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", gates.answer_status(pick, F.array(F.lit("r1"), F.lit("r2"))).alias("status"))


def narrative_gate(spark: SparkSession, d: str) -> DataFrame:
    texts = F.element_at(F.array(*map(F.lit, ["Revenue rose to 8,420.0.", "Margin was 38.5 of 9.", "<b>bold</b>", "No figures."])), (F.col("event_id") % 4 + 1).cast("int"))
    cites = F.when(F.col("event_id") % 5 == 0, F.array().cast("array<string>")).when(F.col("event_id") % 5 == 1, F.array(F.lit("v9"))).otherwise(F.array(F.lit("v1")))
    status = gates.narrative_status(texts, cites, F.array(F.lit("8,420.0"), F.lit("38.5")), F.array(F.lit("v1"), F.lit("v2")))
    return table(spark, d, "events").select("event_id", status.alias("status"))


QUERIES = {f.__name__: f for f in (
    parse_number_tokens, column_numericness, classify_cells, normalized_cells, scale_resolution, currency_resolution, label_normalize, label_match, claim_conflicts, total_wins_notes,
    unmapped_concepts, space_ratio, text_layer_probe, numeric_density, heading_candidates, candidate_pages, page_clusters, token_column_range_join, choose_statement_set, split_assignment,
    filing_asof_selection, truth_extract, truth_conflicts, score_outcomes, eval_summary, eval_compare, snapshot_diff, answer_gate, narrative_gate,
)}

_WORDS_SQL = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"
ORACLE = {
    "parse_number_tokens": f"WITH {_PARSED_SQL} SELECT l_orderkey, l_linenumber, token, value::DOUBLE AS value FROM parsed",
    "column_numericness": f"WITH {_PARSED_SQL} SELECT * FROM numeric_cols",
    "classify_cells": f"WITH {_PARSED_SQL} SELECT tbl, l_linenumber, kind, count(*) AS n FROM classed GROUP BY ALL",
    "normalized_cells": f"""WITH {_PARSED_SQL}, m AS (SELECT *, (['crore', 'lakh', 'million', 'billion', 'thousand', 'unit'])[tbl % 6 + 1] AS scale, ([10000000, 100000, 1000000, 1000000000, 1000, 1])[tbl % 6 + 1] AS factor FROM parsed)
        SELECT l_orderkey, l_linenumber, scale, CASE WHEN s = '—' THEN 0 ELSE (value * factor)::DOUBLE END AS value, s = '—' AS dash_zero,
            CASE WHEN s = '' THEN 'missing_input' WHEN value IS NULL AND s <> '—' THEN 'unparseable' END AS reason FROM m""",
    "scale_resolution": _SCALE_SQL,
    "currency_resolution": _CURRENCY_SQL,
    "label_normalize": f"WITH {_LABELS_SQL}, {_NORM_SQL} SELECT p_partkey, label, norm FROM norms",
    "label_match": f"WITH {_LABELS_SQL}, {_NORM_SQL}, {_ALIAS_SQL} SELECT p_partkey, kind, norm, concept, extraction FROM norms LEFT JOIN aliases USING (norm, kind)",
    "claim_conflicts": f"WITH {_CLAIMS_SQL} SELECT document_id, concept, concept || ': ' || n || ' rows claim it' AS detail, n AS n_refs FROM counted WHERE n > 1 AND NOT (n = 2 AND totals = 1)",
    "total_wins_notes": f"WITH {_CLAIMS_SQL} SELECT document_id, concept, total_ref AS kept_ref, other_ref AS dropped_ref FROM counted WHERE n = 2 AND totals = 1",
    "unmapped_concepts": f"""WITH {_CLAIMS_SQL}, accepted AS (SELECT document_id, concept FROM counted WHERE n = 1 OR n = 2 AND totals = 1), concepts AS (SELECT unnest([{", ".join("'" + c + "'" for c in CONCEPTS)}]) AS concept)
        SELECT concept, count(*) AS n FROM (SELECT DISTINCT document_id FROM rows) CROSS JOIN concepts ANTI JOIN accepted USING (document_id, concept) GROUP BY concept""",
    "space_ratio": f"WITH {_PAGES_SQL}, r AS (SELECT document_id, sum(length(text) - length(replace(text, ' ', '')))::DOUBLE / sum(length(text)) AS ratio FROM pages_of GROUP BY ALL) SELECT document_id, round(ratio, 9) AS ratio, ratio < 0.08 AS reread FROM r",
    "text_layer_probe": rf"""WITH {_PAGES_SQL}, n AS (SELECT document_id, count(*) AS n_pages, sum(length(trim(text, ' ' || chr(9) || chr(10) || chr(13)))) AS chars, count(*) FILTER (len(regexp_extract_all(text, '[A-Za-z]{{2,}}')) >= 10)::DOUBLE / count(*) AS share FROM pages_of GROUP BY ALL)
        SELECT document_id, n_pages, CASE WHEN chars < 200 OR share < 0.3 THEN 'scanned' ELSE 'ok' END AS status FROM n""",
    "numeric_density": rf"""WITH w AS (SELECT doc_id, {_WORDS_SQL.replace("text", "coalesce(text, '')")} AS w FROM documents), c AS (SELECT doc_id, len(list_filter(w, lambda x: regexp_full_match(x, '\(?[0-9][0-9,]*(?:\.[0-9]+)?\)?'))) AS n_numeric, len(w) AS n_tokens FROM w)
        SELECT *, n_numeric >= 8 AND n_numeric * 4 >= n_tokens AS dense FROM c""",
    "heading_candidates": f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents) SELECT doc_id, count(*) FILTER (len({_WORDS_SQL}) <= 8) AS headings, count(*) AS n_lines FROM l GROUP BY ALL",
    "page_clusters": """WITH e AS (SELECT user_id, floor(epoch(ts) / 3600)::BIGINT AS hour FROM events), g AS (SELECT *, CASE WHEN hour - lag(hour) OVER (PARTITION BY user_id ORDER BY hour) <= 24 THEN 0 ELSE 1 END AS fresh FROM e),
        c AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY hour RANGE UNBOUNDED PRECEDING) AS cluster FROM g) SELECT user_id, cluster::BIGINT AS cluster, min(hour) AS first, max(hour) AS last, count(*) AS n FROM c GROUP BY user_id, cluster""",
    "choose_statement_set": _CHOOSE_SQL,
    "split_assignment": "SELECT c_name, CASE WHEN list_reduce(list_transform(string_split(sha256(c_name), ''), lambda c: instr('0123456789abcdef', c) - 1), lambda a, x: (a * 16 + x) % 10) % 10 < 3 THEN 'holdout' ELSE 'dev' END AS split FROM customer",
    "filing_asof_selection": "SELECT o_custkey AS ticker, o_orderkey AS accession, o_orderdate::DATE AS filed FROM orders WHERE o_orderdate::DATE <= DATE '1999-06-30' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE DESC, o_orderkey DESC) = 1",
    "truth_extract": f"WITH {_FACTS_SQL} SELECT document_id, concept, end_year, tag, count(*) AS n, sum(value)::DOUBLE AS total FROM annual GROUP BY ALL",
    "truth_conflicts": f"{_TRUTH_SQL} SELECT document_id, concept, end_year, array_to_string(vals, ',') AS values, array_to_string(tags, ',') AS tags FROM truth",
    "score_outcomes": f"{_SCORE_SQL} SELECT * FROM outcomes",
    "eval_summary": _SUMMARY_SQL,
    "snapshot_diff": """WITH a AS (SELECT c_name || ' | ' || c_mktsegment AS line FROM customer WHERE c_custkey % 7 <> 0), b AS (SELECT c_name || ' | ' || CASE WHEN c_custkey % 50 = 0 THEN 'changed' ELSE c_mktsegment END AS line FROM customer WHERE c_custkey % 11 <> 0)
        (SELECT '+' AS sign, line FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) UNION ALL (SELECT '-', line FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))""",
    "answer_gate": "SELECT event_id, ([" + ", ".join(f"'{s}'" for s in _STATUS) + "])[event_id % 10 + 1] AS status FROM events",
    "narrative_gate": "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'citations' WHEN event_id % 5 = 1 THEN 'unknown citation' WHEN event_id % 4 = 2 THEN 'characters' WHEN event_id % 4 = 1 THEN 'number not shown' ELSE 'accepted' END AS status FROM events",
}
