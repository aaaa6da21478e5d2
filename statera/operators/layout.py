"""Page layout operators (S3, S4, L1-L8, L11-L14, L16, L18-L22): which pages and tables hold the statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statera.functions.tokens import YEAR, is_amount, is_dense, is_heading, strip, words
from statera.functions.vocabulary import KINDS

#: Limits of the text probe, of headings, clusters and columns.
SPACE_RATIO, SAMPLES, MIN_CHARS, MIN_WORDS, MIN_SHARE, CLUSTER_GAP, COLUMN_GAP, SLACK = 0.08, 12, 200, 10, 0.3, 15, 14.0, 6.0
#: Titles of the statements, with an optional scope before them or inside them.
TITLES = {
    "income": r"statements? of profit and loss|statements? of operations|statements? of income|income statements?|statements? of comprehensive income|comprehensive income statements?|statements? of earnings",
    "balance": r"balance sheets?|statements? of financial position",
    "cash_flow": r"statements? of cash flows?|cash flows? statements?",
}
INNER = {"income": "income|operations", "balance": "balance sheets?|financial position", "cash_flow": "cash flows?"}
COVER = [r"securities\s+and\s+exchange\s+commission", r"washington[\s,]*d\.?\s*c\.?[\s,]*20549", r"form\s+10[-‑]k\b"]


def space_ratio(pages: DataFrame, key: str = "document_id") -> DataFrame:
    """key, ratio, reread: spaces per character of a document; below SPACE_RATIO its text is to be read more tightly."""
    spaces = F.sum(F.length("text") - F.length(F.replace(F.col("text"), F.lit(" "), F.lit(""))))
    out = pages.groupBy(key).agg(F.try_divide(spaces.cast("double"), F.sum(F.length("text"))).alias("ratio"))
    return out.withColumn("reread", F.coalesce(F.col("ratio") < SPACE_RATIO, F.lit(False)))


def sampled_pages(n_pages: Column) -> Column:
    """Numbers (from 0) of evenly spaced pages, SAMPLES at most."""
    k = F.least(F.lit(SAMPLES), n_pages)
    return F.array_distinct(F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.when(k == 1, F.lit(0)).otherwise(F.bround(i * (n_pages - 1) / (k - 1)).cast("int"))))


def text_layer(pages: DataFrame) -> DataFrame:
    """document_id, n_pages, status: ok, unreadable (no pages) or scanned (too little text on sampled pages).

    pages: document_id, page (from 1), text.
    """
    counts = pages.groupBy("document_id").agg(F.count("page").alias("n_pages"))
    wanted = counts.where("n_pages > 0").select("document_id", "n_pages", F.explode(F.transform(sampled_pages(F.col("n_pages").cast("int")), lambda i: i + 1)).alias("page"))
    texts = wanted.join(pages, ["document_id", "page"])
    worded = F.regexp_count("text", F.lit("[A-Za-z]{2,}")) >= MIN_WORDS
    seen = texts.groupBy("document_id").agg(F.sum(F.length(strip(F.col("text")))).alias("chars"), (F.count_if(worded) / F.count("*")).alias("share"))
    scanned = (F.col("chars") < MIN_CHARS) | (F.col("share") < MIN_SHARE)
    out = counts.join(seen, "document_id", "left")
    return out.select("document_id", "n_pages", F.when(F.col("n_pages") == 0, "unreadable").when(scanned, "scanned").otherwise("ok").alias("status"))


def anchors(lines: DataFrame) -> DataFrame:
    """lines (a column line among others) with kind and scope of those that are a statement's heading."""
    heads = lines.where(is_heading(F.col("line")))
    cases = []
    for kind in KINDS:
        inner = F.col("line").rlike(rf"(?i)^\s*statements?\s+of\s+consolidated\s+(?:{INNER[kind]})\b")
        title = rf"(?i)^\s*(?:(consolidated|standalone)\s+)?(?:{TITLES[kind]})\b"
        scope = F.lower(F.regexp_extract("line", title, 1))
        named = F.when(inner, "consolidated").when(F.col("line").rlike(title), F.when(scope == "", "unprefixed").otherwise(scope))
        cases.append(F.when(named.isNotNull(), F.struct(F.lit(kind).alias("kind"), named.alias("scope"))))
    found = F.filter(F.array(*cases), lambda c: c.isNotNull())
    return heads.withColumn("_a", F.explode(found)).select("*", "_a.kind", "_a.scope").drop("_a")


def is_cover(text: Column) -> Column:
    low = F.lower(text)
    out = F.lit(True)
    for pattern in COVER:
        out = out & low.rlike(pattern)
    return out


def candidate_pages(pages: DataFrame) -> DataFrame:
    """document_id, page: pages with a statement's heading and their neighbours, and pages dense with numbers."""
    lines = pages.select("document_id", "page", F.explode(F.split("text", "\n")).alias("line"))
    anchored = anchors(lines).select("document_id", "page").distinct()
    near = anchored.select("document_id", F.explode(F.sequence(F.col("page") - 1, F.col("page") + 1)).alias("page")).join(pages.select("document_id", "page"), ["document_id", "page"], "left_semi")
    dense = pages.where(is_dense(F.col("text"))).select("document_id", "page").join(anchored, ["document_id", "page"], "left_anti")
    return near.union(dense).distinct()


def clusters(rows: DataFrame, key: str, at: str, gap: float, out: str) -> DataFrame:
    """rows with ``out``: the number (from 1) of its run of places that are no more than ``gap`` apart."""
    w = Window.partitionBy(key).orderBy(at)
    new = F.coalesce((F.col(at) - F.lag(at).over(w) > gap).cast("int"), F.lit(1))
    return rows.withColumn("_new", new).withColumn(out, F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0))).drop("_new")


def column_spans(edges: DataFrame) -> DataFrame:
    """page key, column, low, high of right edges (key, x): runs with gaps of 14 points at most and two members or more."""
    places = edges.groupBy("key", "x").agg(F.count("*").alias("_at"))  # a page has few places, however many words
    found = clusters(places, "key", "x", COLUMN_GAP, "column")
    return found.groupBy("key", "column").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.sum("_at").alias("n")).where("n >= 2").drop("n")


def in_columns(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """tokens (key, id, x) with the first column whose span, 6 points wider at both ends, holds their right edge."""
    places = tokens.select("key", "x").distinct().join(spans, "key").where((F.col("x") >= F.col("low") - SLACK) & (F.col("x") <= F.col("high") + SLACK))
    hits = tokens.join(places.groupBy("key", "x").agg(F.min("column").alias("column")), ["key", "x"])
    return hits.groupBy("key", "id").agg(F.min("column").alias("column"))


def table_score(keyword_rows: Column, numeric_columns: Column, n_rows: Column, years: Column) -> Column:
    """Ten for each row with a keyword, one for each numeric column and row (30 at most), five for each year (three at
    most), less 20 if a year repeats."""
    repeats = F.size(years) != F.size(F.array_distinct(years))
    return keyword_rows * 10 + numeric_columns + F.least(n_rows, F.lit(30)) + F.least(F.size(years), F.lit(3)) * 5 - F.when(repeats, 20).otherwise(0)


def header_years(header: Column) -> Column:
    return F.filter(F.transform(header, lambda c: F.regexp_extract(c, YEAR, 1)), lambda y: y != "")


def numeric_column_count(columns: Column) -> Column:
    """Of arrays of cells, those of which more than half are amounts."""
    return F.size(F.filter(columns, lambda c: F.size(F.filter(c, is_amount)) * 2 > F.size(c)))


def choose(candidates: DataFrame) -> DataFrame:
    """document_id, kind, table_id, page, score: the best table of each kind from one cluster of pages.

    candidates: document_id, kind, table_id, page, score. Clusters end where 15 pages lie between; the best has the
    largest sum of its kinds' scores and 25 for each kind; ties go to the earliest.
    """
    found = clusters(candidates, "document_id", "page", CLUSTER_GAP, "_cluster")
    best = Window.partitionBy("document_id", "_cluster", "kind").orderBy(F.desc("score"), "page", "table_id")
    top = found.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
    totals = top.groupBy("document_id", "_cluster").agg((F.sum("score") + 25 * F.count("*")).alias("_total"))
    first = Window.partitionBy("document_id").orderBy(F.desc("_total"), "_cluster")
    chosen = totals.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("document_id", "_cluster")
    return top.join(chosen, ["document_id", "_cluster"]).select("document_id", "kind", "table_id", "page", "score")


__all__ = ["anchors", "candidate_pages", "choose", "clusters", "column_spans", "header_years", "in_columns", "is_cover", "numeric_column_count", "sampled_pages", "space_ratio", "table_score", "text_layer", "words"]
