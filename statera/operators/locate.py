"""From pages and tables to statements (S6-S8, L3, L19, L20, L22-L24): which table is which statement, and on what basis.

pages: document_id, page (from 1), text. raw tables: document_id, page, table_idx, rows (arrays of cells), and where they are
known col_x (left edges of the columns). Tables, as ``built`` makes them: document_id, table_id, page, table_idx, header, n_rows, columns.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statera.functions.tokens import YEAR, evened, is_amount, is_dense, is_header, ref_id, words
from statera.operators import grid
from statera.operators.layout import KINDS, anchors, candidate_pages, choose, header_years, is_cover, numeric_column_count, table_score
from statera.sources.scratch import settled

#: Words of row labels that speak for a statement, the least score of a table that no heading names, lines
#: above a table that make its caption, characters of its first line that are looked for, rows and columns of a usable one.
KEYWORDS = {
    "income": ["revenue", "sales", "profit", "income", "expense", "tax", "cost"],
    "balance": ["assets", "liabilities", "equity", "borrowings", "payables", "receivables", "inventor", "debt"],
    "cash_flow": ["operating activities", "investing activities", "financing activities", "cash flow", "net cash"],
}
LEAST_SCORE, CAPTION_LINES, CAPTION_CHARS, USABLE_ROWS, USABLE_COLUMNS = 13, 2, 24, 3, 2


def lines_of(pages: DataFrame) -> DataFrame:
    """document_id, page, line_idx, line of every page."""
    return pages.select("document_id", "page", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("line_idx", "line"))


def anchor_lines(pages: DataFrame) -> DataFrame:
    """document_id, page, headings: the page's statement headings in order, white space and case evened out."""
    found = anchors(lines_of(pages)).select("document_id", "page", "line_idx", "line").distinct()
    even = F.lower(F.array_join(words(F.col("line")), " "))
    held = F.array_sort(F.collect_list(F.struct("line_idx", even.alias("line"))))
    return found.groupBy("document_id", "page").agg(F.transform(held, lambda x: x["line"]).alias("headings"))


def _clean(raw: DataFrame) -> DataFrame:
    """document_id, page, table_idx, table_id, col_x, _rows (clean, those with any text), _head (1 if the first of them is a header)."""
    clean = F.transform("rows", lambda r: F.transform(r, evened))
    kept = F.filter(clean, lambda r: F.exists(r, lambda c: c != ""))
    places = F.coalesce(F.col("col_x") if "col_x" in raw.columns else F.lit(None), F.array().cast("array<double>"))
    table = F.format_string("page_%d_table_%d", "page", "table_idx")
    tables = raw.select("document_id", "page", "table_idx", table.alias("table_id"), places.alias("col_x"), kept.alias("_rows"))
    return tables.withColumn("_head", F.coalesce(is_header(F.get("_rows", F.lit(0))), F.lit(False)).cast("int"))


def table_rows(raw: DataFrame) -> DataFrame:
    """document_id, table_id, page, table_idx, row_idx (null: the header), ref_id, label, cells (all of the row, clean), col_x.

    Rows without any text are left out; the first of the others is the header if it names periods and no amounts. A row's
    id has its true page, so that a table continued over pages keeps it.
    """
    each = _clean(raw).select("document_id", "page", "table_idx", "table_id", "col_x", "_head", F.posexplode_outer("_rows").alias("_pos", "cells")).where("_pos IS NOT NULL")  # not posexplode, whose inferred filter would clean all cells again
    row = F.when(F.col("_pos") >= F.col("_head"), F.col("_pos") - F.col("_head"))
    ref = F.when(row.isNotNull(), ref_id(F.col("page"), F.col("table_idx"), row))
    return each.select("document_id", "table_id", "page", "table_idx", row.alias("row_idx"), ref.alias("ref_id"), F.get("cells", F.lit(0)).alias("label"), "cells", "col_x")


def report_rows(raw: DataFrame, pages: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """table_rows of the ruled tables and, for candidate pages without a usable one, of grids made of the page's words (S8).

    words: document_id, page, text, x0, x1, top. Grids are numbered after the page's ruled tables, so ids of the two never meet.
    """
    ruled = table_rows(raw)
    if words is None:
        return ruled
    usable = built(ruled).where(is_usable(F.col("header"), F.col("n_rows"), F.col("columns"))).select("document_id", "page").distinct()
    wanted = candidate_pages(pages).join(usable, ["document_id", "page"], "left_anti")
    rows = grid.word_grids(words.join(wanted, ["document_id", "page"], "left_semi"))
    body = F.transform(F.array_sort(F.collect_list(F.struct("row_idx", F.concat(F.array("label"), "cells").alias("c")))), lambda r: r["c"])
    grids = rows.groupBy("document_id", "page", "grid").agg(F.first("header").alias("_h"), F.first("col_x").alias("col_x"), body.alias("_b"))
    taken = raw.groupBy("document_id", "page").agg((F.max("table_idx") + 1).alias("_next"))
    more = grids.join(taken, ["document_id", "page"], "left").select(
        "document_id", "page", (F.coalesce("_next", F.lit(0)) + F.col("grid")).cast("int").alias("table_idx"), F.concat(F.array(F.concat(F.array(F.lit("")), "_h")), "_b").alias("rows"), "col_x",
    )
    return ruled.unionByName(table_rows(more))


def whole_tables(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """rows with tables continued over pages joined to one (L18): table_id, page, table_idx of its first part, row_idx counted
    over all parts, row_page (true page) and ref_id (that of the part) of each row. Headers of later parts are left out."""
    first = F.min_by("cells", F.coalesce("row_idx", F.lit(-1)))
    header = F.max(F.when(F.col("row_idx").isNull(), F.col("cells")))
    tables = rows.groupBy("document_id", "table_id", "page", "table_idx").agg(header.alias("header"), F.size(first).alias("n_columns"), F.first("col_x").alias("col_x"))
    headed = tables.join(anchor_lines(pages), ["document_id", "page"], "left").withColumnRenamed("headings", "heading")
    roots = grid.stitched(headed.withColumnRenamed("page", "first_page"))
    places = tables.select("document_id", F.col("table_id").alias("root"), F.col("page").alias("_page"), F.col("table_idx").alias("_idx"))
    moved = rows.join(roots.join(places, ["document_id", "root"]), ["document_id", "table_id"]).where("row_idx IS NOT NULL OR table_id = root")
    counted = F.when(F.col("row_idx").isNotNull(), F.count("row_idx").over(Window.partitionBy("document_id", "root").orderBy("page", "row_idx")) - 1)
    return moved.select("document_id", F.col("root").alias("table_id"), F.col("_page").alias("page"), F.col("_idx").alias("table_idx"), counted.cast("int").alias("row_idx"), "ref_id", "label", "cells", "col_x", F.col("page").alias("row_page"))


def built(rows: DataFrame) -> DataFrame:
    """A row for each table: header (empty if none), labels, n_rows, n_columns, columns (arrays of cells, the label aside), pages."""
    body = F.array_sort(F.collect_list(F.when(F.col("row_idx").isNotNull(), F.struct("row_idx", "cells"))))
    header = F.max(F.when(F.col("row_idx").isNull(), F.col("cells")))
    on = F.array_sort(F.collect_set("row_page" if "row_page" in rows.columns else "page"))
    out = rows.groupBy("document_id", "table_id", "page", "table_idx").agg(body.alias("_b"), F.coalesce(header, F.array().cast("array<string>")).alias("header"), on.alias("pages"))
    return _shaped(out.withColumn("_cells", F.transform("_b", lambda r: r["cells"])))


def built_whole(raw: DataFrame) -> DataFrame:
    """``built`` of the ``table_rows`` of raw tables of which each is one row (none of one page and number has two): they are not
    taken apart and grouped again."""
    some = raw.where(F.exists("rows", lambda r: F.exists(r, lambda c: c.rlike(r"(?U)\S"))))
    header = F.when(F.col("_head") == 1, F.get("_rows", F.lit(0))).otherwise(F.array().cast("array<string>"))
    body = F.slice("_rows", F.col("_head") + 1, F.size("_rows"))
    return _shaped(_clean(some).select("document_id", "table_id", "page", "table_idx", header.alias("header"), F.array("page").alias("pages"), body.alias("_cells")))


def _shaped(tables: DataFrame) -> DataFrame:
    """labels, n_rows, n_columns and columns of tables with _cells, the rows under the header."""
    width = F.coalesce(F.array_max(F.transform("_cells", F.size)), F.lit(0))
    column = lambda i: F.filter(F.transform("_cells", lambda r: F.get(r, i)), lambda c: c.isNotNull())
    out = tables.withColumn("n_columns", width)
    columns = F.when(F.col("n_columns") > 1, F.transform(F.sequence(F.lit(1), F.col("n_columns") - 1), column)).otherwise(F.array().cast("array<array<string>>"))
    labels = F.transform("_cells", lambda r: F.get(r, F.lit(0)))
    return out.select("document_id", "table_id", "page", "table_idx", "header", labels.alias("labels"), F.size("_cells").alias("n_rows"), "n_columns", columns.alias("columns"), "pages")


def is_usable(header: Column, n_rows: Column, columns: Column) -> Column:
    """Three rows, two header cells with a year, two columns most of whose cells that aren't blank are amounts."""
    filled = F.transform(columns, lambda c: F.filter(c, lambda x: x != ""))
    numeric = F.filter(filled, lambda c: F.size(F.filter(c, is_amount)) * 2 > F.size(c))
    return (n_rows >= USABLE_ROWS) & (F.size(F.filter(header, lambda h: h.rlike(YEAR))) >= 2) & (F.size(numeric) >= USABLE_COLUMNS)


def captions(tables: DataFrame, pages: DataFrame) -> DataFrame:
    """document_id, table_id, caption: the two lines above the table's first one on its page, statement headings left out.

    The first line is looked for by its first 24 characters: those of the header's cells, or of the first label. Null if
    it isn't found, or nothing stands above it.
    """
    own = F.when(F.size("header") > 0, F.array_join(F.filter("header", lambda c: c != ""), " ")).otherwise(F.coalesce(F.get("labels", F.lit(0)), F.lit("")))
    target = tables.select("document_id", "table_id", "page", F.substring(own, 1, CAPTION_CHARS).alias("_t")).where("_t <> ''")
    lines = lines_of(pages)
    first = lines.join(target, ["document_id", "page"]).where(F.col("line").startswith(F.col("_t"))).groupBy("document_id", "table_id", "page").agg(F.min("line_idx").alias("_at"))
    heads = anchors(lines).select("document_id", "page", "line_idx").distinct()
    above = first.withColumn("line_idx", F.explode(F.sequence(F.col("_at") - CAPTION_LINES, F.col("_at") - 1)))
    above = above.join(lines, ["document_id", "page", "line_idx"]).join(heads, ["document_id", "page", "line_idx"], "left_anti")
    said = F.transform(F.array_sort(F.collect_list(F.struct("line_idx", "line"))), lambda x: x["line"])
    rows = above.groupBy("document_id", "table_id").agg(F.trim(F.array_join(said, " ")).alias("caption"))
    return tables.select("document_id", "table_id").join(rows.where("caption <> ''"), ["document_id", "table_id"], "left")


def keyword_rows(labels: Column, kind: str) -> Column:
    """Of labels in lower case, those that hold a keyword of the statement."""
    return F.size(F.filter(labels, lambda label: reduce(or_, [F.contains(label, F.lit(k)) for k in KEYWORDS[kind]])))


def scores(tables: DataFrame) -> DataFrame:
    """tables with kind, hits (rows with one of its keywords) and score, a row for each kind of statement.

    What no kind changes is found once for a table, before there is a row for each kind.
    """
    found = tables.select("*", F.transform("labels", F.lower).alias("_low"), numeric_column_count(F.col("columns")).alias("_numeric"), header_years(F.col("header")).alias("_years"))
    each = F.array(*[F.struct(F.lit(k).alias("kind"), keyword_rows(F.col("_low"), k).alias("hits")) for k in KINDS])
    score = table_score(F.col("_k.hits"), F.col("_numeric"), F.col("n_rows"), F.col("_years"))
    return found.select(*tables.columns, "_numeric", "_years", F.explode(each).alias("_k")).select(*tables.columns, "_k.*", score.alias("score"))


def anchored(tables: DataFrame, pages: DataFrame) -> DataFrame:
    """document_id, kind, scope, table_id, page, score: headings with the tables of their page.

    As many headings as tables are paired in order; otherwise each heading goes with each table of the page.
    """
    page = Window.partitionBy("document_id", "page")
    kind_order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    heads = anchors(lines_of(pages)).select("document_id", "page", "line_idx", "kind", "scope")
    heads = heads.withColumn("_i", F.row_number().over(page.orderBy("line_idx", kind_order))).withColumn("_heads", F.count("*").over(page))
    places = tables.select("document_id", "page", "table_id", F.row_number().over(page.orderBy("table_idx")).alias("_j"), F.count("*").over(page).alias("_tables"))
    pairs = heads.join(places, ["document_id", "page"]).where("_heads <> _tables OR _i = _j")
    return pairs.join(scores(tables).select("document_id", "table_id", "kind", "score"), ["document_id", "table_id", "kind"]).select("document_id", "kind", "scope", "table_id", "page", "score")


def bases(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """document_id, basis, scopes (which headings count): consolidated ones; else unprefixed ones behind a 10-K cover, as
    consolidated; else standalone and unprefixed ones, as a fallback; else none."""
    has = lambda s: F.coalesce(F.bool_or(F.col("scope") == s), F.lit(False))
    cover = pages.groupBy("document_id").agg(F.bool_or(is_cover(F.col("text"))).alias("cover"))
    seen = candidates.groupBy("document_id").agg(has("consolidated").alias("c"), has("unprefixed").alias("u"), has("standalone").alias("s"))
    rows = cover.join(seen, "document_id", "left")
    named = lambda basis, *scopes: F.struct(F.lit(basis).alias("basis"), F.array(*map(F.lit, scopes)).cast("array<string>").alias("scopes"))
    which = (
        F.when(F.col("c"), named("consolidated", "consolidated"))
        .when(F.col("u") & F.col("cover"), named("consolidated", "unprefixed"))
        .when(F.col("u") | F.col("s"), named("standalone_fallback", "standalone", "unprefixed"))
        .otherwise(named("unknown"))
    )
    return rows.select("document_id", which.alias("b")).select("document_id", "b.*")


def fallbacks(tables: DataFrame, pages: DataFrame, chosen: DataFrame) -> DataFrame:
    """document_id, kind, table_id, page, score of statements that no heading gave, from tables of pages dense with numbers.

    A table that begins on a page with a heading is none of them; one of its pages must be dense; a table needs a row with a
    keyword and a score of 13; kinds choose in order, each from what those before it have left, the best score first,
    ties to the first table.
    """
    heads = anchors(lines_of(pages)).select("document_id", "page").distinct()
    dense = pages.where(is_dense(F.col("text"))).select("document_id", F.col("page").alias("_p"))
    fit = tables.join(heads, ["document_id", "page"], "left_anti").withColumn("_p", F.explode("pages")).join(dense, ["document_id", "_p"], "left_semi").select("document_id", "table_id").distinct()
    pool = scores(tables).join(fit, ["document_id", "table_id"], "left_semi").where(f"hits >= 1 AND score >= {LEAST_SCORE}")
    pool = pool.join(chosen.select("document_id", "table_id"), ["document_id", "table_id"], "left_anti").select("document_id", "kind", "table_id", "page", "table_idx", "score")
    out = None
    for kind in KINDS:
        free = pool.where(F.col("kind") == kind).join(chosen.where(F.col("kind") == kind).select("document_id"), "document_id", "left_anti")
        free = free if out is None else free.join(out.select("document_id", "table_id"), ["document_id", "table_id"], "left_anti")
        best = free.groupBy("document_id").agg(F.max_by(F.struct("kind", "table_id", "page", "score"), F.struct("score", -F.col("page"), -F.col("table_idx"))).alias("b")).select("document_id", "b.*")
        out = best if out is None else out.union(best)
    return out


def statements(raw: DataFrame, pages: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """document_id, kind, basis, table_id, page, na: for every document and kind the table that is the statement, or why
    there is none. Tables are whole: those of following pages are part of the one they continue."""
    return located(settled(built(whole_tables(report_rows(raw, pages, words), pages)), "tables"), pages)


def located(tables: DataFrame, pages: DataFrame) -> DataFrame:
    """``statements`` of tables that are built."""
    candidates = settled(anchored(tables, pages), "candidates")
    basis = bases(candidates, pages)
    counted = candidates.join(basis, "document_id").where(F.array_contains("scopes", F.col("scope")))
    chosen = settled(choose(counted.select("document_id", "kind", "table_id", "page", "score")), "chosen")
    found = chosen.unionByName(fallbacks(tables, pages, chosen)).select("document_id", "kind", "table_id", "page", "score")
    every = basis.select("document_id", "basis", F.explode(F.array(*map(F.lit, KINDS))).alias("kind"))
    out = every.join(found, ["document_id", "kind"], "left")
    na = F.when(F.col("table_id").isNull(), F.concat(F.lit("not located: no "), "kind", F.lit(" statement by heading or by score")))
    return out.select("document_id", "kind", "basis", "table_id", "page", "score", na.alias("na"))
