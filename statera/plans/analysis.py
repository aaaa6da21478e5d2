"""The statement pipeline as one plan over any number of documents."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statera.functions.maybe import NA, none, reason, text
from statera.functions.tokens import detect_scale, resolve_currency, resolve_scale
from statera.functions.vocabulary import CONCEPTS
from statera.operators import changes, checks, figures, fiscal, locate, mapping, rules, views
from statera.sources.scratch import settled


class Analysis:
    """Result frames, all keyed by document_id; each is planned when it is first asked for, so that one who wants figures does
    not pay for rules.

    ``statements`` (None if the caller located them) says of each statement where it is, its scale and currency, or why it gives
    no figures; that reason goes no further: the figures it would have given are missing input, as those of any row that isn't there.
    """

    def __init__(self, rows: DataFrame, columns: DataFrame, without_periods: DataFrame, statements: DataFrame | None = None) -> None:
        self.rows, self.periods, self.without_periods, self.statements = rows, columns, without_periods, statements

    @cached_property
    def cells(self) -> DataFrame:
        """Cells of numeric columns in base units, or why they are none; a cell's own scale goes before that of its row."""
        tokens = self.rows.select("document_id", "kind", "ref_id", "scale", "currency", F.posexplode("cells").alias("_pos", "token")).withColumn("col", F.col("_pos") + 1)
        tokens = tokens.withColumn("scale", F.coalesce(detect_scale(F.col("token")), "scale"))
        tokens = tokens.join(self.periods.select("document_id", "kind", "col"), ["document_id", "kind", "col"], "left_semi")
        numeric = mapping.numeric_columns(tokens, "document_id", "kind", "col").where("is_numeric")
        return mapping.normalised_cells(tokens.join(numeric.drop("is_numeric"), ["document_id", "kind", "col"], "left_semi"))

    @cached_property
    def _claims(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        found = mapping.claims(self.rows.select("document_id", "kind", "ref_id", "row_idx", "label"), self.cells)
        return mapping.resolve_claims(found, self.rows)

    @property
    def conflicts(self) -> DataFrame:
        return self._claims[1]

    @property
    def notes(self) -> DataFrame:
        return self._claims[2]

    @cached_property
    def unmapped(self) -> DataFrame:
        return mapping.unmapped(self._claims[0], self.periods)

    @cached_property
    def _figures(self) -> DataFrame:
        accepted, conflicts, _ = self._claims
        return figures.analysed(mapping.mapped_values(accepted, conflicts, self.periods, self.cells), self.periods)

    @cached_property
    def wide(self) -> DataFrame:
        """One row for each document and year with all that follows from its figures."""
        return checks.with_checks(changes.with_changes(self._figures), mapping.dash_zeros(self.cells))

    @cached_property
    def figures(self) -> DataFrame:
        return figures.figures_long(self._figures)

    @cached_property
    def units(self) -> DataFrame:
        """The scale and currency that each report's own figures are printed in, in the order of concepts, newest years first."""
        place = F.struct(F.array_position(F.array(*map(F.lit, CONCEPTS)), F.col("concept")).alias("c"), (-F.col("end_year")).alias("y"))
        grid = self._claims[0].select("document_id", "kind", "ref_id", "concept").join(self.periods.select("document_id", "kind", "col", "end_year"), ["document_id", "kind"])
        cells = grid.join(self.cells.where("na IS NULL").select("document_id", "kind", "ref_id", "col", "scale", "currency"), ["document_id", "kind", "ref_id", "col"])
        return views.units(cells.select("document_id", "scale", "currency", place.alias("place")))

    @cached_property
    def amounts(self) -> DataFrame:
        """Figures as reports print them, in their own scale and with its name."""
        return views.amounts(self.figures, self.units)

    @cached_property
    def metrics(self) -> DataFrame:
        return figures.metrics_long(self._figures)

    @cached_property
    def changes(self) -> DataFrame:
        return changes.changes_long(changes.with_changes(self._figures))

    @cached_property
    def checks(self) -> DataFrame:
        return checks.checks_long(checks.with_checks(self._figures, mapping.dash_zeros(self.cells)))

    @cached_property
    def flags(self) -> DataFrame:
        return rules.flags(self.wide).unionByName(rules.without_periods(self.without_periods))


def analyse(rows: DataFrame, headers: DataFrame) -> Analysis:
    """rows: document_id, kind, ref_id, row_idx, label, cells (tokens of the columns after the label), scale, currency;
    headers: document_id, kind, col (from 1), label. A document whose periods can't be told has flags only."""
    columns, bad = mapping.detect_periods(headers)
    return Analysis(rows, columns, bad)


def levels(found: DataFrame, tables: DataFrame, pages: DataFrame) -> DataFrame:
    """found (document_id, kind, table_id) with header, pages, scale, scale_source and currency (a code, "conflict" or "ambiguous").

    The first level that states a scale or currency decides: the table (caption and header), the pages that the statement stands
    on, the document's first page; a cell's own scale comes before them all. What a document implies comes last.
    """
    held = tables.select("document_id", "table_id", "page", "header", "labels", "pages")
    caption = locate.captions(held, pages)
    on = held.select("document_id", "table_id", F.explode("pages").alias("page")).join(pages, ["document_id", "page"])
    said = on.groupBy("document_id", "table_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n").alias("_statement"))
    first = pages.where("page = 1").groupBy("document_id").agg(F.first("text").alias("_document"))
    rows = found.join(held.drop("page"), ["document_id", "table_id"]).join(caption, ["document_id", "table_id"], "left").join(said, ["document_id", "table_id"], "left").join(first, "document_id", "left")
    table = F.array_join(F.filter(F.concat(F.array(F.coalesce("caption", F.lit(""))), "header"), lambda x: x != ""), " ")
    texts = [table, F.coalesce("_statement", F.lit("")), F.coalesce("_document", F.lit(""))]
    out = rows.withColumn("_s", resolve_scale(F.lit(""), *texts)).withColumn("currency", resolve_currency(*texts))
    return out.select(*found.columns, "header", "pages", F.col("_s.scale").alias("scale"), F.col("_s.source").alias("scale_source"), "currency")


def withheld(placed: DataFrame, rows: DataFrame, bad: DataFrame) -> DataFrame:
    """placed (``levels``) with na: why a statement gives no figures, null if it does. Its document's periods can't be told, two
    currencies are stated, none is, or no cell, table, page or document states a scale."""
    own = rows.where(F.exists(F.slice("cells", 2, F.greatest(F.size("cells"), F.lit(1))), lambda c: detect_scale(c).isNotNull())).select("document_id", "table_id").distinct()
    marked = placed.join(own.withColumn("_own", F.lit(True)), ["document_id", "table_id"], "left").join(bad.select("document_id", F.col("na").alias("_bad")), "document_id", "left")
    head = lambda said: text(F.col("kind"), f": {said}")
    na = (
        F.when(F.col("_bad").isNotNull(), reason("ambiguous", head("periods could not be resolved"), cause=F.col("_bad")))
        .when(F.col("currency") == "conflict", reason("conflict", head("two currencies within one statement")))
        .when(F.col("currency") == "ambiguous", reason("ambiguous", head("no currency stated at any level")))
        .when(F.col("scale").isNull() & F.col("_own").isNull(), reason("ambiguous", head("no scale phrase at cell, table, statement or document level")))
        .otherwise(none(NA))
    )
    return marked.withColumn("na", na).drop("_own", "_bad")


def analyse_reports(pages: DataFrame, raw: DataFrame, words: DataFrame | None = None) -> Analysis:
    """From a report's pages and tables to its figures, checks and flags.

    pages: document_id, page (from 1), text; raw: document_id, page, table_idx, rows, and col_x where it is known; words (of
    pages whose tables have no ruling): document_id, page, text, x0, x1, top.

    Tables are read (or rebuilt from words), joined over pages, matched to statements; periods are read from headers and
    reconciled with fiscal years; scale and currency come from the first level that states them. Documents whose periods
    can't be told, or that have no statement, have flags only; statements without scale or currency give no figures.
    """
    rows = settled(locate.whole_tables(locate.report_rows(raw, pages, words), pages), "rows")
    tables = settled(locate.built(rows), "tables")
    found = settled(locate.located(tables, pages), "statements")
    placed = settled(levels(found.where("table_id IS NOT NULL").select("document_id", "kind", "basis", "table_id", "page"), tables, pages), "placed")
    cells = F.posexplode(F.slice("header", 2, F.greatest(F.size("header"), F.lit(1)))).alias("_pos", "label")
    headers = placed.where(F.size("header") > 1).select("document_id", "kind", "page", cells).withColumn("col", F.col("_pos") + 1)
    columns, bad = mapping.detect_periods(headers.select("document_id", "kind", "col", "label"), placed)
    columns, unbound = fiscal.reconciled(columns, headers.select("document_id", "kind", "page", "col", "label"), pages)
    without, columns = settled(bad.unionByName(unbound), "without"), settled(columns, "columns")
    judged = settled(withheld(placed, rows, without), "judged")
    used = judged.where("na IS NULL").select("document_id", "kind", "table_id", "scale", "currency")
    body = rows.where("row_idx IS NOT NULL").drop("page", "table_idx").withColumnRenamed("row_page", "page")
    lines = used.join(body, ["document_id", "table_id"])
    lines = lines.select("document_id", "kind", "ref_id", "row_idx", "page", "label", F.slice("cells", 2, F.greatest(F.size("cells"), F.lit(1))).alias("cells"), "scale", "currency")
    nowhere = found.groupBy("document_id").agg(F.count("table_id").alias("_n")).where("_n = 0").select("document_id", none(NA).alias("na"))
    status = found.select("document_id", "kind", "basis", "table_id", "page", F.when(F.col("na").isNotNull(), reason("not_located", F.col("na"))).alias("_lost"))
    status = status.join(judged.select("document_id", "kind", "pages", "scale", "scale_source", "currency", "na"), ["document_id", "kind"], "left")
    status = status.withColumn("na", F.coalesce("na", "_lost")).withColumn("currency", F.when(F.col("na").isNull(), F.col("currency"))).drop("_lost")
    return Analysis(settled(lines, "lines"), columns, without.unionByName(nowhere), status)
