"""Rows to concepts (M1-M9) and cells to base units (U2, U7, U11, U12): joins with small dimension frames, and claims.

Frames are keyed by document_id, kind (the statement) and ref_id (the row); row_idx orders a statement's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statera.functions.maybe import NA, none, reason, text
from statera.functions.tokens import cell_value, classify, normalise_label, once, parse_number, parse_period, scaled, strip
from statera.functions.tokens import DASHES
from statera.functions.vocabulary import BLOCKED, CONCEPTS, aliases


def alias_frame(spark: SparkSession) -> DataFrame:
    """label, kind, concept, extraction: one row for a label and statement, blocked ones left out (a few dozen rows)."""
    rows = [(label, kind, concept, how) for label, kind, concept, how, _ in aliases() if label not in BLOCKED.get(concept, [])]
    return spark.createDataFrame(rows, "label string, kind string, concept string, extraction string")


def match_labels(rows: DataFrame, label: str = "label") -> DataFrame:
    """rows (kind and a label) with norm, and concept and extraction of those whose label is known for the statement."""
    known = F.broadcast(alias_frame(rows.sparkSession).select(F.col("label").alias("norm"), "kind", "concept", "extraction"))
    return rows.withColumn("norm", normalise_label(F.col(label))).join(known, ["norm", "kind"], "left")


def numeric_columns(cells: DataFrame, *key: str) -> DataFrame:
    """key, is_numeric: whether more than half of the cells that are neither blank nor a dash parse."""
    token = strip(F.coalesce("token", F.lit("")))
    counted = once(token, lambda t: F.when((t != "") & ~t.isin(*DASHES), parse_number(t).isNotNull()))
    rows = cells.select(*key, counted.alias("_parses"))
    return rows.groupBy(*key).agg((F.count_if("_parses") * 2 > F.count("_parses")).alias("is_numeric"))


def normalised_cells(cells: DataFrame) -> DataFrame:
    """cells (token, scale, ref_id among others; numeric columns only) with value in base units, dash_zero and na."""
    kind = classify(F.col("token"), F.lit(True))
    value = once(cell_value(F.col("token"), F.col("_kind")), lambda v: scaled(v, F.col("scale")))
    out = cells.withColumn("_kind", kind).withColumn("value", value)
    ref = F.array("ref_id")
    na = (  # a cell whose scale is not told is read as it stands, but is no figure
        F.when(F.col("_kind") == "missing", reason("missing_input", "blank cell", ref))
        .when(F.col("_kind") == "unparseable", reason("unparseable", text("cannot parse '", F.col("token"), "'"), ref))
        .when(F.col("scale").isNull(), reason("ambiguous", "no scale stated at cell, table, statement or document level", ref))
        .when(F.col("value").isNull(), reason("unparseable", text("'", F.col("token"), "' exceeds the digits that fit after scaling"), ref))
        .otherwise(none(NA))
    )
    return out.withColumns({"dash_zero": F.col("_kind") == "dash_zero", "na": na}).drop("_kind")


def detect_periods(headers: DataFrame, located: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(document_id, kind, col, end_year, label), (document_id, na) from header cells: document_id, kind, col (from 1), label.

    A header cell without a year, or two columns of a statement that end in one year, leave the whole document without
    periods: it is in the second frame only. So does a statement of ``located`` (document_id, kind) that has no header cells.
    """
    cells = headers.withColumn("end_year", parse_period(F.col("label")))
    same = Window.partitionBy("document_id", "kind", "end_year")
    cells = cells.withColumn("_first", F.min("col").over(same)).withColumn("_n", F.count("*").over(same))
    why = (
        F.when(F.col("end_year").isNull(), reason("ambiguous", text("header cell yields no year: '", F.col("label"), "'")))
        .when((F.col("_n") > 1) & (F.col("col") > F.col("_first")), reason("ambiguous", text(F.col("kind"), " columns ", F.col("_first"), " and ", F.col("col"), " both resolve to ", F.col("end_year"))))
    )
    marked = cells.withColumn("na", why)
    odd = marked.where("na IS NOT NULL").select("document_id", "kind", "col", "na")
    if located is not None:
        bare = located.select("document_id", "kind").distinct().join(headers.select("document_id", "kind").distinct(), ["document_id", "kind"], "left_anti")
        odd = odd.unionByName(bare.select("document_id", "kind", F.lit(0).alias("col"), reason("ambiguous", text(F.col("kind"), " statement has no header row to read periods from")).alias("na")))
    order = F.struct(F.array_position(F.array(*map(F.lit, ["income", "balance", "cash_flow"])), F.col("kind")).alias("k"), "col")
    bad = odd.groupBy("document_id").agg(F.min_by("na", order).alias("na"))
    good = marked.join(bad.select("document_id"), "document_id", "left_anti")
    return good.select("document_id", "kind", "col", "end_year", "label"), bad


def claims(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """document_id, concept, ref_id, kind, label, extraction of rows whose label is known.

    A row of blank cells only is a section heading; a bare "Total" under it is the section's total.
    """
    blank = cells.groupBy("document_id", "kind", "ref_id").agg(F.bool_and(F.coalesce(F.col("na.reason") == "missing_input", F.lit(False))).alias("_blank"))
    found = rows.join(blank, ["document_id", "kind", "ref_id"], "left").withColumn("_heading", F.coalesce("_blank", F.lit(True)))
    norm = normalise_label(F.col("label"))
    before = Window.partitionBy("document_id", "kind").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("_section", F.last(F.when(F.col("_heading"), norm), ignorenulls=True).over(before)).where("NOT _heading")
    own = F.when((norm == "total") & (F.coalesce("_section", F.lit("")) != ""), text("total ", F.col("_section"))).otherwise(F.col("label"))
    hits = match_labels(found.withColumn("_label", own), "_label").where("concept IS NOT NULL")
    return hits.select("document_id", "concept", "ref_id", "kind", "label", "extraction")


def resolve_claims(found: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accepted claims, conflicts, notes). Of two rows for a concept the one total wins and the other is noted.

    Claims from a statement that the concept can't come from, or of a row that isn't there, are conflicts; so are more
    than two rows, or two of which not exactly one is a total.
    """
    home = F.create_map(*[F.lit(x) for pair in CONCEPTS.items() for x in pair])
    wrong = found.where(F.element_at(home, F.col("concept")) != F.col("kind"))
    here = found.where(F.element_at(home, F.col("concept")) == F.col("kind"))
    ids = rows.select("document_id", "kind", "ref_id").distinct()
    unknown = here.join(ids, ["document_id", "kind", "ref_id"], "left_anti")
    valid = here.join(ids, ["document_id", "kind", "ref_id"], "left_semi")
    norm = normalise_label(F.col("label"))
    total = (norm == "total") | norm.startswith("total ")
    per = Window.partitionBy("document_id", "concept")
    marked = valid.withColumns({
        "_total": total, "_claims": F.count("*").over(per), "_refs": F.size(F.collect_set("ref_id").over(per)), "_totals": F.count_if(total).over(per),
        "_all": F.sort_array(F.collect_list("ref_id").over(per)),
    })
    single, pair = F.col("_refs") == 1, (F.col("_refs") > 1) & (F.col("_claims") == 2) & (F.col("_totals") == 1)
    accepted = marked.where(single | (pair & F.col("_total"))).select("document_id", "concept", "ref_id", "kind", "label", "extraction").dropDuplicates(["document_id", "concept"])
    kept = marked.where(pair & F.col("_total")).select("document_id", "concept", "kind", F.col("ref_id").alias("kept_ref"))
    dropped = marked.where(pair & ~F.col("_total")).select("document_id", "concept", F.col("ref_id").alias("dropped_ref"), F.col("label").alias("dropped_label"))
    notes = kept.join(dropped, ["document_id", "concept"]).withColumn("reason", F.lit("total row preferred over component"))
    many = marked.where(~single & ~pair).select("document_id", "concept", "kind", "_claims", "_all").distinct()
    conflicts = (
        wrong.select("document_id", "concept", "kind", reason("conflict", text(F.col("concept"), " claimed from the ", F.col("kind"), " statement"), F.array("ref_id")).alias("na"))
        .union(unknown.select("document_id", "concept", "kind", reason("conflict", text(F.col("concept"), ": ref ", F.col("ref_id"), " is not a row of the located statement"), F.array("ref_id")).alias("na")))
        .union(many.select("document_id", "concept", "kind", reason("conflict", text(F.col("concept"), ": ", F.col("_claims"), " rows claim it"), F.col("_all")).alias("na")))
    )
    return accepted, conflicts, notes


def mapped_values(accepted: DataFrame, conflicts: DataFrame, columns: DataFrame, cells: DataFrame) -> DataFrame:
    """document_id, concept, end_year, value, currency, extraction, rank, refs, na: accepted claims by period, from their cells.

    A conflict over a concept of its own statement leaves it without a value in every period of that statement.
    """
    grid = accepted.join(columns.select("document_id", "kind", "col", "end_year"), ["document_id", "kind"])
    held = cells.select("document_id", "kind", "ref_id", "col", "value", "currency", F.col("na").alias("_na"), F.lit(True).alias("_there"))
    out = grid.join(held, ["document_id", "kind", "ref_id", "col"], "left")
    head = text(F.col("concept"), " ", F.col("end_year"), ": ")
    na = (
        F.when(F.col("_there").isNull(), reason("missing_input", text(head, "column holds no value"), F.array("ref_id")))
        .when(F.col("_na").isNotNull(), F.struct(F.col("_na.reason").alias("reason"), text(head, F.col("_na.detail")).alias("detail"), F.col("_na.refs").alias("refs"), F.col("_na.root_reason").alias("root_reason"), F.col("_na.root_detail").alias("root_detail")))
        .otherwise(none(NA))
    )
    some = out.select("document_id", "concept", "end_year", F.when(na.isNull(), F.col("value")).alias("value"), "currency", "extraction", capped(F.lit(2), F.col("extraction")).alias("rank"), F.array("ref_id").alias("refs"), na.alias("na"))
    home = F.create_map(*[F.lit(x) for pair in CONCEPTS.items() for x in pair])
    lost = conflicts.where((F.element_at(home, F.col("concept")) == F.col("kind")) & (F.size("na.refs") > 1)).join(columns.select("document_id", "kind", "end_year").distinct(), ["document_id", "kind"])
    gone = lost.select("document_id", "concept", "end_year", none("decimal(38,4)").alias("value"), none("string").alias("currency"), none("string").alias("extraction"), none("int").alias("rank"), F.col("na.refs").alias("refs"), "na")
    return some.union(gone)


def unmapped(accepted: DataFrame, documents: DataFrame) -> DataFrame:
    """document_id, concept of the vocabulary's concepts that no claim was accepted for."""
    every = documents.select("document_id").distinct().withColumn("concept", F.explode(F.array(*map(F.lit, CONCEPTS))))
    return every.join(accepted, ["document_id", "concept"], "left_anti")


def dash_zeros(cells: DataFrame) -> DataFrame:
    """document_id, kind, refs of the rows in which a dash was read as zero."""
    return cells.where("dash_zero").groupBy("document_id", "kind").agg(F.sort_array(F.collect_set("ref_id")).alias("refs"))


def capped(rank: Column, extraction: Column) -> Column:
    """A figure whose row a model picked is of medium rank at most."""
    return F.when(extraction == "llm_mapped", F.least(rank, F.lit(1))).otherwise(rank)
