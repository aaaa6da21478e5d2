"""Changes between a document's adjacent periods (C12, C13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statera.functions.maybe import NA, divide, none, reason, text
from statera.functions.vocabulary import CHANGES, CONCEPTS

CHANGE = f"struct<subject:string,from_year:int,absolute:decimal(38,18),relative:decimal(38,18),relative_na:{NA},direction:string,economic:string,na:{NA}>"


def _change(*parts: Column) -> Column:
    names = ("subject", "from_year", "absolute", "relative", "relative_na", "direction", "economic", "na")
    return F.struct(*[p.alias(n) for n, p in zip(names, parts, strict=True)])


def change(subject: str, now: Column, before: Column, from_year: Column) -> Column:
    """One change as a struct; the later side's reason is named first. No change for the oldest period: null."""
    year, sense = F.col("end_year"), CHANGES[subject]
    cause = F.coalesce(now["na"], before["na"])
    lost = reason("missing_input", text(f"{subject} change ", from_year, "->", year, ": ", cause["detail"]), cause["refs"], cause)
    kind = "decimal(38,4)" if subject in CONCEPTS else "decimal(38,18)"
    difference = F.try_subtract(now["value"], before["value"]).try_cast(kind)
    word = {1: "positive", -1: "negative"}
    direction = F.when(difference > 0, "up").when(difference < 0, "down").otherwise("flat")
    economic = F.when(difference > 0, word[sense]).when(difference < 0, word[-sense]).otherwise("neutral")
    zero = F.when(before["value"] == 0, reason("division_by_zero", f"{subject}: prior period is zero"))
    absolute = difference.try_cast("decimal(38,18)")
    made = _change(F.lit(subject), from_year, absolute, divide(difference, F.abs(before["value"]), "decimal(20,4)" if subject in CONCEPTS else "decimal(20,14)"), zero, direction, economic, none(NA))
    gone = _change(F.lit(subject), from_year, none("decimal(38,18)"), none("decimal(38,18)"), none(NA), none("string"), none("string"), lost)
    return F.when(from_year.isNull(), none(CHANGE)).when(cause.isNotNull(), gone).otherwise(made)


def with_changes(analysed: DataFrame) -> DataFrame:
    """change_<subject> for all subjects on the rows of figures.analysed; adjacency is over the document's own periods."""
    years = Window.partitionBy("document_id").orderBy("end_year")
    rows = analysed.withColumns({"prior_year": F.lag("end_year").over(years), **{f"_p_{s}": F.lag(s).over(years) for s in CHANGES}})
    rows = rows.withColumns({f"change_{s}": change(s, F.col(s), F.col(f"_p_{s}"), F.col("prior_year")) for s in CHANGES})
    return rows.drop(*[f"_p_{s}" for s in CHANGES])


def changes_long(rows: DataFrame) -> DataFrame:
    """document_id, subject, from_year, to_year, absolute, relative, relative_na, direction, economic, na."""
    cells = F.filter(F.array(*[F.col(f"change_{s}") for s in CHANGES]), lambda c: c.isNotNull())
    out = rows.select("document_id", F.col("end_year").alias("to_year"), F.explode(cells).alias("c"))
    return out.select("document_id", "c.subject", "c.from_year", "to_year", "c.absolute", "c.relative", "c.relative_na", "c.direction", "c.economic", "c.na")
