"""Accuracy against independent truth (E1-E14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Accepted lengths of an annual duration in days; tenths of companies that are held out.
ANNUAL, HOLDOUT = (350, 380), 3
OUTCOMES, SUBS = ["correct", "wrong", "withheld", "unverified"], ["sign_mismatch", "wrong_period", "value"]


def split(ticker: Column) -> Column:
    """holdout or dev by the SHA-256 of the ticker modulo ten, folded digit by digit as it has 256 bits."""
    digits = F.filter(F.split(F.sha2(ticker.cast("binary"), 256), ""), lambda c: c != "")
    rest = F.aggregate(digits, F.lit(0), lambda a, c: (a * 16 + F.instr(F.lit("0123456789abcdef"), c) - 1) % 10)
    return F.when(rest < HOLDOUT, "holdout").otherwise("dev")


def filing_as_of(filings: DataFrame, cutoff: str) -> DataFrame:
    """The newest filing of each company filed by the cut-off date (ties to the larger accession)."""
    seen = filings.where(F.col("filed") <= F.lit(cutoff).cast("date"))
    return seen.groupBy("ticker").agg(F.max_by(F.struct("accession", "filed"), F.struct("filed", "accession")).alias("f")).select("ticker", "f.*")


def annual_facts(facts: DataFrame, kind: str = "kind") -> DataFrame:
    """Facts (start, end, accession, tag, value, kind) that are an instant, or last about a year, with the year they end in."""
    days = F.datediff("end", "start")
    fits = F.when(F.col(kind) == "instant", F.col("start").isNull()).otherwise(F.col("start").isNotNull() & days.between(*ANNUAL))
    return facts.where(fits).withColumn("end_year", F.year("end"))


def truth(facts: DataFrame) -> DataFrame:
    """document_id, concept, end_year, values, tags; where one tag has two values in a year, the whole year is left out."""
    per_tag = facts.groupBy("document_id", "concept", "end_year", "tag").agg(F.min("value").alias("_low"), F.max("value").alias("_high"))
    several = F.coalesce(F.col("_low") < F.col("_high"), F.lit(False))
    rows = per_tag.groupBy("document_id", "concept", "end_year").agg(F.bool_or(several).alias("_conflict"), F.array_sort(F.collect_set("_low")).alias("values"), F.array_sort(F.collect_set("tag")).alias("tags"))
    return rows.where("NOT _conflict").drop("_conflict")


def scored(values: DataFrame, known: DataFrame, tasks: int | None = None) -> DataFrame:
    """document_id, concept, end_year, outcome, sub: one row per true value, and one per mapped value without one.

    values: document_id, concept, end_year, value, tolerance (half a printed unit), agnostic (whether signs may differ).
    tasks: into how many the rows are dealt. Both frames meet in one shuffle, a row for each document's concept.
    """
    keys = ["document_id", "concept"]
    there = F.col("document_id").isNotNull() & F.col("concept").isNotNull()
    truths = known.select(*keys, F.struct("end_year", "values").alias("_t"))
    mapped = values.select(*keys, F.struct("end_year", "value", "tolerance", "agnostic").alias("_v"))
    rows = truths.unionByName(mapped, allowMissingColumns=True)
    met = rows.where(there)
    met = met.repartition(tasks, *keys) if tasks else met
    met = met.groupBy(*keys).agg(F.collect_list("_t").alias("_all"), F.collect_list("_v").alias("_values"))
    near = lambda v, x: F.abs(v["value"] - x) <= v["tolerance"]
    sizes = lambda v, x: F.abs(F.abs(v["value"]) - F.abs(x)) <= v["tolerance"]
    loose = lambda v, x: near(v, x) | (v["agnostic"] & sizes(v, x))
    result = lambda year, outcome, sub: F.struct(year.alias("end_year"), outcome.alias("outcome"), sub.alias("sub"))
    none = F.lit(None).cast("string")

    def judged(t: Column, v: Column) -> Column:
        others = F.flatten(F.transform(F.filter("_all", lambda o: o["end_year"] != t["end_year"]), lambda o: o["values"]))
        sub = F.when(F.exists(t["values"], lambda x: sizes(v, x)), "sign_mismatch").when(F.exists(others, lambda x: loose(v, x)), "wrong_period").otherwise("value")
        hit = F.exists(t["values"], lambda x: loose(v, x))
        return F.when(v["value"].isNull(), result(t["end_year"], F.lit("withheld"), none)).when(hit, result(t["end_year"], F.lit("correct"), none)).otherwise(result(t["end_year"], F.lit("wrong"), sub))

    def of_year(t: Column) -> Column:
        own = F.transform(F.filter("_values", lambda v: v["end_year"] == t["end_year"]), lambda v: judged(t, v))
        return F.when(F.size(own) > 0, own).otherwise(F.array(result(t["end_year"], F.lit("withheld"), none)))

    extra = F.filter("_values", lambda v: ~F.coalesce(F.exists("_all", lambda t: t["end_year"] == v["end_year"]), F.lit(False)))
    extra = F.transform(extra, lambda v: result(v["end_year"], F.lit("unverified"), none))
    out = met.select(*keys, F.inline(F.concat(F.flatten(F.transform("_all", of_year)), extra)))
    alone = F.when(F.col("_t").isNotNull(), result(F.col("_t.end_year"), F.lit("withheld"), none)).otherwise(result(F.col("_v.end_year"), F.lit("unverified"), none))
    return out.union(rows.where(~there).select(*keys, alone.alias("_o")).select(*keys, "_o.*"))


def _share(a: Column, b: Column) -> Column:
    """Four decimals as text, or n/a."""
    return F.coalesce(F.format_string("%.4f", F.bround(F.try_divide(a.cast("decimal(18,0)"), b.cast("decimal(18,0)")), 4).cast("double")), F.lit("n/a"))


def summary(outcomes: DataFrame, *within: str) -> DataFrame:
    """Counts, precision, coverage and wrong rate overall, by concept and by document, in one pass of grouping sets; of each
    value of the columns ``within`` by itself."""
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES] + [F.count_if(F.col("sub") == s).alias(s) for s in SUBS]
    rows = outcomes.groupingSets([[*within], [*within, "concept"], [*within, "document_id"]], *within, "concept", "document_id").agg(*counts, F.grouping_id().alias("_g"))
    scope = F.when(F.col("_g") == 3, "all").when(F.col("_g") == 1, F.concat(F.lit("concept:"), "concept")).otherwise(F.concat(F.lit("document:"), "document_id"))
    c, w, h = F.col("correct"), F.col("wrong"), F.col("withheld")
    return rows.select(*within, scope.alias("scope"), *OUTCOMES, *SUBS, _share(c, c + w).alias("precision"), _share(c + w, c + w + h).alias("coverage"), _share(w, c + w + h).alias("wrong_rate"))


def compared(now: DataFrame, before: DataFrame) -> DataFrame:
    """scope, change in correct and wrong, regressed: more wrong, or less precision than before."""
    old = before.select("scope", F.col("correct").alias("_c"), F.col("wrong").alias("_w"), F.col("precision").alias("_p"))
    rows = now.join(old, "scope", "left")
    fell = F.col("precision").try_cast("double") < F.col("_p").try_cast("double")
    return rows.select("scope", (F.col("correct") - F.coalesce("_c", F.lit(0))).alias("correct"), (F.col("wrong") - F.coalesce("_w", F.lit(0))).alias("wrong"), F.coalesce((F.col("wrong") > F.col("_w")) | fell, F.lit(False)).alias("regressed"))


def snapshot_difference(now: DataFrame, before: DataFrame) -> DataFrame:
    """Lines that only one of two snapshots has, with + or -."""
    return now.exceptAll(before).select(F.lit("+").alias("sign"), "line").union(before.exceptAll(now).select(F.lit("-").alias("sign"), "line"))
