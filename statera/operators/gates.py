"""Gates for a model's answers and texts (A3 to A8): a model picks rows and words; it never supplies a number.

Every gate fails closed: whatever is null, of another type or not understood is refused.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The most bytes of an answer, rows offered, insights and citations of one, characters of an insight and of a summary.
MOST_BYTES, MOST_ROWS, MOST_INSIGHTS, MOST_CITES, MOST_CHARS, MOST_SUMMARY = 65_536, 40, 8, 12, 400, 600
#: Numbers of a text, the characters that a text may have, levels of confidence.
NUMBER = r"[0-9][0-9,]*(?:\.[0-9]+)?"
PLAIN = r"""^[A-Za-z0-9 .,;:%'"()\-/&+₹$\n]*\z"""
LEVELS = ["high", "medium", "low"]
#: Concepts that are computed, never asked for.
DERIVED = ["ebitda", "free_cash_flow", "total_debt"]
_EMPTY = "array<string>"


def candidate_rows(rows: DataFrame, claimed: DataFrame, cells: DataFrame) -> DataFrame:
    """The first 40 rows of each statement that hold a value (a cell of theirs has one) and that no claim has taken."""
    valued = cells.where(F.col("value").isNotNull()).select("document_id", "ref_id").distinct()
    free = rows.join(valued, ["document_id", "ref_id"], "left_semi").join(claimed, ["document_id", "ref_id"], "left_anti")
    place = F.row_number().over(Window.partitionBy("document_id", "kind").orderBy("row_idx", "ref_id"))
    return free.withColumn("_n", place).where(F.col("_n") <= MOST_ROWS).drop("_n")


def prompts(missing: DataFrame, candidates: DataFrame, homes: Column) -> DataFrame:
    """document_id, concept, candidates (ids), prompt: what a model is asked for each missing concept (document_id, concept)
    of the statement that ``homes`` gives it. Computed concepts, and ones without a candidate, are not asked for."""
    line = F.struct("row_idx", "ref_id", F.concat(F.lit("- "), F.col("ref_id"), F.lit(": "), F.coalesce("label", F.lit(""))).alias("line"))
    listed = candidates.groupBy("document_id", "kind").agg(F.array_sort(F.collect_list(line)).alias("_rows"))
    asked = missing.where(~F.col("concept").isin(*DERIVED)).withColumn("kind", homes)
    head = F.concat(F.lit("Which one row of the statement is: "), F.replace("concept", F.lit("_"), F.lit(" ")), F.lit("? Answer null if none is.\n"))
    tail = F.lit('\nAnswer as JSON: {"source_row_id": "<id or null>", "confidence": "high|medium|low"}')
    text = F.concat(head, F.array_join(F.transform("_rows", lambda r: r["line"]), "\n"), tail)
    return asked.join(listed, ["document_id", "kind"]).select("document_id", "concept", F.transform("_rows", lambda r: r["ref_id"]).alias("candidates"), text.alias("prompt"))


def _type(v: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit(""))


def _known(ids: Column | None) -> Column:
    return F.array().cast(_EMPTY) if ids is None else F.coalesce(ids, F.array().cast(_EMPTY))


def answer_status(raw: Column, known_refs: Column, candidates: Column | None = None, mapped: Column | None = None) -> Column:
    """accepted, declined, or why an answer is refused.

    An answer is one JSON object without a repeated key: source_row_id (a known row, or null to decline) and, if there at
    all, confidence (high, medium or low) and reasoning (text). A number anywhere refuses it, and so does a row that is no
    candidate (all known ones are, if none are given) or that is mapped already. Null refs know no row.
    """
    parsed, keys = F.try_parse_json(raw), F.json_object_keys(raw)
    row = F.try_variant_get(parsed, "$.source_row_id", "string")
    has = lambda name: F.array_contains(keys, name)
    level = F.coalesce(F.try_variant_get(parsed, "$.confidence", "string"), F.lit("")).isin(*LEVELS)
    shape = _type(parsed, "$.source_row_id").isin("STRING", "VOID") & (~has("confidence") | ((_type(parsed, "$.confidence") == "STRING") & level)) & (~has("reasoning") | (_type(parsed, "$.reasoning") == "STRING"))
    refs = _known(known_refs)
    return (
        F.when(raw.isNull() | (F.octet_length(raw) > MOST_BYTES), "too large")
        .when(parsed.isNull(), "not JSON")
        .when(F.coalesce(F.schema_of_variant(parsed), F.lit("")).rlike(r"(?:^|[<:] ?)(?:BIGINT|DECIMAL|DOUBLE|FLOAT)"), "number")
        .when(keys.isNull(), "not an object")
        .when(F.size(F.array_except(keys, F.array(*map(F.lit, ["source_row_id", "confidence", "reasoning"])))) > 0, "unexpected field")
        .when(~has("source_row_id"), "no row")
        .when(~F.coalesce(shape, F.lit(False)), "not text")
        .when(row.isNull(), "declined")
        .when(~F.array_contains(refs, row), "unknown row")
        .when(~F.array_contains(refs if candidates is None else _known(candidates), row), "outside the statement")
        .when(F.array_contains(_known(mapped), row), "already mapped")
        .when(F.array_contains(refs, row), "accepted")
        .otherwise("refused")
    )


def filled(answers: DataFrame, order: Column) -> DataFrame:
    """answers (document_id, concept, raw, known_refs, candidates, mapped) with status and ref_id of accepted ones.

    Concepts are taken in ``order``; an accepted answer takes its row, so a later one for the same row is already mapped.
    """
    status = answer_status(F.col("raw"), F.col("known_refs"), F.col("candidates"), F.col("mapped"))
    row = F.try_variant_get(F.try_parse_json("raw"), "$.source_row_id", "string")
    rows = answers.withColumn("status", status).withColumn("ref_id", F.when(F.col("status") == "accepted", row))
    first = F.row_number().over(Window.partitionBy("document_id", "ref_id").orderBy(order, "concept"))
    taken = (F.col("status") == "accepted") & (first > 1)
    return rows.withColumn("_taken", taken).withColumns({"status": F.when(F.col("_taken"), "already mapped").otherwise(F.col("status")), "ref_id": F.when(~F.col("_taken"), F.col("ref_id"))}).drop("_taken")


def numbers_of(text: Column) -> Column:
    """Numbers of a text without their commas."""
    return F.transform(F.regexp_extract_all(text, F.lit(NUMBER), 0), lambda x: F.replace(x, F.lit(","), F.lit("")))


def evidence(*parts: DataFrame) -> DataFrame:
    """document_id, ids, shown (numbers without commas) of the parts' lines: document_id, id, line. A model may cite these ids
    and use the numbers that its evidence showed, no other."""
    lines = reduce(lambda a, b: a.unionByName(b), [p.select("document_id", "id", "line") for p in parts])
    each = lines.select("document_id", "id", F.explode_outer(numbers_of(F.col("line"))).alias("_n"))
    return each.groupBy("document_id").agg(F.sort_array(F.collect_set("id")).alias("ids"), F.sort_array(F.collect_set("_n")).alias("shown"))


def _prose(text: Column, shown: Column, most: int) -> list[tuple[Column, str]]:
    allowed = F.transform(_known(shown), lambda x: F.replace(x, F.lit(","), F.lit("")))
    return [
        (text.isNull(), "no text"),
        (F.length(text) > most, "too long"),
        (~text.rlike(PLAIN), "characters"),
        (F.size(F.array_except(numbers_of(text), allowed)) > 0, "number not shown"),
    ]


def _first_of(rules: list[tuple[Column, str]]) -> Column:
    """The first reason that holds; a rule that can't be told holds."""
    return F.coalesce(*[F.when(F.coalesce(broken, F.lit(True)), name) for broken, name in rules], F.lit("accepted"))


def narrative_status(text: Column, cites: Column, shown: Column, known: Column) -> Column:
    """accepted, or why an insight is refused: its citations must exist, its numbers must have been shown, its characters be
    plain, and it must say something."""
    cited = [((F.size(cites) < 1) | (F.size(cites) > MOST_CITES) | cites.isNull(), "citations"), (F.size(F.array_except(cites, _known(known))) > 0, "unknown citation")]
    return _first_of([*cited, *_prose(text, shown, MOST_CHARS), (F.length(F.trim(F.replace(text, F.lit("\n"), F.lit(" ")))) == 0, "no text")])


def summary_status(text: Column, shown: Column) -> Column:
    return _first_of(_prose(text, shown, MOST_SUMMARY))


def response_status(raw: Column, shown: Column, known: Column) -> Column:
    """accepted, or why a whole response is refused: one insight that its evidence does not bear refuses all of it.

    A response is a JSON object of summary (text) and insights (at most 8 objects of text and cites, a list of ids).
    """
    parsed = F.try_parse_json(raw)
    summary, insights = F.try_variant_get(parsed, "$.summary", "string"), F.try_variant_get(parsed, "$.insights", "array<variant>")

    def bad(x: Column) -> Column:
        cites, text = F.try_variant_get(x, "$.cites", "array<string>"), F.try_variant_get(x, "$.text", "string")
        typed = (_type(x, "$.text") == "STRING") & (_type(x, "$.cites") == "ARRAY<STRING>")
        return F.coalesce(~typed | (narrative_status(text, cites, shown, known) != "accepted"), F.lit(True))

    return _first_of([
        (raw.isNull() | (F.octet_length(raw) > MOST_BYTES), "too large"),
        (parsed.isNull(), "not JSON"),
        ((_type(parsed, "$.summary") != "STRING") | ~_type(parsed, "$.insights").startswith("ARRAY<") | insights.isNull(), "shape"),
        (F.size(insights) > MOST_INSIGHTS, "too many insights"),
        (summary_status(summary, shown) != "accepted", "summary"),
        (F.exists(insights, bad), "insight"),
    ])
