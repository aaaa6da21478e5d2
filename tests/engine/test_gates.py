from pyspark.sql import functions as F
import pytest

from statera.operators import gates

GOOD = "Revenue rose 5.2% to 8,420."


def status_of(spark, column, rows, schema):
    return [r.s for r in spark.createDataFrame(rows, schema).select("i", column.alias("s")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (GOOD, "accepted"), (None, "no text"), (" \n ", "no text"), ("Revenue rose to ٨٤٢٠.", "characters"), ("See [here](x).", "characters"), ("<b>8,420</b>", "characters"),
        ("Revenue rose to 8421.", "number not shown"), ("x" * 401, "too long"), ("x" * 400, "accepted"), ("Revenue was 8420.", "accepted"),
    ],
)
def test_insights(spark, text, want):
    column = gates.narrative_status(F.col("text"), F.array(F.lit("v1")), F.array(F.lit("8,420"), F.lit("5.2")), F.array(F.lit("v1"), F.lit("v2")))
    assert status_of(spark, column, [(1, text)], "i int, text string") == [want]


def test_citations(spark):
    rows = [(1, ["v1"]), (2, []), (3, None), (4, ["v9"]), (5, ["v1"] * 13), (6, [None])]
    column = gates.narrative_status(F.lit(GOOD), F.col("c"), F.array(F.lit("8420"), F.lit("5.2")), F.array(F.lit("v1")))
    assert status_of(spark, column, rows, "i int, c array<string>") == ["accepted", "citations", "citations", "unknown citation", "citations", "unknown citation"]
    for shown, known in ((None, ["v1"]), (["8420"], None)):
        column = gates.narrative_status(F.lit(GOOD), F.array(F.lit("v1")), F.lit(shown).cast("array<string>"), F.lit(known).cast("array<string>"))
        assert status_of(spark, column, [(1, "")], "i int, c string")[0] != "accepted"


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ('{"source_row_id": "r1", "confidence": "high", "reasoning": "label"}', "accepted"), ('{"source_row_id": "r1"}', "accepted"), ('{"source_row_id": null, "confidence": "low"}', "declined"),
        ('{"source_row_id": "r1", "confidence": "high 97"}', "not text"), ('{"source_row_id": "r1", "confidence": null}', "not text"), ('{"source_row_id": "r1", "reasoning": null}', "not text"),
        ('{"source_row_id": 12}', "number"), ('{"source_row_id": "r1", "confidence": 0.9}', "number"), ('{"source_row_id": ["r1"]}', "not text"), ('{"source_row_id": "r9"}', "unknown row"),
        ('{"source_row_id": "r2"}', "outside the statement"), ('{"source_row_id": "r3"}', "already mapped"), ("no json", "not JSON"), ('{"source_row_id": "r1", "source_row_id": null}', "not JSON"),
        ('["r1"]', "not an object"), ('{"source_row_id": "r1", "value": "3"}', "unexpected field"), ('{"confidence": "high"}', "no row"), (None, "too large"), ('{"source_row_id": "' + "x" * 70_000 + '"}', "too large"),
    ],
)
def test_answers(spark, raw, want):
    ids = lambda *x: F.array(*map(F.lit, x))
    column = gates.answer_status(F.col("raw"), ids("r1", "r2", "r3"), ids("r1", "r3"), ids("r3"))
    assert status_of(spark, column, [(1, raw)], "i int, raw string") == [want]


def test_no_refs_know_no_row(spark):
    column = gates.answer_status(F.col("raw"), F.lit(None).cast("array<string>"))
    assert status_of(spark, column, [(1, '{"source_row_id": "r1"}')], "i int, raw string") == ["unknown row"]


def test_an_accepted_answer_takes_its_row(spark):
    raw = lambda r: f'{{"source_row_id": "{r}"}}'
    rows = [("a", "revenue", 1, raw("r1")), ("a", "cogs", 2, raw("r1")), ("a", "equity", 3, raw("r2")), ("b", "cogs", 2, raw("r1")), ("a", "cash", 0, raw("r9"))]
    frame = spark.createDataFrame(rows, "document_id string, concept string, place int, raw string")
    frame = frame.withColumns({"known_refs": F.array(F.lit("r1"), F.lit("r2")), "candidates": F.array(F.lit("r1"), F.lit("r2")), "mapped": F.array().cast("array<string>")})
    got = {(r.document_id, r.concept): (r.status, r.ref_id) for r in gates.filled(frame, F.col("place")).collect()}
    assert got == {("a", "revenue"): ("accepted", "r1"), ("a", "cogs"): ("already mapped", None), ("a", "equity"): ("accepted", "r2"), ("b", "cogs"): ("accepted", "r1"), ("a", "cash"): ("unknown row", None)}


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ('{"summary": "Fine.", "insights": [{"text": "Revenue was 8,420.", "cites": ["v1"]}]}', "accepted"), ('{"summary": "Fine.", "insights": []}', "accepted"),
        ('{"summary": "Fine.", "insights": [{"text": "Good.", "cites": ["v1"]}, {"text": "It was 7.", "cites": ["v1"]}]}', "insight"), ('{"summary": "Fine.", "insights": [{"text": "Good."}]}', "insight"),
        ('{"summary": "Fine.", "insights": [{"text": "Good.", "cites": [1]}]}', "insight"), ('{"summary": "Fine.", "insights": [3]}', "insight"), ('{"summary": null, "insights": []}', "shape"),
        ('{"summary": "Fine.", "insights": {}}', "shape"), ('{"summary": "9 of 10", "insights": []}', "summary"), ("[]", "shape"), ("x", "not JSON"), (None, "too large"),
    ],
)
def test_responses(spark, raw, want):
    column = gates.response_status(F.col("raw"), F.array(F.lit("8420")), F.array(F.lit("v1")))
    assert status_of(spark, column, [(1, raw)], "i int, raw string") == [want]


def test_evidence_and_candidates(spark):
    lines = spark.createDataFrame([("a", "revenue@2024", "$ 8,420.50 of 2024"), ("a", "flag", "no number")], "document_id string, id string, line string")
    row = gates.evidence(lines).collect()[0]
    assert row.ids == ["flag", "revenue@2024"] and row.shown == ["2024", "8420.50"]
    rows = spark.createDataFrame([("a", "income", f"r{i}", i, f"Row {i}") for i in range(60)], "document_id string, kind string, ref_id string, row_idx int, label string")
    cells = spark.createDataFrame([("a", f"r{i}", float(i) if i % 4 else None) for i in range(60)], "document_id string, ref_id string, value double")
    claimed = spark.createDataFrame([("a", "r1")], "document_id string, ref_id string")
    got = [r.row_idx for r in gates.candidate_rows(rows, claimed, cells).orderBy("row_idx").collect()]
    assert got == [i for i in range(60) if i % 4 and i != 1][:40]
    missing = spark.createDataFrame([("a", "revenue"), ("a", "ebitda")], "document_id string, concept string")
    asked = gates.prompts(missing, rows.limit(2), F.lit("income")).collect()
    assert [(r.concept, r.candidates) for r in asked] == [("revenue", ["r0", "r1"])] and "- r1: Row 1" in asked[0].prompt
