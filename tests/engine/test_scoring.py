from statera.operators import evaluation
from statera.plans import text_queries

KNOWN = "document_id long, concept string, end_year int, values array<decimal(18,0)>"
VALUES = "document_id long, concept string, end_year int, value decimal(18,0), tolerance decimal(2,1), agnostic boolean"


def _scored(spark, tasks=None):
    from decimal import Decimal as D

    half = D("0.5")
    known = [(1, "a", 2000, [D(5)]), (1, "a", 2001, [D(8)]), (1, "a", 2002, [D(9)]), (1, "a", 2003, []), (2, "a", 2000, [D(5), D(6)]), (None, "a", 2000, [D(5)]), (3, "a", None, [D(5)])]
    values = [
        (1, "a", 2000, D(-5), half, False), (1, "a", 2001, D(5), half, False), (1, "a", 2002, D(7), half, False), (1, "a", 2002, D(9), half, False), (1, "a", 2003, D(1), half, False),
        (2, "a", 2000, D(-6), half, True), (2, "a", 2050, D(5), half, True), (None, "a", 2000, D(5), half, True), (4, "a", 2000, None, half, True), (3, "a", None, D(5), half, True),
    ]
    return evaluation.scored(spark.createDataFrame(values, VALUES), spark.createDataFrame(known, KNOWN), tasks)


def test_every_truth_and_value_has_an_outcome(spark):
    want = [
        (1, "a", 2000, "wrong", "sign_mismatch"), (1, "a", 2001, "wrong", "wrong_period"), (1, "a", 2002, "correct", None), (1, "a", 2002, "wrong", "value"), (1, "a", 2003, "wrong", "value"),
        (2, "a", 2000, "correct", None), (2, "a", 2050, "unverified", None), (3, "a", None, "unverified", None), (3, "a", None, "withheld", None), (4, "a", 2000, "unverified", None),
        (None, "a", 2000, "unverified", None), (None, "a", 2000, "withheld", None),
    ]
    assert sorted(map(tuple, _scored(spark).collect()), key=str) == sorted(want, key=str) == sorted(map(tuple, _scored(spark, 3).collect()), key=str)


def test_truths_and_values_meet_in_one_shuffle(spark):
    plan = _scored(spark, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_tasks_follow_the_lines(spark, tmp_path, monkeypatch):
    """A task holds so many lines at most, at any size."""
    spark.range(1000).select("id").write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(text_queries, "_LINES", 300)
    assert text_queries._tasks(spark, str(tmp_path)) == 4
