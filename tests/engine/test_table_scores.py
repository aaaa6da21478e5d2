import pytest
from pyspark.sql import functions as F

from statera.functions import tokens as t
from statera.operators import locate
from statera.plans import catalog

TABLES = [
    [["", "2024", "FY 2023"], ["Net  sales ", "1,000", " (800)\n"], [None, " ", ""], ["Total  assets", "n/a"], ["", "", "7", "2024"]],
    [["Net cash", "1", "2"]], [["", "2024"]], [["", " "], [None]], [], [[], ["Tax"]], None, [None, ["Sales", None, "3"]], [["x", "2024", "2024"], ["REVENUE", "5-", "+6"]],
]


def _raw(spark):
    return spark.createDataFrame([(str(i), 1, i % 2, rows) for i, rows in enumerate(TABLES)], "document_id string, page int, table_idx int, rows array<array<string>>")


def test_whole_tables_are_built_as_their_rows_are(spark):
    raw = _raw(spark)
    one, other = (sorted(map(str, f.select(sorted(f.columns)).collect())) for f in (locate.built_whole(raw), locate.built(locate.table_rows(raw))))
    assert one == other and len(one) == 6


def test_what_is_an_amount_and_what_is_blank(spark):
    cells = [None, ""] + [a + x + b for x in ["2024", "1,234", "(5)", "3-", "12a", "(2024)", "+7", "1 2", "٣", "210", "n/a"] for a in ["", "\n", " \x1c"] for b in ["", "\r\n", "\xa0 ", "\n\n"]]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    s = t.strip(F.col("c"))
    assert df.where(~(s.rlike(t.AMOUNT) & ~s.rlike(t.BARE_YEAR)).eqNullSafe(t.is_amount(F.col("c")))).count() == 0
    assert df.where(~F.array_join(t.words(F.coalesce("c", F.lit(""))), " ").eqNullSafe(t.evened(F.col("c")))).count() == 0


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_lines_of_a_table_are_shuffled_once(spark, folder):
    plan = catalog.QUERIES["table_scores"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
