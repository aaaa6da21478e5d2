from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from statera.functions import tokens as t


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def test_numbers(spark):
    good = {"1,234": 1234, "12,34,567": 1234567, "1234.5": Decimal("1234.5"), "(540.0)": -540, "540-": -540, "-540": -540, "+7": 7, "$ 12": 12, "Rs. 3,000": 3000, "₹45": 45, "12*": 12, "( 12 )": -12, "0": 0, "999,999,999,999.25": Decimal("999999999999.25")}
    bad = ["1,2345", "12,34", "", "abc", "1,23,4567", "१२", "1 2", "--1", "1.2.3"]
    assert column(spark, list(good), t.parse_number) == [Decimal(v) for v in good.values()]
    assert column(spark, bad, t.parse_number) == [None] * len(bad)


def test_cells(spark):
    got = column(spark, ["-", "—", "Nil", "", " ", "12", "1,2345", "n/a", "$"], lambda x: t.classify(x, F.lit(True)))
    assert got == ["dash_zero", "dash_zero", "dash_zero", "missing", "missing", "number", "unparseable", "unparseable", "missing"]
    assert column(spark, ["-", "abc", "12"], lambda x: t.classify(x, F.lit(False))) == ["text", "text", "number"]


def test_scales_and_currencies(spark):
    assert column(spark, ["in crores", "Lacs", "millions", "$ bn", "'000", "none", "crore of millions"], t.detect_scale) == ["crore", "lakh", "million", "billion", "thousand", None, "crore"]
    assert column(spark, ["₹ in lakhs", "Rs. crore", "US dollars", "$", "euro"], t.detect_currency) == ["INR", "INR", "USD", "USD", None]


def test_periods(spark):
    got = column(spark, ["FY 2023-24", "2023-2024", "As at March 31, 2024", "1999-00", "n/a", "12024", "2024/25"], t.parse_period)
    assert got == [2024, 2024, 2024, 2000, None, None, 2025]


@pytest.mark.parametrize("label,norm", [("(a) Total assets*", "total assets"), ("1. Cash & cash equivalents (Note 4)", "cash and cash equivalents"), ("Stockholders' equity", "stockholders equity"), ("Stockholders’ equity", "stockholders equity"), ("  Net   sales(a)", "net sales"), ("Crédit d’impôt", "crédit d impôt")])
def test_labels(spark, label, norm):
    assert column(spark, [label], t.normalise_label) == [norm]


def test_predicates(spark):
    assert column(spark, ["1,234", "(12)", "2024", "x", "12-"], t.is_amount) == [True, True, False, False, True]
    assert column(spark, ["a/b\\c.pdf", "", "x/"], t.display_name)[0] == "c.pdf"
