from pyspark.sql import functions as F

from statera.operators import layout


def test_words_of_a_page_are_counted_by_place_before_they_are_ordered(spark):
    rows = spark.range(30_000).select((F.col("id") % 2).alias("key"), "id", (F.col("id") % 3 * 100).cast("double").alias("x")).union(spark.createDataFrame([(0, -1, 400.0)], "key long, id long, x double"))
    spans = layout.column_spans(rows.select("key", "x"))
    assert sorted(map(tuple, spans.collect())) == [(k, c, 100.0 * c - 100, 100.0 * c - 100) for k in (0, 1) for c in (1, 2, 3)]
    found = layout.in_columns(rows, spans)
    assert {(r.column, r["count"]) for r in found.groupBy("column").count().collect()} == {(c, 10_000) for c in (1, 2, 3)}
    plan = spans._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan.split("Window", 1)[1]  # below the window: one row for each place
