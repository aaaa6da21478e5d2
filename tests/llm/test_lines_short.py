import random

import numpy as np
import pytest

from statera.llm import lines, queries_near

from .test_lines import brute, got


def test_short_lines_of_the_query(spark, monkeypatch):
    rows = [(1, "Read more\nHome\n\none two three four"), (2, "read  more\nHome\n\none two three four five\nmore"), (3, "Home Read more\ntwo one\none two four three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(queries_near, "read_table", lambda *a: docs)
    found = got(queries_near.op2_line_dedup(spark, ""))
    assert found == brute(rows, least=1)
    assert [(d, t) for d, t, _ in found][1:] == [(2, "\nmore"), (3, "Home Read more\ntwo one")]


@pytest.mark.parametrize("percent", [50, 70, 80, 95])
def test_random_short_lines(spark, percent):
    rng = random.Random(percent)
    rows = [(i, "\n".join(" ".join(rng.choices("abcdefgh", k=rng.randrange(8))) for _ in range(4))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(lines.dedup_lines(docs, percent, least_words=1)) == brute(rows, percent, 1)


def test_table_with_short_lines(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(queries_near.op2_line_dedup(spark, "/root/testdata/sf0.001")) == brute(rows, least=1)


def test_sizes_that_only_equal_sets_match():
    assert lines._alone(np.arange(1, 7), 80).tolist() == [True] * 3 + [False] * 3
