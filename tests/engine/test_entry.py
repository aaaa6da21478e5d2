import importlib

import duckdb
import pytest

import __spark_entry__ as entry
from statera.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", ["metrics_long_with_reasons", "reconciliation_checks", "classify_cells", "label_match", "eval_summary", "choose_statement_set", "page_clusters", "text_layer_probe", "red_flag_messages", "metric_rows", "eval_compare", "candidate_pages", "token_column_range_join"])
def test_queries_equal_their_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(([plain(x) for x in r] for r in df.select(*columns).collect()), key=str)
    want = sorted(([plain(x) for x in r] for r in duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({catalog.ORACLE[name]})").fetchall()), key=str)
    assert got == want


def test_entry(spark):
    assert importlib.reload(entry).entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
