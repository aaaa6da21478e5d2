import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from statera.plans import catalog


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    """Order lines in two files, the second larger (so read first): most keys of the first recur there with another label."""
    folder = tmp_path_factory.mktemp("repeated")
    (folder / "lineitem.parquet").mkdir()
    for name, n in (("a", 400), ("b", 4_000)):
        i = range(n)
        columns = {"l_orderkey": [x // 4 for x in i], "l_partkey": [x * (3 if name == "a" else 7) % 11 for x in i], "l_suppkey": [x % 5 for x in i]}
        pq.write_table(pa.table({**columns, "l_linenumber": pa.array([x % 4 + 1 for x in i], pa.int32())}), folder / "lineitem.parquet" / f"{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["claim_conflicts", "total_wins_notes", "unmapped_concepts"])
def test_of_repeated_lines_the_first_counts(spark, repeated, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{repeated}/lineitem.parquet/*.parquet'")
    want = con.sql(catalog.ORACLE[name])
    got = catalog.QUERIES[name](spark, repeated).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
