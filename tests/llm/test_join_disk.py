import os

from statera.llm import common, similar


def _shuffled(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_"))


def _docs(spark):
    rows = [(i, " ".join(f"w{(i // 2 * 2) * 1000 + j}" for j in range(300))) for i in range(400)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_a_sketch_leaves_no_shuffle_files(spark):
    before = _shuffled(spark)
    grades = similar.sketch(_docs(spark), 3, 22)
    assert grades.sum() > 0 and _shuffled(spark) - before < 100_000


def test_only_entries_of_several_nodes_are_dealt(spark):
    rows = spark.createDataFrame([(1, 10, 0, 5, 0), (2, 10, 0, 5, 1), (2, 10, 0, 6, 2), (3, 10, 0, 7, 0), (4, 10, 0, 7, 0), (5, 10, 0, 7, 3)], "node long, n long, core long, sig long, pos int")
    assert sorted((r.node, r.sig, r.pos) for r in similar.shared(rows).collect()) == [(1, 5, 0), (2, 5, 1), (3, 7, 0), (4, 7, 0), (5, 7, 3)]


def test_what_is_indexed_goes_once_it_is_dealt(spark):
    folder = f"{common.scratch(spark).removeprefix('file://')}/statera"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    found = similar.near_duplicates(_docs(spark))
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before}
    assert {(r.doc_id, r.component_id) for r in found.collect()} == {(i, i // 2 * 2) for i in range(400)}
    assert not left & {"indexed", "numbered", "counts", "sketch"}
