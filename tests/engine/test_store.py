import pytest

from statera.plans.analysis import analyse
from statera.sources import store

from .test_analysis import ROWS, frames

IDS = ["007", "7", "a:b", "x/../y", "ünï", "%3A"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store"))
    store.save(analyse(*frames(spark, {i: ROWS for i in IDS})), path)
    return path


def test_ids_come_back_as_they_are(spark, folder):
    assert {r.document_id for r in store.load(spark, folder, "figures").select("document_id").distinct().collect()} == set(IDS)
    n = {i: store.load(spark, folder, "metrics", i).count() for i in IDS}
    assert len(set(n.values())) == 1 and n["007"] > 0
    assert {r.document_id for r in store.list_documents(spark, folder).collect()} == set(IDS)


def test_saving_again_replaces_and_deleting_hides(spark, folder):
    before = store.load(spark, folder, "figures", "7").count()
    one = dict(ROWS, income=(["2024", "2023"], [("Net sales", "5", "4")]))
    store.save(analyse(*frames(spark, {"7": one})), folder)
    rows = store.load_values(spark, folder, "7").where("concept = 'revenue' AND value IS NOT NULL").collect()
    assert [int(r.value) for r in rows] == [4_000_000, 5_000_000]
    assert store.load(spark, folder, "figures", "7").count() == before
    for i in ("a:b", "x/../y"):
        store.delete(spark, folder, i)
        assert store.load(spark, folder, "figures", i).count() == 0
    assert {r.document_id for r in store.load(spark, folder, "flags").select("document_id").distinct().collect()} == set(IDS) - {"a:b", "x/../y"}


def test_narratives(spark, folder):
    kind = "document_id string, position int, kind string, text string, cites array<string>, model string"
    store.save_narratives(spark.createDataFrame([("007", 0, "s", "old", [], "m"), ("007", 1, "i", "old", ["a"], "m")], kind), folder)
    store.save_narratives(spark.createDataFrame([("007", 2, "i", "two", ["b"], "m"), ("007", 0, "s", "new", [], "m"), ("007", 1, "i", "one", ["a"], "m")], kind), folder)
    row = store.load_narratives(spark, folder).collect()
    assert [(r.document_id, r.summary, [(x.text, x.cites) for x in r.insights]) for r in row] == [("007", "new", [("one", ["a"]), ("two", ["b"])])]


NARRATIVE = "document_id string, position int, kind string, text string, cites array<string>, model string"


@pytest.fixture
def own(spark, tmp_path):
    """A store of two documents that a test may change."""
    path = str(tmp_path / "own")
    store.save(analyse(*frames(spark, {"a": ROWS, "b": ROWS})), path)
    store.save_narratives(spark.createDataFrame([("a", 0, "s", "of the first save", [], "m"), ("b", 0, "s", "kept", [], "m")], NARRATIVE), path)
    return path


def told(spark, folder):
    return {r.document_id: r.summary for r in store.load_narratives(spark, folder).collect()}


def test_narratives_go_with_the_save_they_tell_of(spark, own):
    assert told(spark, own) == {"a": "of the first save", "b": "kept"}
    at = store.snapshot(spark, own)
    store.delete(spark, own, "a")
    assert told(spark, own) == {"b": "kept"}
    store.save(analyse(*frames(spark, {"a": ROWS})), own)
    assert told(spark, own) == {"b": "kept"}  # what was deleted does not come back beside new figures
    assert {r.document_id: r.summary for r in store.load_narratives(spark, own, at).collect()}["a"] == "of the first save"
    with pytest.raises(ValueError, match="1 documents"):
        store.save_narratives(spark.createDataFrame([("nobody", 0, "s", "x", [], "m")], NARRATIVE), own)
    row = store.list_documents(spark, own).where("document_id = 'a'").collect()[0]
    assert list(row.periods) == [2024, 2023] and row.name is None
    names = [(r.name, r.end_year) for r in store.load_metrics(spark, own, "a").collect()]
    assert names == sorted(names) and names


def test_compaction_keeps_what_is_there(spark, own):
    import os

    store.save(analyse(*frames(spark, {"a": dict(ROWS, income=(["2024", "2023"], [("Net sales", "5", "4")]))})), own)
    store.save_narratives(spark.createDataFrame([("a", 0, "s", "new", [], "m")], NARRATIVE), own)
    before = sorted(map(str, store.load(spark, own, "figures").collect()))
    store.compact(spark, own)
    assert sorted(map(str, store.load(spark, own, "figures").collect())) == before
    assert told(spark, own) == {"a": "new", "b": "kept"}
    assert [len([x for x in os.listdir(f"{own}/{t}") if x.startswith("save=")]) for t in [*store.TABLES, "insights"]] == [1] * 6
    store.delete(spark, own, "b")
    assert told(spark, own) == {"a": "new"} and store.load(spark, own, "flags", "b").count() == 0


def test_broken_rows_fail_a_save_or_are_set_apart(spark, own, monkeypatch):
    from pyspark.sql import functions as F

    real = store.figures.figures_long
    monkeypatch.setattr(store.figures, "figures_long", lambda wide: real(wide).withColumn("na", F.when(F.col("concept") != "revenue", F.col("na"))).withColumn("value", F.when(F.col("concept") != "revenue", F.col("value"))))
    result = analyse(*frames(spark, {"a": ROWS}))
    with pytest.raises(ValueError, match="2 rows of figures"):
        store.save(result, own)
    assert store.load(spark, own, "figures", "a").where("concept = 'revenue' AND value IS NOT NULL").count() == 2
    store.save(result, own, broken="quarantine")
    assert store.load(spark, own, "figures", "a").where("concept = 'revenue'").count() == 0
    assert spark.read.parquet(f"{own}/quarantine").where("document_id = 'a'").count() == 2


def test_corpus_errors_come_at_once(spark, tmp_path):
    path = tmp_path / "corpus.csv"
    path.write_text("ticker,bucket,sector,local_pdf,fiscal_year_offset,offset_evidence\nA,x,y,,-1,p. 3\nB,x,y,,,\n")
    assert [(r.ticker, r.fiscal_year_offset) for r in store.corpus(spark, str(path)).collect()] == [("A", -1), ("B", 0)]
    path.write_text(path.read_text() + "C,x,y,,-1,\n")
    with pytest.raises(ValueError, match="C"):
        store.corpus(spark, str(path))


def test_gate(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "MOST_BYTES", 20)
    for name, content in {"a.pdf": b"%PDF-1.7", "b.pdf": b"hello", "c.pdf": b"%PDF-" + b"x" * 50}.items():
        (tmp_path / name).write_bytes(content)
    got = {r.name: (r.gate_error, r.document_id is None) for r in store.gated_files(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": (None, False), "b.pdf": ("not a PDF", False), "c.pdf": ("file too large", True)}


def test_truth_and_side_files(spark, tmp_path):
    known = spark.createDataFrame([("a", "revenue", 2024, [1.25], ["t"])], "document_id string, concept string, end_year int, values array<double>, tags array<string>")
    known = known.withColumn("values", known["values"].cast("array<decimal(38,4)>"))
    store.save_truth(known, str(tmp_path / "truth"))
    offsets = spark.createDataFrame([("a", -1)], "document_id string, fiscal_year_offset int")
    row = store.load_truth(spark, str(tmp_path / "truth"), offsets).collect()[0]
    assert (row.end_year, str(row["values"][0])) == (2023, "1.2500")
    store.save_side(spark.createDataFrame([("a", "seen")], "ticker string, why string"), str(tmp_path / "exposed"))
    assert [tuple(r) for r in store.load_side(spark, str(tmp_path / "exposed"), "ticker string, why string").collect()] == [("a", "seen")]
