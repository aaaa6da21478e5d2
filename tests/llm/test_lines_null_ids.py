from statera.llm import lines


def test_many_null_ids(spark, monkeypatch):
    """Texts of null ids share nothing but the id: a line repeated in some leaves the same line of others alone."""
    said = "the same line of words stands here"
    rows = [(None, f"{said}\na{i} b{i} c{i} d{i} e{i} f{i}") for i in range(1_500)]
    rows += [(None, f"g{i} h{i} i{i} j{i} k{i} l{i}\nm{i} n{i} o{i} p{i} q{i} r{i}") for i in range(1_500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = [r.text.split("\n") for r in lines.dedup_lines(docs, least_words=1).collect()]
    kept = [x for text in found for x in text]
    assert kept.count(said) == 1
    assert sorted(kept) == sorted({x for _, text in rows for x in text.split("\n")})


def test_matches_of_null_ids_are_all_found(spark):
    """Each text has a near copy under an id of its own, which is later: all copies go."""
    rows = [(None, f"a{i} b{i} c{i} d{i} e{i} f{i} g{i} h{i} i{i}\nz{i}") for i in range(1_500)]
    rows += [(i, f"a{i} b{i} c{i} d{i} e{i} f{i} g{i} h{i} x{i}") for i in range(1_500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = lines.dedup_lines(docs, least_words=1).collect()
    assert {(r.doc_id is None, r.text == "", r.n_removed) for r in found} == {(True, False, 0), (False, True, 1)}
