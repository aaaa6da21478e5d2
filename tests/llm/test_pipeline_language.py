import corpus_pipeline as p
from statera.llm import language

SF = "/root/testdata/sf0.001"
FOREIGN = [
    (10_001, "这是中文文本，没有任何拉丁字母", "en", "a", 15),
    (10_002, "Это обычный русский текст без латинских букв и слов", None, "b", 50),
    (10_003, "Привет мир, это русский текст о погоде и о телефоне, который написал John", "en", "b", 73),
    (10_004, "12 !", "en", "a", 4),
]


def test_foreign_scripts_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*p.COLUMNS)
    more = spark.createDataFrame(FOREIGN, "doc_id long, text string, lang string, source string, n_chars long")
    letters = {r.doc_id for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)}
    assert {r.doc_id for r in p.language_id(spark, docs.unionByName(more), SF).collect()} == letters
    assert 0 < language.limit(docs, language.profiles(docs)) < 0.5


def test_nothing_learnt_keeps_documents(spark):
    docs = spark.createDataFrame([(i, t, None, s, n) for i, t, _, s, n in FOREIGN] + [(1, None, None, "a", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    found = p.language_id(spark, docs, SF)
    assert found.columns == p.COLUMNS and sorted((r.doc_id, r.lang) for r in found.collect()) == [(10_001, None), (10_002, None), (10_003, None)]


def test_foreign_texts_with_a_wrong_label(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(*p.COLUMNS)
    more = spark.createDataFrame([(20_000 + i, FOREIGN[2][1] + f" {i}", "de", "a", 80) for i in range(50)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in p.language_id(spark, docs.unionByName(more), SF).collect() if r.doc_id >= 20_000} == set()
    assert p.language_id(spark, docs.unionByName(more), SF).count() == docs.where(r"text rlike '\\p{L}'").count()
