import zlib

import corpus_pipeline as p

from .test_packing import check

SF = "/root/testdata/sf0.001"


def test_result_holds_the_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*p.COLUMNS)
    rows = check(docs, p.packing_sequences(spark, docs, SF), 4096)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows)


def test_whole_run_returns_them(spark):
    rows = p.run(spark, SF).collect()
    assert rows and all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
