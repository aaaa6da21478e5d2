import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parents[2]))

import corpus_pipeline as p  # noqa: E402
from statera.llm import lines, mixing  # noqa: E402

from .test_lines import brute as brute_lines  # noqa: E402
from .test_packing import check as check_packing  # noqa: E402
from .test_similar import brute as brute_near  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_each_stage_on_its_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = p.stored(p.language_id(spark, docs, SF), "t")
    letters = {r.doc_id for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)}
    assert {r.doc_id for r in one.collect()} == letters and one.columns == p.COLUMNS
    two = p.stored(p.line_dedup(spark, one, SF), "t")
    want = [(d, t) for d, t, _ in brute_lines([(r.doc_id, r.text) for r in one.collect()]) if re.search(mixing.WORD, t)]
    assert sorted((r.doc_id, r.text) for r in two.collect()) == sorted(want)
    three = p.stored(p.ngram_jaccard_join(spark, two, SF), "t")
    near = brute_near([(r.doc_id, r.text) for r in two.collect()], 5, 80)
    assert sorted(r.doc_id for r in three.collect()) == sorted(d for d, _, c in near if d == c)
    four = p.stored(p.mixing_sources(spark, three, SF), "t")
    count = lambda rows: {s: sum(len(re.findall(mixing.WORD, r.text)) for r in rows if r.source == s) for s in {r.source for r in rows}}
    had, got = count(three.collect()), count(four.collect())
    names = sorted(had)
    for name, target in zip(names, mixing.targets([had[n] for n in names]), strict=True):
        assert abs(got[name] - target) <= 1
    five = p.packing_sequences(spark, four, SF).collect()
    assert sum(r.length for r in five) == sum(r.doc_tokens for r in five if r.start == 0)
    assert p.run(spark, SF).count() == len(five)


def test_odd_rows(spark, odd_docs):
    docs = odd_docs
    for _, stage in p.STAGES:
        docs = p.stored(stage(spark, docs, SF), "t")
    assert docs.count() > 0 and lines.PERCENT == 80 and check_packing
    docs = odd_docs.limit(0)
    for _, stage in p.STAGES:
        docs = p.stored(stage(spark, docs, SF), "t")
    assert docs.count() == 0
