"""op3 as a whole against a plain version: profiles, predictions and scores of every document."""

import binascii
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from statera.llm import language, queries_text
from tests.llm.test_language import slow_grams


def ranked(counts, most):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:most]]


def brute(rows, learnt_docs=3_000, profile=400, own=300):
    """(doc_id, held_out, lang_pred, score) of rows of doc_id, text and lang."""
    out_of_fold = lambda doc: doc is not None and binascii.crc32(str(doc).encode()) % 3 == 1
    known = [r for r in rows if None not in r and not out_of_fold(r[0])]
    of_lang, sums = Counter(r[2] for r in known), {}
    for doc, text, lang in known:
        place = xxhash.xxh64(doc.to_bytes(8, "little", signed=True), seed=42).intdigest() % 2**30
        if place < int(2**30 * min(1.0, learnt_docs / of_lang[lang])):
            sums.setdefault(lang, Counter()).update(slow_grams(text))
    profiles = {lang: {g: i for i, g in enumerate(ranked(c, profile))} for lang, c in sums.items() if c}
    most, found = max([1, *map(len, profiles.values())]), []
    for doc, text, _ in rows:
        mine = ranked(slow_grams(text or ""), own)
        off = {lang: sum(min(most, abs(p[g] - i)) if g in p else most for i, g in enumerate(mine)) for lang, p in profiles.items()}
        best = min(sorted(off), key=off.get) if mine and off else None
        found.append((doc, out_of_fold(doc), best or "und", 1 - off[best] / (most * len(mine)) if best else 0.0))
    return found


def told(rows):
    return sorted(((str(r[0]), r[1], r[2], round(r[3], 12)) for r in rows))


def test_the_query_is_the_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]
    got = queries_text.op3_language_id(spark, sf).select("doc_id", "held_out", "lang_pred", "score").collect()
    assert told(got) == told(brute(docs))


@pytest.mark.parametrize("learnt_docs", [3_000, 1])
def test_odd_rows_and_samples(spark, odd_docs, learnt_docs):
    docs = odd_docs.select("doc_id", "text", "lang").union(spark.createDataFrame([(None, "the null id", "en"), (-5, "le chat noir", "fr"), (77, "le chat", None)], "doc_id long, text string, lang string"))
    held = docs.withColumn("held_out", language.held_out())
    learnt = language.profiles(held.where(~F.col("held_out")), learnt_docs)
    got = language.predictions(held, learnt, ["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score").collect()
    assert told(got) == told(brute([tuple(r) for r in docs.collect()], learnt_docs))
