import binascii
from collections import Counter

from pyspark.sql import functions as F

from statera.llm import language, queries_text


def slow_grams(text):
    words = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text).split()
    out = Counter()
    for w in words:
        out.update(w)
        p = f" {w} "
        out.update(p[i : i + 2] for i in range(len(p) - 1))
        out.update(p[i : i + 3] for i in range(len(p) - 2) if p[i + 1] != " " and not (p[i] == p[i + 2] == " "))
    return out


def decoded(key, n):
    def name(k):
        parts = [(k >> 42) & 0x1FFFFF, (k >> 21) & 0x1FFFFF, k & 0x1FFFFF]
        return "".join(chr(x) for x in parts if x)

    return Counter({name(int(k)): int(c) for k, c in zip(key, n, strict=True)})


def test_grams():
    for text in ["The quick, 2 brown foxes", "Été à la mer ὈΔΥΣ", "a", "", "12 !?", "İstanbul"]:
        got = decoded(*language.grams(text))
        want = slow_grams(text)
        # pairs at a word's end and start both hold a space at one side
        assert got == want, text


def test_out_of_place_distance():
    learnt = {"x": [int(k) for k in language.grams("aa ab")[0]], "y": [int(k) for k in language.grams("cd ce")[0]]}
    ranks = language.Ranks(learnt)
    assert ranks.predict("ab aa")[0] == "x" and ranks.predict("ce")[0] == "y"
    key, n = language.grams("ab")
    key = [int(k) for k in key]  # all counts are one: the order is that of the keys
    off = sum(abs(learnt["x"].index(k) - i) if k in learnt["x"] else ranks.missing for i, k in enumerate(key))
    assert abs(ranks.predict("ab")[1] - (1 - off / (ranks.missing * len(key)))) < 1e-12
    assert ranks.predict("12 !") == ("und", 0.0) and ranks.predict(None) == ("und", 0.0)
    assert language.Ranks({}).predict("abc") == ("und", 0.0)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries_text.op3_language_id(spark, sf).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (binascii.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    out = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in out) / len(out) > 0.95


def test_odd_rows(spark, odd_docs):
    docs = odd_docs.withColumn("held_out", language.held_out())
    learnt = language.profiles(docs.where(~F.col("held_out")))
    rows = language.predictions(docs, learnt, ["doc_id", "held_out"]).collect()
    assert len(rows) == 10
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == {3, 4, 6}
    none = docs.limit(0)
    assert language.profiles(none) == {} and language.predictions(none, {}, ["doc_id"]).count() == 0
