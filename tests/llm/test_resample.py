import hashlib
import math
import random
import re
import zlib

import pytest

from statera.llm import queries_tables, resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, orders):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = WORD.findall(low)
    return len(words), [" ".join(words[i : i + n]) for n in range(1, orders + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, percent, orders, buckets, seed, least):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for f in features(text, orders)[1]:
                counts[bucket(f)] += 1
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[i] + 1) * (S + buckets) / ((s[i] + 1) * (T + buckets)))) for i in range(buckets)]
    out = []
    for d, text in docs:
        n, fs = features(text, orders)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in fs)
        out.append([d, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.fixture
def texts():
    rng = random.Random(5)
    words = ["the", "The", "été", "a1", "b", "c-d", "ſ", "x_y", *[f"w{i}" for i in range(60)]]
    docs = [(d, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for d in range(150)] + [(150, None), (151, ""), (151, ""), (7, "dup " * 30), (None, "nobody's " * 25)]
    return docs, [" ".join(rng.choices(words[:20], k=30)) for _ in range(9)] + [None]


@pytest.mark.parametrize("orders, known", [(1, 10**6), (3, 10**6), (3, 40)])
def test_equals_definition(spark, texts, monkeypatch, orders, known):
    docs, target = texts
    monkeypatch.setattr(resample, "KNOWN", known)
    whole = resample.word_runs
    monkeypatch.setattr(resample, "word_runs", lambda t, table, carried: whole(t, table, carried, 20))
    df = spark.createDataFrame([(d, x, "en", 0, 0) for d, x in docs], "doc_id long, text string, lang string, score long, rank long")
    got = resample.resampled(df, spark.createDataFrame([(x,) for x in target], "text string"), 25, orders, 500, 7, 10)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, target, 25, orders, 500, 7, 10)


def test_query_and_odd_rows(spark, odd_docs, texts, monkeypatch):
    target = texts[1]
    tables = {"documents": odd_docs, "benchmark": spark.createDataFrame([(x,) for x in target], "text string")}
    monkeypatch.setattr(queries_tables, "read_table", lambda s, f, name, *c: tables[name].select(*c))
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = sorted((tuple(r) for r in queries_tables.op13_importance_resampling(spark, "").collect()), key=str)
    assert got == brute(docs, target, 10, 1, 10_000, 2024, 20)
    assert resample.resampled(odd_docs.limit(0), tables["benchmark"]).count() == 0
    assert resample.resampled(odd_docs, tables["benchmark"].limit(0), 50, keep=["doc_id", "text"]).where("rank IS NOT NULL").select("doc_id", "text").count() == 0


def test_ranks_follow_one_order_over_all_ranges(spark):
    from pyspark.sql import functions as F

    rows = spark.range(5000).select((F.col("id") % 7).alias("score"), F.col("id").alias("_id"), F.col("id").alias("_row"))
    got = resample.ranked(rows.repartition(6), [F.desc("score"), F.asc("_id"), F.asc("_row")], 4321).collect()
    want = {r[1]: i + 1 for i, r in enumerate(sorted(((-(i % 7)), i) for i in range(5000)))}
    assert all(r["rank"] == (want[r["_id"]] if want[r["_id"]] <= 4321 else None) for r in got)
