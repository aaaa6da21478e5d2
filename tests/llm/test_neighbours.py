import numpy as np
from pyspark.sql import functions as F

from statera.llm import neighbours


def brute(rows, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = []
    for q, x in {i: v for i, v in good if i % 100 == 0}.items():
        near = sorted({(float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in good if i != q and len(y) == len(x)})[:k]
        out += [(q, n + 1, i, round(s, 9)) for n, (s, i) in enumerate(near)]
    return sorted(out)


def got(df):
    return sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in df.collect())


def test_odd_vectors_and_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CANDIDATE_BLOCK", 50)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 2)
    monkeypatch.setattr(neighbours, "HEAPS", 1)
    rng = np.random.default_rng(3)
    rows = [(int(i), rng.normal(size=6).astype(np.float32).tolist()) for i in range(600)]
    rows += [(900 + i, rows[100][1]) for i in range(30)]  # ties
    rows += [(1000, None), (1100, []), (1200, [0.0] * 6), (1300, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1400, [float("nan")] * 6), (1500, [float("inf")] + [1.0] * 5), (None, rows[0][1]), (1600, [1.0, 2.0])]
    rows.append(rows[7])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).repartition(7)
    assert got(neighbours.nearest(df, F.col("vec_id") % 100 == 0)) == brute(rows, 10)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.5, 0.0])], "vec_id long, embedding array<float>")
    assert got(neighbours.nearest(df, F.col("vec_id") % 100 == 0)) == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
