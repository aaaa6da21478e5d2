import numpy as np
from pyspark.sql import functions as F

from statera.llm import neighbours

from .test_neighbours import brute, got


def test_repeated_queries_and_near_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CANDIDATE_BLOCK", 50)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 2)
    monkeypatch.setattr(neighbours, "HEAPS", 1)
    rng = np.random.default_rng(5)
    rows = [(int(i), rng.normal(size=6).astype(np.float32).tolist()) for i in range(400)]
    near = (1001, [x + 0.001 for x in rows[100][1]])  # nearest of query 100, in a tile's list as often as it stands
    rows += [near] * 20 + [rows[200], rows[300], rows[300]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for parts in (1, 7):
        found = got(neighbours.nearest(df.coalesce(1).repartition(parts) if parts > 1 else df.coalesce(1), F.col("vec_id") % 100 == 0))
        assert found == brute(spark_rows(df), 10) and len(found) == 40


def spark_rows(df):
    return [(r.vec_id, r.embedding) for r in df.collect()]


def test_very_large_and_very_small_components(spark):
    """Squares that leave double precision, beside others of the same table that do not."""
    import math

    from pyspark.sql import functions as F

    from statera.llm import neighbours

    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=6) * size).tolist()) for i, size in enumerate([1e155, 1e200, 1e300, 1.0, 1e-170] * 8)]
    rows += [(100, rows[0][1]), (101, [1e-200, 0.0, 0.0, 0.0, 0.0, 0.0])]
    got = {}
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 3 == 0, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q, v in rows:
        if q % 3 == 0:
            want = sorted((math.dist(v, w), c) for c, w in rows if c != q)[:5]
            found = sorted(got[q])
            assert all(abs(s - d) <= 1e-12 * d for (_, _, s), (d, _) in zip(found, want, strict=True)), q
            assert [c for _, c, _ in found] == [c for _, c in want], q
