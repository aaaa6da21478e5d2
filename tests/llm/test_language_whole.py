"""Profiles and the least score come from all documents of a language, however many there are."""

from collections import Counter

import numpy as np

from statera.llm import language
from tests.llm.test_language import slow_grams


def rows_of(spark):
    words = ["".join("abcdefghijklm"[(i * k) % 13] for k in (1, 3, 5, 7)[: i % 4 + 1]) for i in range(5_000)]
    docs = [(i, f"{words[i]} {words[(i * 7) % 5_000]}", "x" if i % 10 else "y") for i in range(5_000)]
    return docs, spark.createDataFrame(docs, "doc_id long, text string, lang string")


def test_profiles_and_least_score_of_more_than_3000_documents(spark, monkeypatch):
    monkeypatch.setattr(language, "SORTED", 500)
    docs, df = rows_of(spark)
    learnt = language.profiles(df)
    for lang in "xy":
        sums = Counter()
        for _, text, own in docs:
            if own == lang:
                sums.update(slow_grams(text))
        code = lambda g: int("".join(f"{ord(c):021b}" for c in g.ljust(3, "\0")), 2)
        assert learnt[lang] == [k for _, k in sorted((-n, code(g)) for g, n in sums.items())][: language.PROFILE]
    ranks = language.Ranks(learnt)
    scores = [np.floor(ranks.predict(t)[1] * 1000) for _, t, _ in docs]
    assert abs(language.limit(df, learnt) - language.SHARE * np.percentile(scores, 100 * language.LOW) / 1000) < 1e-9
