import re

import pytest

from statera.llm import licenses, queries_text

BASE = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}


def split(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text):
    words = split(text)
    places = [(i, label) for label, p in BASE.items() for i in range(len(words)) if words[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def brute_matches(text, templates):
    """All starts of all templates, by counting words near their places: no index."""
    words = split(text)
    out = []
    for t in templates:
        d, n = t.drift, len(t.words)
        if len(set(t.words) & set(words)) < max(1, len(set(t.words)) - (n - t.need)):
            continue
        good = {}
        for s in range(-n, len(words) + 1):
            near = sum(any(0 <= s + j + e < len(words) and words[s + j + e] == w for e in range(-d, d + 1)) for j, w in enumerate(t.words))
            span = words[max(0, s - d) : max(0, s + n + d + max(map(len, t.keys), default=0))]
            keys = all(any(span[i : i + len(k)] == list(k) and max(0, s - d) + i <= s + n + d for i in range(len(span))) for k in t.keys)
            if near >= t.need and keys:
                good[s] = near / n
        for s, c in good.items():
            if not any(o != s and abs(o - s) <= d and (good[o], -o) > (c, -s) for o in good):
                out.append((s, t.label, t.base, n, round(c, 9)))
    return sorted(out)


def got(row):
    return sorted((m.start, m.label, m.base, m.words, round(m.cover, 9)) for m in row.matches)


def check(docs, found):
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = sorted((str(r.doc_id), *map(str, brute(r.text))) for r in docs.collect())
    rows = found.collect()
    assert sorted((str(r.doc_id), *map(str, (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels))) for r in rows) == want
    for r in rows:
        all_of = brute_matches(texts[r.doc_id], licenses.TEMPLATES)
        assert r.labels == ",".join(sorted({m[1] for m in all_of}))
        assert r.score == pytest.approx(max((m[4] for m in all_of), default=0.0))
    return rows


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = check(docs, queries_text.op7_license_scan(spark, "/root/testdata/sf0.001"))
    assert {"mit", "apache,apache-2.0"} <= {r.labels for r in rows}


def test_odd_rows(spark, odd_docs, monkeypatch):
    texts = ["MIT\x00LICENSE mit licensé mit license", "license license general public license, Apache-License", "Kit license MIT\tLicense", "İ mit", None, ""]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text").union(more)
    monkeypatch.setattr(queries_text, "read_table", lambda *a: docs)
    check(docs, queries_text.op7_license_scan(spark, ""))
    assert licenses.scan(docs.limit(0)).count() == 0


def labels(spark, text):
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert got(row) == brute_matches(text, licenses.TEMPLATES)
    return {m.label for m in row.matches}


def test_inserted_and_missing_words(spark):
    """A word more or less shifts the rest; all are still found."""
    assert labels(spark, "x Licensed under the new Apache License, Version 2.0. or so") == {"apache", "apache-2.0"}
    assert labels(spark, "Licensed, under an Apache License version 2.0") == {"apache", "apache-2.0"}
    notice = (
        "This little program is free software: you may redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    )
    assert labels(spark, notice) == {"gpl", "gpl-3"}
    assert labels(spark, notice.replace("version 3", "version 2")) == {"gpl", "gpl-2"}
    assert labels(spark, "terms of the general public good, version 3 of the license as published") == set()
    assert labels(spark, "licensed under the Apache server license version 2.0") == set()


def test_many_notices_in_a_long_text(spark):
    text = ("Released under the MIT License. " + "word " * 7 + "free software under the GNU Lesser General Public License, ") * 300
    assert labels(spark, text) == {"mit", "gpl", "lgpl"}


def test_postings_are_enough():
    """Whatever a file lacks of a template, as many postings as must agree are left."""
    for t in licenses.TEMPLATES:
        frequency = {w: i for i, w in enumerate(reversed(t.words))}
        listed = licenses.postings([t], frequency)
        assert len(listed) - (len(t.words) - t.need) >= min(licenses.AGREE, len(t.words))
