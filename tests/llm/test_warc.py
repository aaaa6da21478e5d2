import hashlib

import numpy as np
import pytest

from statera.llm import warc

FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


@pytest.fixture
def pages(spark):
    same = "<p>" + "same " * 40
    rows = [
        (1, "http://a", "<p>é" + FAKE + "rest " * 30, 1), (2, "http://b", same, 1), (3, None, same, 1), (4, "http://c d\r\nX: y", None, 1),
        (5, "u", "", 1), (6, "u", "short", 1), (7, "u", "short", 1), (3, None, same, 1), (8, "u", FAKE * 20, 1), (9, "u", "WWARC/1.0\r\n\r\n\r\n" * 3, 1),
        (10, "u", "x" * 300_000 + FAKE, 1), (None, "u", "nobody", 1), (11, "u", "a\r\n\r\nb\r\n", 1),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest int")


def want(rows):
    first = {}
    for r in rows:
        h = r.html or ""
        if len(h.encode()) >= 100 and r.page_id is not None:
            first[h] = min(first.get(h, r.page_id), r.page_id)
    out = []
    for r in rows:
        h = r.html or ""
        lead = first.get(h, r.page_id)
        out.append((r.page_id, len(h.encode()), hashlib.sha256(h.encode()).hexdigest(), "response" if lead == r.page_id else "revisit", None if lead == r.page_id else lead))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


@pytest.mark.parametrize("segment", [64 << 20, 1_000])
@pytest.mark.parametrize("split", ["134217728", "700"])
def test_round_trip(spark, pages, monkeypatch, split, segment):
    monkeypatch.setattr(warc, "SEGMENT", segment)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        assert got(warc.round_trip(pages.coalesce(2))) == want(pages.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_without_broadcast(spark, pages, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", -1)
    assert got(warc.round_trip(pages)) == want(pages.collect())


def test_empty(spark, pages):
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_jumps():
    start, following = np.array([0, 5, 7, 12]), np.array([7, 7, 12, 20])
    assert warc.reached(start, following, 0).tolist() == [True, False, True, True]
    assert warc.leaves(start, following).tolist() == [20, 20, 20, 20]
    assert warc.reached(start, following, 3).tolist() == [False] * 4
