import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from statera.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(docs, pieces, length):
    tok = Tokenizer.from_file(PATH)
    want = {}
    for r in docs.collect():
        want.setdefault(r.doc_id, []).append([*tok.encode(r.text or "", add_special_tokens=False).ids, 2])
    rows = pieces.collect()
    got, seqs = {}, {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length > 0
        got.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, ids))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, lists in want.items():
        for ids in lists:
            mine = sorted(got[(doc, len(ids))])
            copies = sum(x == ids for x in lists)
            for start in {s for s, _ in mine}:
                assert sum(s == start for s, _ in mine) % copies == 0
            joined = np.zeros(len(ids), int)
            for s, part in mine:
                joined[s : s + len(part)] = part
            assert joined.tolist() == ids
            assert sum(len(p) for _, p in mine) == len(ids) * copies
    total = sum(len(x) for v in want.values() for x in v)
    assert sum(r.length for r in rows) == total
    for k, parts in seqs.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == length if k < max(seqs) else at == total - length * max(seqs)
    return rows


def test_odd_rows(spark, odd_docs):
    check(odd_docs, packing.pack(odd_docs, PATH, length=64), 64)


def test_whole_table_and_proportions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = check(docs, packing.pack(docs, PATH), 4096)
    total, by_source, by_window = 0, {}, {}
    for r in rows:
        total += r.length
        by_source[r.source] = by_source.get(r.source, 0) + r.length
        by_window[(r.sequence_id, r.source)] = by_window.get((r.sequence_id, r.source), 0) + r.length
    for (w, s), n in by_window.items():
        if w < total // 4096:
            assert abs(n - 4096 * by_source[s] / total) <= 3


def test_empty(spark, odd_docs):
    assert packing.pack(odd_docs.limit(0), PATH).count() == 0


@pytest.mark.parametrize("totals", [[1, 5, 100_000], [7], [3, 3, 3, 3], list(range(1, 60))])
def test_queues_never_go_back_and_fill_every_window(totals):
    t = np.array(totals)
    n = -(-t.sum() // 16)
    q = packing.served(t, 0, n, 16)
    assert (np.diff(q, axis=0) >= 0).all() and (q[-1] == t).all()
    assert (q.sum(axis=1) == np.minimum(np.arange(n + 1) * 16, t.sum())).all()
    assert (packing.served(t, n // 2, n, 16) == q[n // 2 :]).all()


def test_sequences_hold_their_ids(spark, odd_docs):
    pieces = packing.pack(odd_docs, PATH, length=64)
    rows = packing.sequences(pieces, 64).collect()
    assert all(len(r.ids) == 4 * r.tokens and r.tokens <= r.padded <= 64 for r in rows)
    assert zlib.crc32(b"") == 0
