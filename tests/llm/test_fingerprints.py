import base64
import hashlib

import numpy as np

from statera.llm import fingerprints as fp


def slow(text, k, w):
    codes = [ord(c) for c in text]
    if not codes:
        return []
    k = min(k, len(codes))
    grams = [int(fp.gram_hashes(np.array(codes[i : i + k], np.uint32), k)[0]) for i in range(len(codes) - k + 1)]
    w = min(w, len(grams))
    out = []
    for i in range(len(grams) - w + 1):
        part = grams[i : i + w]
        at = i + max(j for j, h in enumerate(part) if h == min(part))
        if not out or out[-1][0] != at:
            out.append((at, grams[at]))
    return out


def test_winnowing():
    rng = np.random.default_rng(0)
    for n in [1, 2, 5, 16, 17, 40, 300]:
        for letters in ["ab", "abcdefghij é𝔘"]:
            text = "".join(rng.choice(list(letters), n))
            for k, w in [(3, 4), (16, 32), (5, 7), (1, 1)]:
                at, h = fp.winnow(text, k, w)
                assert list(zip(at.tolist(), h.tolist(), strict=True)) == slow(text, k, w)


def test_shared_passages_share_a_hash():
    rng = np.random.default_rng(1)
    draw = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    for _ in range(100):
        passage = draw(fp.GRAM + fp.WINDOW - 1)
        a, b = (fp.winnow(draw(50) + passage + draw(70))[1] for _ in range(2))
        assert len(np.intersect1d(a, b))


def test_next_documents(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_ROWS", 3)
    rows = sorted(((r.doc_id, r.text or "") for r in odd_docs.collect()))
    got = sorted(fp.edited_fingerprints(odd_docs).collect(), key=lambda r: (r.doc_id, r.edited_sha256))
    want = []
    for i, (doc, text) in enumerate(rows):
        half, after = len(text) // 2, rows[(i + 1) % len(rows)][1]
        edited = text[: len(text) - half] + after[:half]
        want.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), base64.b64encode(fp.winnow(edited)[1].astype("<u8").tobytes()).decode()))
    assert [(r.doc_id, r.n_chars, r.edited_sha256, r.edited_fingerprint) for r in got] == sorted(want, key=lambda r: (r[0], r[2]))
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    one = fp.edited_fingerprints(odd_docs.where("doc_id = 5")).collect()
    assert one[0].near_next == 1.0 and fp.edited_fingerprints(odd_docs.limit(0)).count() == 0
    assert fp.fingerprints(odd_docs).count() == 10


def brute_winnow(text, k, w):
    """Kept places by their definition: of each window of w grams the rightmost least hash."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    k = min(k, len(codes))
    hashes = [int(fp.gram_hashes(codes[i : i + k], k)[0]) for i in range(len(codes) - k + 1)] if len(codes) else []
    w = min(w, len(hashes))
    return sorted({max(i for i in range(s, s + w) if hashes[i] == min(hashes[s : s + w])) for s in range(len(hashes) - w + 1)}) if hashes else [], hashes


def test_result_against_its_definition(spark):
    """Fingerprints, positions and likeness of the query's rows from the definition alone."""
    texts = ["", "a", "the quick brown fox jumps over the lazy dog " * 4, "aaaa" * 30, "été à la mer " * 9, "the quick brown fox jumps over a lazy cat " * 4]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in fp.edited_fingerprints(docs).collect()}

    def kept(text):
        at, hashes = brute_winnow(text, fp.GRAM, fp.WINDOW)
        return at, [hashes[i] for i in at]

    def alike(a, b):
        a, b = set(a), set(b)
        return len(a & b) / len(a | b) if a | b else 1.0

    for i, text in enumerate(texts):
        following = texts[(i + 1) % len(texts)]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        (at, own), r = kept(text), rows[i]
        assert fp.decode(r.fingerprint).tolist() == own and fp.decode(r.positions, "<u4").tolist() == at
        assert fp.decode(r.edited_fingerprint).tolist() == kept(edited)[1]
        assert r.near_edited == alike(own, kept(edited)[1]) and r.near_next == alike(own, kept(following)[1])
