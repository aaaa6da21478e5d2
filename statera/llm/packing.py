"""Operator 4: mixture-controlled packing.

Each source is a queue of tokens. A window of ``length`` tokens serves every queue by deficit round robin: a queue's
quantum is its target share of the window, what it is owed or has been given ahead is carried to the next window; a queue
that runs out leaves its share to the others by their weights. The state after any number of windows has a closed form
(the tokens due first, ties to the earlier queue), so each task derives the deficits at its own place and no state passes
from partition to partition: they are carried exactly, all windows but the last one are full, and no source is ever a
whole token off its target by more than the rounding of others.

Where sources are few, each task asks the closed form for the windows that its documents lie in. Where they are many, the
windows' shares are a table: a task takes a range of windows, derives the state at both ends and sorts the tokens due in
between; shares and documents are joined by their place in the queue, in small blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statera.llm.common import buckets_for, caches, lean, running_start, stored

LENGTH, END_ID = 4096, 2
#: Documents of all sources in a bucket; words that a worker remembers; cells of the table of windows and sources that it
#: holds at a time.
BUCKET_ROWS, KNOWN_WORDS, CELLS = 4_096, 1_000_000, 4_000_000
#: Sources whose states are settled token by token; queues whose totals may pass the driver (more sources share queues);
#: tokens of a range of windows, and of a block of a queue in which documents and shares meet.
FEW_SOURCES, MOST_QUEUES, RANGE, BLOCK = 64, 100_000, 1 << 20, 256
#: A queue is searched token by token where it has one in more windows than these.
SPARSE = 50


#: Bytes to the characters that byte-level vocabularies write them as: printable ones stand for themselves, the rest for
#: the characters from U+0100 on.
_SAME = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = dict(zip((b for b in range(256) if b not in _SAME), range(256, 512), strict=False))


class _Known(dict):
    """Token ids of words as bytes; a word is encoded when it is first looked up."""

    def __init__(self, encode: Callable[[str], bytes]) -> None:
        super().__init__({"": b""})
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if word[-1] in ".," and word[:-1].isalpha():  # a word of letters and one stop are two tokens' texts
            ids = self[word[:-1]] + self[word[-1]]
        elif word.isascii() and word.isalpha() and not word.islower():
            ids = self[word.lower()]
        else:
            ids = self.encode(word)
        self[word] = ids
        return ids


class WordEncoder:
    """Token ids of whole texts as bytes. The tokenizer drops white space and never joins what stands on two sides of
    it, so a text's ids are those of its space-separated parts in order; parts seen before are looked up. Where a probe
    shows that a tokenizer is not of that kind, texts are encoded whole."""

    PROBE = "The Zebra, quux. Été\nx 12-3 (y)  Öl ñandú, naïve"

    def __init__(self, path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.kind = id_kind(self.tokenizer.get_vocab_size())
        # letters up to U+024F are one piece each to the model once lower-cased and mapped to the byte alphabet, if the
        # tokenizer is of that kind: probes tell
        self.direct = all(self._piece(w) == self._ids([w])[0] for w in ("the", "Zebra", "quux", "été", "Öl", "ñandú", "straße"))
        self.known = _Known(self._word)
        self.parted = b"".join(map(self.known.__getitem__, self._parts(self.PROBE))) == self._ids([self.PROBE])[0]

    def _ids(self, some: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.kind).tobytes() for x in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]

    def _piece(self, word: str) -> bytes:
        low = word.lower()
        found = self.model.tokenize(low if low.isascii() else low.encode().decode("latin-1").translate(_BYTES))
        return b"".join([x.id.to_bytes(int(self.kind[-1]), "little") for x in found])

    def _word(self, word: str) -> bytes:
        if self.direct and word.isalpha() and max(word) < "\u0250" and "İ" not in word:
            return self._piece(word)
        return self._ids([word])[0]

    @staticmethod
    def _parts(text: str) -> list[str]:
        return text.replace("\n", " ").split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.parted:
            return self._ids(texts)
        if len(self.known) > KNOWN_WORDS:
            self.known = _Known(self._word)
        look = self.known.__getitem__
        return [b"".join(map(look, self._parts(t))) for t in texts]


def id_kind(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 65_536 else "<u4"


_ENCODERS: dict[str, WordEncoder] = {}
caches("packing", _ENCODERS.clear)


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def tokenized(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, source, n_tokens and ids (bytes, 16 bits each where the vocabulary allows) with the end id; null text is empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = encoder(path)
        end, width = np.array([end_id], words.kind).tobytes(), np.dtype(words.kind).itemsize
        for b in batches:
            for i in range(0, len(b), 500):
                part = b.iloc[i : i + 500]
                ids = [x + end for x in words.encode(part.text.fillna("").tolist())]
                yield pd.DataFrame({"doc_id": part.doc_id.to_numpy(), "source": part.source.to_numpy(), "n_tokens": [len(x) // width for x in ids], "ids": ids})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "source", "text")
    out = rows.mapInPandas(lean(run, "packing"), "doc_id string, source string, n_tokens long, ids binary")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def pace(totals: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """When queues run out if all are served by their weights at once: tokens gone from all queues, and rounds, from 0."""
    ends = np.divide(totals, weights, out=np.zeros(len(totals)), where=weights > 0)
    order = np.argsort(ends, kind="stable")
    left = np.append(np.cumsum(weights[order][::-1])[::-1][1:], 0)
    return np.append(0, np.cumsum(totals[order]) + ends[order] * left), np.append(0, ends[order])


def state(totals: np.ndarray, gone: int, weights: np.ndarray) -> np.ndarray:
    """Tokens of each queue among the first ``gone`` ones, by due time and then queue: the time is bisected, and what is due
    about then is sorted, so ties cost no more than other tokens."""
    by = lambda t: np.minimum(np.floor(t * weights + 0.5), totals).astype(np.int64)
    low, high = 0.0, float(np.max(totals / weights)) + 1.0 / float(weights.min())
    while low < (mid := (low + high) / 2) < high and high - low > 1e-13 * high:
        if by(mid).sum() <= gone:
            low = mid
        else:
            high = mid
    q, top = by(low * (1 - 1e-12)), by(high * (1 + 1e-12))
    queue, at = tokens_between(q, top)
    first = np.argsort((2 * at + 1) / (2 * weights[queue]), kind="stable")[: gone - int(q.sum())]
    return q + np.bincount(queue[first], minlength=len(totals))


def tokens_between(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Queue and place of every token from ``low`` to before ``high``, queue by queue."""
    n = high - low
    queue = np.repeat(np.arange(len(n)), n)
    return queue, np.arange(len(queue)) - np.repeat(np.cumsum(n) - n, n) + low[queue]


def served_at(totals: np.ndarray, windows: np.ndarray, length: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Tokens of each queue gone after so many windows, a row for each number of windows.

    Token i of a queue of weight w is due in round (i + 1/2) / w; after g tokens those due first are gone. Weights are
    the queues' totals if none are given.
    """
    weights = totals if weights is None else weights
    every = int(totals.sum())
    gone = np.minimum(windows.astype(np.int64) * length, every)
    if len(totals) > FEW_SOURCES:
        out, some = np.zeros((len(gone), len(totals)), np.int64), totals > 0
        for row, g in enumerate(gone.tolist()):
            out[row, some] = state(totals[some], g, weights[some])
        return out
    rounds = np.interp(gone, *pace(totals, weights)) * (1 - 1e-12)  # tokens due in this very round are left to the order of queues
    q = np.minimum(np.floor(rounds[:, None] * weights + 0.5).astype(np.int64), totals)
    owed = gone - q.sum(axis=1)
    while len(rows := np.flatnonzero(owed > 0)):
        due = np.where(q[rows] < totals, (2 * q[rows] + 1) / (2 * np.maximum(weights, 1e-300)), np.inf)
        q[rows, due.argmin(axis=1)] += 1
        owed[rows] -= 1
    while len(rows := np.flatnonzero(owed < 0)):
        due = np.where(q[rows] > 0, (2 * q[rows] - 1) / (2 * np.maximum(weights, 1e-300)), -np.inf)
        q[rows, len(totals) - 1 - due[:, ::-1].argmax(axis=1)] -= 1
        owed[rows] += 1
    return q


def served(totals: np.ndarray, first: int, last: int, length: int, weights: np.ndarray | None = None) -> np.ndarray:
    """``served_at`` for ``first`` to ``last`` windows."""
    return served_at(totals, np.arange(first, last + 1), length, weights)


def deficits(totals: np.ndarray, windows: int, length: int, weights: np.ndarray | None = None) -> np.ndarray:
    """What each queue is owed after so many windows (below 0: what it has been given ahead) and carries to the next one."""
    weights = totals if weights is None else weights
    rounds = np.interp(min(windows * length, int(totals.sum())), *pace(totals, weights))
    return np.minimum(rounds * weights, totals) - served(totals, windows, windows, length, weights)[0]


def cut(start: np.ndarray, size: np.ndarray, queue: int, totals: np.ndarray, length: int, weights: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Pieces of documents that stand at ``start`` of a queue: row, start, end, window and place in it.

    When a token is due, each queue has been served its share to half a token, all of them to half their number: so many
    tokens, in windows, a token may stand before or behind the plain pace.
    """
    weighed = () if weights is None else (weights,)
    every, reach = int(totals.sum()), -(-len(totals) // (2 * length)) + 1
    gone, rounds = pace(totals, totals if weights is None else weights)
    at = lambda place: np.interp(place / (totals if weights is None else weights)[queue], rounds, gone) / length
    low = max(0, int(at(start.min())) - 2 - reach)
    high = min(-(-every // length), int(at((start + size).max())) + 3 + reach)
    if high - low > SPARSE * int(size.sum()):
        return _scattered(start, size, queue, totals, length, at, reach + 2, weights)
    step, out = max(1, CELLS // len(totals)), []
    for a in range(low, high, step):
        b = min(high, a + step)
        q = served(totals, a, b, length, *weighed)
        edges = q[:, queue]
        lead = np.diff(q[:, :queue], axis=0).sum(axis=1)
        rows = np.flatnonzero((start < edges[-1]) & (start + size > edges[0]))
        if not len(rows):
            continue
        s, e = np.maximum(start[rows], edges[0]), np.minimum((start + size)[rows], edges[-1])
        w0, w1 = np.searchsorted(edges, s, side="right") - 1, np.searchsorted(edges, e, side="left") - 1
        n = w1 - w0 + 1
        row = np.repeat(np.arange(len(rows)), n)
        w = np.repeat(w0, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        begin, end = np.maximum(edges[w], s[row]), np.minimum(edges[w + 1], e[row])
        keep = end > begin
        row, w, begin, end = row[keep], w[keep], begin[keep], end[keep]
        own = start[rows][row]
        out.append((rows[row], begin - own, end - own, w + a, lead[w] + begin - edges[w]))
    found = dict(zip(("row", "start", "end", "window", "offset"), map(np.concatenate, zip(*out, strict=True)), strict=True)) if out else {}
    held = np.bincount(found["row"], found["end"] - found["start"], len(size)) if out else np.zeros(len(size))
    if (held != size).any():
        raise ValueError(f"pieces of {int((held != size).sum())} documents of queue {queue} do not hold all of their tokens")
    return found


def _scattered(start: np.ndarray, size: np.ndarray, queue: int, totals: np.ndarray, length: int, at: Callable[[np.ndarray], np.ndarray], reach: int, weights: np.ndarray | None) -> dict[str, np.ndarray]:
    """``cut`` for a queue with a token in few windows: each token's window is sought about its plain pace, none in between."""
    row, place = tokens_between(start, start + size)
    last, out = -(-int(totals.sum()) // length), []
    span = np.arange(2 * reach + 2)
    for part in np.array_split(np.arange(len(row)), len(row) * len(span) * len(totals) // CELLS + 1):
        base = np.clip(at(place[part] + 0.5).astype(np.int64) - reach, 0, last)
        near = np.minimum(base[:, None] + span, last)
        edges = served_at(totals, near.ravel(), length, weights)[:, queue].reshape(near.shape)
        w = base + (edges <= place[part][:, None]).sum(axis=1) - 1
        q = [served_at(totals, w + i, length, weights) for i in (0, 1)]
        if not ((q[0][:, queue] <= place[part]) & (place[part] < q[1][:, queue])).all():
            raise ValueError(f"windows of queue {queue} were not found")
        begin = place[part] - start[row[part]]
        lead = (q[1] - q[0])[:, :queue].sum(axis=1)
        out.append((row[part], begin, begin + 1, w, lead + place[part] - q[0][:, queue]))
    return dict(zip(("row", "start", "end", "window", "offset"), map(np.concatenate, zip(*out, strict=True)), strict=True))


def shares(totals: np.ndarray, first: int, last: int, length: int, weights: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """What the windows from ``first`` to before ``last`` take of each queue, where that is anything: _queue, _from (place in
    the queue), _n, _window, _offset (in the window, where queues stand in their order)."""
    weights, every = totals if weights is None else weights, int(totals.sum())
    some = np.flatnonzero(totals > 0)
    ends = [state(totals[some], min(w * length, every), weights[some]) for w in (first, last)]
    queue, place = tokens_between(*ends)
    rank = np.empty(len(queue), np.int64)
    rank[np.argsort((2 * place + 1) / (2 * weights[some][queue]), kind="stable")] = np.arange(len(queue))
    window = first + rank // length
    begin = np.flatnonzero(np.append(True, (np.diff(queue) != 0) | (np.diff(window) != 0))[: len(queue)])
    n, queue, window = np.diff(np.append(begin, len(rank))), queue[begin], window[begin]
    order = np.lexsort((queue, window))
    offset = np.empty(len(n), np.int64)
    offset[order] = np.cumsum(n[order]) - n[order] - (window[order] - first) * length
    return {"_queue": some[queue].astype(np.int32), "_from": place[begin], "_n": n, "_window": window, "_offset": offset}


def _meet(queued: DataFrame, totals: np.ndarray, parts: np.ndarray | None, length: int, width: int) -> DataFrame:
    """Pieces where sources are many: documents and the windows' shares meet in blocks of their queue, each cut at blocks."""
    spark, windows = queued.sparkSession, -(-int(totals.sum()) // length)
    step = max(1, max(RANGE, 16 * len(totals)) // length)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in b["id"].tolist():
                yield pd.DataFrame(shares(totals, i * step, min(windows, (i + 1) * step), length, parts))

    ranges = -(-windows // step)
    table = spark.range(0, ranges, 1, max(1, ranges)).mapInPandas(lean(run, "packing"), "_queue int, _from long, _n long, _window long, _offset long")
    end = F.col("_from") + F.col("_n")
    blocks = lambda first, n: F.sequence(F.floor(first / BLOCK), F.floor((first + n - 1) / BLOCK))
    table = table.withColumn("_block", F.explode(blocks(F.col("_from"), F.col("_n"))))
    at, size = F.col("_start"), F.col("n_tokens")

    def piece(block):
        low, high = F.greatest(block * BLOCK, at), F.least((block + 1) * BLOCK, at + size)
        return F.struct(block.alias("_block"), low.alias("_low"), high.alias("_high"), F.substring("ids", ((low - at) * width + 1).cast("int"), ((high - low) * width).cast("int")).alias("_ids"))

    cut_up = queued.select("_queue", "doc_id", "source", "n_tokens", "_start", F.explode(F.transform(blocks(at, size), piece)).alias("_p"))
    cut_up = cut_up.select("_queue", "doc_id", "source", "n_tokens", "_start", "_p.*")
    # both sides grow with the corpus
    met = table.join(cut_up.hint("merge"), ["_queue", "_block"]).where((F.col("_low") < end) & (F.col("_from") < F.col("_high")))
    low, high = F.greatest("_low", "_from"), F.least(F.col("_high"), end)
    ids = F.substring("_ids", ((low - F.col("_low")) * width + 1).cast("int"), ((high - low) * width).cast("int"))
    if width == 2:  # to 32 bits
        ids = F.unhex(F.regexp_replace(F.hex(ids), "(.{4})", "$10000"))
    return met.select("doc_id", "source", (low - at).alias("start"), (high - low).alias("length"), ids.alias("ids"), F.col("n_tokens").alias("doc_tokens"), F.col("_window").alias("sequence_id"), (F.col("_offset") + low - F.col("_from")).alias("offset"))


def pack(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, weights: dict[str | None, float] | None = None) -> DataFrame:
    """All documents cut into sequences of ``length`` tokens, each holding the sources in their target proportions.

    ``weights`` gives every source its part of each sequence (any positive numbers; a source without one is an error); a
    source that runs out leaves its part to the others. Without weights the proportions are the corpus's own, which no
    source runs out of before the last sequence; beyond MOST_QUEUES sources, those of one hash share a queue, in which
    their documents stand in the order of a hash.

    Returns per piece: doc_id, source, start, length, ids (unsigned little-endian 32 bits), doc_tokens, sequence_id,
    offset. Only the last sequence is shorter (to be padded). A null source is a source, null text an empty document
    of its end id alone, repeated rows are documents of their own; no rows give no pieces.
    """
    tokens = stored(tokenized(docs, path, end_id), "tokens")
    sums, key = tokens.groupBy("source").agg(F.sum("n_tokens"), F.count("*")), F.col("source")
    if weights is None and sums.limit(MOST_QUEUES + 1).count() > MOST_QUEUES:
        key = F.pmod(F.xxhash64("source"), F.lit(MOST_QUEUES)).cast("string")
        sums = tokens.groupBy(key.alias("source")).agg(F.sum("n_tokens"), F.count("*"))
    rows = sorted(sums.collect(), key=lambda r: (r[0] is None, r[0] or ""))
    totals = np.array([r[1] for r in rows], np.int64)
    if weights is not None and (odd := [r[0] for r in rows if not 0 < weights.get(r[0], 0) < float("inf")]):
        raise ValueError(f"no positive weight for sources {odd[:10]}")
    parts = None if weights is None else np.array([weights[r[0]] for r in rows], float)
    names = docs.sparkSession.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "_queue int, _name string")
    n = buckets_for(sum(r[2] for r in rows), BUCKET_ROWS)
    placed = tokens.join(F.broadcast(names), key.eqNullSafe(F.col("_name"))).drop("_name")
    placed = placed.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "ids"), F.lit(n)).cast("int"))
    queued = running_start(placed, "_queue", "_bucket", [F.col("doc_id"), F.xxhash64("ids")], "n_tokens", "_start")
    if len(rows) > FEW_SOURCES:
        return _meet(queued, totals, parts, length, np.dtype(encoder(path).kind).itemsize)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kind = encoder(path).kind
        for batch in batches:
            # a bucket's documents stand next to each other in their queue
            for (queue, _), b in batch.groupby(["_queue", "_bucket"], sort=False):
                p = cut(b["_start"].to_numpy(np.int64), b["n_tokens"].to_numpy(np.int64), int(queue), totals, length, parts)
                texts, row = [np.frombuffer(x, kind).astype("<u4") for x in b["ids"]], p["row"]
                yield pd.DataFrame({
                    "doc_id": b["doc_id"].to_numpy()[row],
                    "source": b["source"].to_numpy()[row],
                    "start": p["start"],
                    "length": p["end"] - p["start"],
                    "ids": [texts[r][i:j].tobytes() for r, i, j in zip(row, p["start"], p["end"], strict=True)],
                    "doc_tokens": b["n_tokens"].to_numpy()[row],
                    "sequence_id": p["window"],
                    "offset": p["offset"],
                })

    kept = queued.select("_queue", "_bucket", F.col("doc_id").cast("string").alias("doc_id"), "source", "n_tokens", "_start", "ids")
    out = kept.mapInPandas(lean(run, "packing"), "doc_id string, source string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def sequences(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """sequence_id, tokens, padded (the length it is padded to: its own if a power of two), ids: for readers of whole sequences."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    out = pieces.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), joined.alias("ids"))
    even = F.col("tokens").bitwiseAND(F.col("tokens") - 1) == 0
    return out.withColumn("padded", F.when(even, F.col("tokens")).otherwise(F.lit(length)))
