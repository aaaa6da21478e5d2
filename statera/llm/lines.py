"""Operator 2: line dedup by an exact set-similarity join.

A line's set is its distinct words (ASCII letters lower-cased). Words are ordered by rarity: by their count in a sketch of
the whole corpus, ties by hash. Two lines with enough in common share a word in the first few of both. A rare one of these
is indexed by itself; one that many lines hold is indexed with the next shared word, or the next two, of a prefix that is
longer by as many: what shares an entry stays few while the corpus grows. Entries carry position, length and parity.

Equal sets are joined once. Each line first meets one earlier line of an entry that the length, positional and parity
filters let pass; verified matches go, and only lines that are still there meet all other earlier lines of their entries.
A line goes if any earlier line, by doc_id, hash of the text and place, is as similar as the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statera.llm.common import dropped, few, lean, stored
from statera.llm.words import batches, graded, hashed, sketch

#: Jaccard similarity in percent; distinct words that a line needs to take part (1: every line with a word); the least and
#: most log2 of the sketch's counters (executors are sent their array, a byte each); lines or documents whose decisions
#: are sent to executors instead of being shuffled for, and bytes of these.
PERCENT, LEAST_WORDS, LEAST_BITS, MOST_BITS, BROADCAST_ROWS, BROADCAST_BYTES = 80, 1, 16, 24, 400_000, 64_000_000
#: Occurrences up to which a word is indexed by itself, and entries that a pair of words may be expected to have (more: three
#: words); words of the longest lines that are indexed by three words, and by two.
RARE, THREE_WORDS, TWO_WORDS = 512, 24, 128
#: Lines of an entry that a line is tried with on either side while entries stream by; rows that are tried at a time; occurrences
#: from which a word's entries are dealt over several tasks, and into how many at most; blocks that an entry's lines are
#: dealt into when lines that are left meet all others.
SMALL, STREAM, SPREAD, MOST_BLOCKS, SALTS = 1_024, 100_000, 1 << 20, 511, 32
#: Words of a line from which its parity has 128 bits instead of 64; words of a usual line; what tells the blocks of an entry apart.
WIDE, USUAL, BLOCK = 24, 16, 0x9E3779B97F4A7
#: What names a line, and an earlier line of a pair.
KEY, EARLIER = ["_id", "_hash", "place"], ["e_id", "e_hash", "e_place"]
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def bits_for(size: int) -> int:
    """log2 of counters for about a word in eight of a corpus of so many bytes, within limits."""
    return min(MOST_BITS, max(LEAST_BITS, int(size // 48).bit_length()))


def word_hashes(texts: list[str]) -> Iterator[np.ndarray]:
    for _, part in batches(texts):
        yield hashed(part)[0]


def ordered_sets(x: np.ndarray, line: np.ndarray, lines: int, grade: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Distinct words of each line, line after line, of smallest grade first, then by hash; with their grades."""
    room = 56 - max(1, lines).bit_length()
    key = (line.astype(np.uint64) << np.uint64(room + 8)) | (x >> np.uint64(64 - room))
    if grade is not None:
        key |= grade.astype(np.uint64) << np.uint64(room)
    by = np.argsort(key)
    x, line = x[by], line[by]
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != x[:-1]) | (line[1:] != line[:-1])
    return x[keep], line[keep], None if grade is None else grade[by][keep]


def occurrences(grades: np.ndarray) -> np.ndarray:
    """The least count of a grade."""
    x = grades.astype(np.float64)
    return np.where(x < 16, x, 2 ** (4 + np.maximum(0, x - 16) / 8)).astype(np.int64)


def entries(x: np.ndarray, line: np.ndarray, n: np.ndarray, count: np.ndarray, percent: int, often: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(line, entry, position of its first word, occurrences of that word) of all lines, line after line; x are the ordered sets.

    Of words that similar lines share, the first stands in the prefix of both, and the k-th in a prefix longer by k - 1.
    Words after the first are no rarer. So an entry of k words, the first of them in the prefix, is found if both lines
    index the first word with k words. k depends on how often the word occurs and, so that long lines have few entries,
    on a line's length; a line whose partners may be of another class of length is indexed for both classes. A word that
    occurs once is in no other line, and a set that only an equal one matches needs no entry.
    """
    least = -(-percent * n // 100)
    begin = np.cumsum(n) - n
    pos = np.arange(len(x)) - begin[line]
    first = np.flatnonzero((pos < np.where(_alone(n, percent), 0, n - least + 1)[line]) & (count > 1))
    own, often_seen = line[first], count[first]
    words = 1 + (often_seen > RARE) + (often_seen > often)
    most, fewest = (np.where(m <= THREE_WORDS, 3, np.where(m <= TWO_WORDS, 2, 1))[own] for m in (least, 100 * n // percent))
    out = []
    for k in (1, 2, 3):
        # a line's partners are indexed with ``fewest`` to ``most`` words, each with no more than the first word needs
        wanted = (np.minimum(words, most) >= k) & (np.minimum(words, fewest) <= k)
        start = first[wanted]
        last = begin[line[start]] + np.minimum(n, n - least + k)[line[start]]
        found = [(start, x[start])] if k == 1 else list(_combined(x, start, start, x[start], last, k - 1))
        out += [(i, h if k == 1 else (h ^ (h >> np.uint64(31))) * _Q) for i, h in found]
    start, sigs = np.concatenate([i for i, _ in out]), np.concatenate([h for _, h in out])
    by = np.argsort(line[start], kind="stable")
    start = start[by]
    return line[start], sigs[by].view(np.int64), pos[start], count[start]


def _combined(x: np.ndarray, start: np.ndarray, at: np.ndarray, h: np.ndarray, last: np.ndarray, more: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Starts and hashes of the words at ``at`` with each choice of ``more`` later ones before ``last``."""
    step = 1
    while len(rows := np.flatnonzero(at + step < last)):
        start, at, h, last = start[rows], at[rows], h[rows], last[rows]
        both = (h ^ (h >> np.uint64(29))) * _P + x[at + step]
        if more == 1:
            yield start, both
        else:
            yield from _combined(x, start, at + step, both, last, more - 1)
        step += 1


def indexed(keyed: DataFrame, percent: int, least_words: int, bits: int) -> DataFrame:
    """A row for each line that takes part, but for those that equal an earlier one of the same batch: _id, _hash, place
    (its number), n, d1 and d2 (digest of its set), bits and wide (parity of its words' hashes), sigs (entries), at (positions
    of their first words, times 512, and from 1 on the block that a very frequent word's entry goes to)."""
    grades = sketch(keyed, word_hashes, bits, graded)
    held = keyed.sparkSession.sparkContext.broadcast(grades)
    seen = float((np.bincount(grades, minlength=256) * occurrences(np.arange(256))).sum())
    often = max(float(RARE), (RARE * seen / USUAL) ** 0.5)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grade = held.value
        for b in parts:
            ids, hashes = b["_id"].to_numpy(), b["_hash"].to_numpy()
            for first, texts in batches(b["text"].to_pylist()):
                x, line, lines = hashed(texts)
                every = int(lines.sum())
                x, line, own = ordered_sets(x, line, every, grade[(x >> np.uint64(64 - bits)).astype(np.int64)])
                n = np.bincount(line, minlength=every)
                d1, d2, parity, wide = _digests(x, n)
                text = np.repeat(np.arange(len(texts)), lines) + first
                number = np.arange(every) - np.repeat(np.cumsum(lines) - lines, lines)
                by = np.lexsort((number, hashes[text], ids[text], d2, d1, n))
                by = by[n[by] >= least_words]
                new = np.ones(len(by), bool)
                new[1:] = (d1[by[1:]] != d1[by[:-1]]) | (d2[by[1:]] != d2[by[:-1]]) | (n[by[1:]] != n[by[:-1]])
                rows = np.sort(by[new])
                if not len(rows):
                    continue
                wanted = np.zeros(every, bool)
                wanted[rows] = True
                row = np.cumsum(wanted) - 1
                keep = wanted[line]
                at, sigs, pos, count = entries(x[keep], row[line[keep]], n[rows], occurrences(own[keep]), percent, often)
                blocks = np.minimum(MOST_BLOCKS, count // SPREAD)
                block = np.where(blocks > 0, 1 + d1[rows][at].view(np.uint64) % np.maximum(1, blocks).astype(np.uint64), 0).astype(np.int64)
                ends = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(rows))))).astype(np.int32)
                columns = [ids[text[rows]], hashes[text[rows]], number[rows], n[rows], d1[rows], d2[rows], parity[rows], wide[rows]]
                columns += [pa.ListArray.from_arrays(ends, pa.array(v)) for v in ((pos << 9) | block, sigs ^ (block * BLOCK))]
                yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v.astype(np.int64)) for v in columns], [*KEY, "n", "d1", "d2", "bits", "wide", "at", "sigs"])

    kind = "_id long, _hash long, place long, n long, d1 long, d2 long, bits long, wide long, at array<long>, sigs array<long>"
    return keyed.select("_id", "_hash", "text").mapInArrow(lean(run), kind)


def _alone(n: np.ndarray, percent: int) -> np.ndarray:
    """Whether a set of so many words can only match an equal one: not even one more word leaves enough in common.
    Equal sets are joined by their digests, so these need no index entries."""
    return 100 * n < percent * (n + 1)


def _digests(x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two sums over each line's set, and the xor of a bit of 64, or of 128 for lines from WIDE words on, for each of its
    words; none depends on order."""
    mixed = (x ^ (x >> np.uint64(32))) * _Q
    last = np.cumsum(n)
    begin = last - n

    def sums(v: np.ndarray) -> np.ndarray:
        run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(v, dtype=np.uint64)))
        return (run[last] - run[begin]).view(np.int64)

    def parity(v: np.ndarray) -> np.ndarray:
        run = np.concatenate((np.zeros(1, np.uint64), np.bitwise_xor.accumulate(v)))
        return run[last] ^ run[begin]

    bit = np.uint64(1) << (mixed >> np.uint64(58))
    second = np.where(mixed & np.uint64(1 << 57) != 0, bit, np.uint64(0))
    every, second = parity(bit), parity(second)
    second[n < WIDE] = 0
    # 64 bits of all words; those of half of them stand beside, for 128
    return sums(mixed), sums(mixed * (mixed | np.uint64(1))), every.view(np.int64), second.view(np.int64)


def keyed_texts(docs: DataFrame) -> tuple[DataFrame, int]:
    """(the rows of docs, bytes of their texts); the rows with _id (the least number for a null id), _hash and _text (null: empty).

    _hash tells texts of one id apart by 64 bits of the text and of whether the id is null; it is 0 for an id that all have
    the same text, as most have, unless too many have several to be sent to executors.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    least = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), least.alias("_id"), F.xxhash64(text, F.col("doc_id").isNull()).alias("_hash"), text.alias("_text"))
    ids = stored(rows.groupBy("_id").agg(F.min("_hash").alias("a"), F.max("_hash").alias("b"), F.sum(F.octet_length("_text")).alias("size")), "ids")
    n, size = ids.agg(F.count_if(F.expr("a <> b")), F.coalesce(F.sum("size"), F.lit(0))).collect()[0]
    if n > BROADCAST_ROWS:
        return rows, size
    if not n:
        return rows.withColumn("_hash", F.lit(0).cast("long")), size
    several = ids.where("a <> b").select("_id", F.lit(True).alias("_several"))
    marked = rows.join(F.broadcast(several), "_id", "left")
    return marked.withColumn("_hash", F.when(F.col("_several"), F.col("_hash")).otherwise(F.lit(0).cast("long"))).drop("_several"), size


def masked(lines: DataFrame) -> DataFrame:
    """_id, _hash, mask: a text's lines (place) as bytes 0 and 1, as many as up to the last 1."""
    places = F.sort_array(F.collect_set("place"))
    gap = F.transform("p", lambda p, i: F.concat(F.repeat(F.lit("0"), (p - F.coalesce(F.get("p", i - 1), F.lit(-1)) - 1).cast("int")), F.lit("1")))
    masks = lines.groupBy("_id", "_hash").agg(places.alias("p")).select("_id", "_hash", F.array_join(gap, "").cast("binary").alias("mask"))
    return few(stored(masks, "masks"), BROADCAST_ROWS, F.sum(F.length("mask")), BROADCAST_BYTES)


def _set(i: Column) -> Column:
    return F.substring("mask", i + 1, 1) == F.lit(b"1")


def sets_of(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """_id, _hash, place, tokens: the whole sets of the lines wanted, from their texts."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in parts:
            for first, texts in batches(b["line"].tolist()):
                x, line, lines = hashed(texts)
                x, line, _ = ordered_sets(x, line, len(lines), None)
                ends = np.cumsum(np.bincount(line, minlength=len(lines)))
                sets = [np.sort(v).tobytes() for v in np.split(x, ends[:-1])]
                yield b.iloc[first : first + len(texts)][KEY].assign(tokens=sets)

    rows = keyed.select("_id", "_hash", "_text").join(masked(wanted), ["_id", "_hash"])
    every = F.transform(F.split("_text", "\n", -1), lambda line, i: F.struct(i.cast("long").alias("place"), line.alias("line")))
    lines = rows.select("_id", "_hash", F.inline(F.filter(every, lambda x: _set(x["place"].cast("int")))))
    return lines.mapInPandas(lean(run), "_id long, _hash long, place long, tokens binary").dropDuplicates(KEY)


def similar_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Lines (_id, _hash, place) that are similar enough to the earlier line (e_id, e_hash, e_place) of some pair."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = np.zeros(len(b), bool)
            for i, (x, y) in enumerate(zip(b["tokens"], b["e_tokens"], strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield b.loc[keep, KEY]

    earlier = sets.select(*_earlier(), F.col("tokens").alias("e_tokens"))
    rows = pairs.join(earlier, EARLIER).join(sets, KEY)
    return rows.select(*KEY, "tokens", "e_tokens").mapInPandas(lean(run), "_id long, _hash long, place long").distinct()


def _fits(percent: int) -> Column:
    """Length, position, parity: sizes allow the similarity, what follows a first common word is enough of both, and the
    sets do not differ in more words than they may (each makes one bit of the parity differ at most)."""
    least = F.ceil((F.col("n") + F.col("e_n")) * percent / (100.0 + percent) - 1e-9)
    length = 100 * F.least("n", "e_n") >= percent * F.greatest("n", "e_n")
    position = F.least(F.col("n") - F.col("pos"), F.col("e_n") - F.col("e_pos")) >= least
    every, half = F.col("bits").bitwiseXOR(F.col("e_bits")), F.col("wide").bitwiseXOR(F.col("e_wide"))
    differ = F.when((F.col("n") < WIDE) | (F.col("e_n") < WIDE), F.bit_count(every)).otherwise(F.bit_count(every.bitwiseXOR(half)) + F.bit_count(half))
    return length & position & (differ <= F.col("n") + F.col("e_n") - 2 * least)


def _fitting(i: np.ndarray, k: int, x: dict[str, np.ndarray], percent: int) -> np.ndarray:
    """The same of entries i and those k before them, which are no longer: the places i where they fit.

    64 bits of parity settle most; where most entries are tried, neighbours are compared without gathering them.
    """
    bits, share = x["bits"], x["share"]
    if 4 * len(i) > len(bits):
        near = np.bitwise_count(bits[k:] ^ bits[:-k]) <= share[k:] + share[:-k]
        i = i[near[i - k]]
    else:
        i = i[np.bitwise_count(bits[i] ^ bits[i - k]) <= share[i] + share[i - k]]
    a, b = x["n"][i], x["n"][i - k]
    least = -(-percent * (a + b) // (100 + percent))
    every, half = bits[i] ^ bits[i - k], x["wide"][i] ^ x["wide"][i - k]
    half[b < WIDE] = 0
    differ = np.bitwise_count(every ^ half).astype(np.int64) + np.bitwise_count(half)
    rest = np.minimum(a - x["pos"][i], b - x["pos"][i - k])
    return i[(differ <= a + b - 2 * least) & (rest >= least)]


def first_fits(dealt: DataFrame, percent: int) -> DataFrame:
    """From entries sorted by sig: each line with the earliest one found to fit (open false), or open true where none is but
    not all lines of its entry were tried: those of a similar length, SMALL of them on either side, are.

    Whole entries are tried at a time; of one that fills more than a stream's chunk, only the first SMALL lines so far are
    kept, and all its lines that nothing fits are open, as are those of an entry in several blocks.
    """
    names = ["sig", *KEY, "bits", "wide", "pack"]

    def tried(x: np.ndarray, old: int, cut: bool) -> pd.DataFrame:
        size = x[6] >> 35
        by = np.lexsort((size, x[0]))
        fresh = by >= old
        x, size = x[:, by], size[by]
        order = np.empty(x.shape[1], np.int64)
        order[np.lexsort((x[3], x[2], x[1]))] = np.arange(x.shape[1])
        # of a pair's words so many may differ
        share = (size * ((100 - percent) / (100 + percent)) + 0.001).astype(np.float32)
        own = {"share": share, "n": size, "pos": x[6] >> 9 & 0x3FFFFFF, "bits": x[4].view(np.uint64), "wide": x[5].view(np.uint64)}
        begin = np.concatenate(([0], np.flatnonzero(x[0, 1:] != x[0, :-1]) + 1))
        head = np.repeat(begin, np.diff(np.append(begin, x.shape[1])))
        # the first entry of the same word that is not too short
        shortest = np.maximum(head, np.searchsorted(_ranked(head, size), _ranked(head, -(-percent * size // 100))))
        place = np.arange(x.shape[1])
        fit = np.full(x.shape[1], x.shape[1])
        i = np.flatnonzero(place > shortest)
        for k in range(1, SMALL + 1):
            i = i[i - k >= shortest[i]]
            if not len(i):
                break
            found = _fitting(i, k, own, percent)
            for late, early in ((found, found - k), (found - k, found)):
                later = order[late] > order[early]
                late, early = late[later], early[later]
                fit[late] = np.minimum(fit[late], order[early])
        short = np.zeros(x.shape[1], bool)
        short[begin[np.searchsorted(begin, i[i - SMALL > shortest[i]], side="right") - 1]] = True
        none = fit == x.shape[1]
        left = none & (cut | (x[6] & 511 > 0) | short[head])
        where = np.argsort(order)
        rows = np.flatnonzero(fresh & (left | ~none))
        early = x[1:4, where[np.where(none[rows], 0, fit[rows])]]
        return pd.DataFrame(dict(zip(names, x[:, rows], strict=True)) | dict(zip(EARLIER, early, strict=True)) | {"open": none[rows]})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = np.zeros((7, 0), np.int64)
        held, old, waiting = none, 0, [none]

        def step(last: bool) -> Iterator[pd.DataFrame]:
            nonlocal held, old, waiting
            x = np.concatenate((held, *waiting), axis=1)
            waiting = [none]
            end = x.shape[1]
            if not last:
                end = int(np.flatnonzero(x[0] != x[0, -1])[-1]) + 1 if (x[0] != x[0, -1]).any() else 0
            if old:  # the rest of a long entry, with its first lines
                rest = int((x[0] == x[0, 0]).sum())
                yield tried(x[:, :rest], old, True)
                if rest < x.shape[1] or last:
                    x, end, old = x[:, rest:], max(0, end - rest), 0
                else:
                    held = first(x)
                    old = held.shape[1]
                    return
            if end:
                yield tried(x[:, :end], 0, False)
            held = x[:, end:]
            if held.shape[1] > STREAM:
                yield tried(held, 0, True)
                held = first(held)
                old = held.shape[1]

        def first(x: np.ndarray) -> np.ndarray:
            return x[:, np.lexsort((x[3], x[2], x[1]))[:SMALL]].copy()

        for b in parts:
            waiting.append(b.to_numpy(np.int64).T)
            if sum(v.shape[1] for v in waiting) >= STREAM:
                yield from step(False)
        if held.shape[1] > old or any(v.shape[1] for v in waiting):
            yield from step(True)

    kind = ", ".join(f"{c} long" for c in [*names, *EARLIER]) + ", open boolean"
    return dealt.mapInPandas(lean(run), kind)


def _ranked(head: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Entries' places and sizes as one number each, in the order of both."""
    return (head << 32) + size


def kept_lines(keyed: DataFrame, percent: int, least_words: int, bits: int) -> DataFrame:
    """_id, _hash, place of every line that takes part and that no earlier line matches; keyed: _id, _hash, _text."""
    whole = indexed(keyed.select("_id", "_hash", F.col("_text").alias("text")), percent, least_words, bits)
    sets = whole.groupBy("d1", "d2", "n").agg(F.min(F.struct(*KEY)).alias("k"), F.first(F.struct("bits", "wide", "sigs", "at")).alias("s"))
    firsts = stored(sets.select("n", "k.*", "s.*"), "firsts")

    rows = firsts.select(*KEY, "bits", "wide", "n", F.inline(F.arrays_zip("sigs", "at")).alias("sig", "at"))
    packed = rows.select("sig", *KEY, "bits", "wide", (F.shiftleft("n", 35) + F.col("at")).alias("pack"))
    tried = stored(first_fits(packed.repartition("sig").sortWithinPartitions("sig"), percent), "tried")
    key = [*KEY, *EARLIER]
    near = stored(tried.where("NOT open").select(key).distinct(), "near")
    gone = stored(similar_pairs(near, sets_of(keyed, _lines(near)), percent), "gone")

    # lines that are still there against all earlier ones of the entries that they were tried in
    left = stored(_unpacked(tried.join(few(gone, BROADCAST_ROWS), KEY, "left_anti")), "left")
    every = _unpacked(packed).select("sig", *[F.col(c).alias(f"e_{c.strip('_')}") for c in [*KEY, "bits", "wide", "n", "pos"]])
    if (n := left.count()) > BROADCAST_ROWS:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
        left, every = left.select("*", salts), every.withColumn("_salt", F.pmod(F.xxhash64(*EARLIER), F.lit(SALTS)).cast("int"))
        both = every.join(left, ["sig", "_salt"])
    else:
        both = every.join(F.broadcast(left), "sig")
    rest = both.where(F.struct(*EARLIER) < F.struct(*KEY)).where(_fits(percent)).select(key).distinct()
    if n:
        rest = stored(rest.join(near, key, "left_anti"), "rest")
        more = similar_pairs(rest, sets_of(keyed, _lines(rest)), percent)
        gone = stored(gone.union(more).distinct(), "gone")
    kept = stored(firsts.select(*KEY).join(few(gone, BROADCAST_ROWS), KEY, "left_anti"), "kept")
    dropped(firsts, tried, near)
    return kept


def _unpacked(rows: DataFrame) -> DataFrame:
    """Entries with n and pos, under the sig that all blocks of an entry have."""
    n, pos, block = F.shiftright("pack", 35), F.shiftright("pack", 9).bitwiseAND(0x3FFFFFF), F.col("pack").bitwiseAND(511)
    return rows.select(F.col("sig").bitwiseXOR(block * F.lit(BLOCK)).alias("sig"), *KEY, "bits", "wide", n.alias("n"), pos.alias("pos"))


def _lines(pairs: DataFrame) -> DataFrame:
    return pairs.select(*KEY).union(pairs.select(*[F.col(e).alias(k) for k, e in zip(KEY, EARLIER, strict=True)])).distinct()


def _earlier() -> list[Column]:
    return [F.col(k).alias(e) for k, e in zip(KEY, EARLIER, strict=True)]


def dedup_lines(docs: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, bits: int | None = None) -> DataFrame:
    """The rows of docs, their texts without lines that an earlier line matches; n_lines and n_removed are added, in place
    of columns of these names.

    Lines end at line feeds. Earlier means a smaller doc_id (null and the least number first), or further up in the same
    text. Lines without a word stay, as do lines of fewer than ``least_words`` distinct words, if more than 1. Rows that
    repeat both id and text are treated alike; texts of a repeated or null id come in an order of their hashes (64 bits),
    each with its own lines. Null text stays null (0 lines), empty text has one line; an n_chars column is counted anew;
    all other columns, whatever their names, stay as they are; no rows give no rows.
    """
    keyed, size = keyed_texts(docs)
    masks = masked(kept_lines(keyed, percent, least_words, bits or bits_for(size)))
    rows = keyed.select("_row", "_id", "_hash").join(masks, ["_id", "_hash"], "left").withColumn("mask", F.coalesce("mask", F.lit(b"")))
    parts = F.split("_row.text", "\n", -1)
    rows = rows.select("_row", "mask", parts.alias("_parts"), F.size(parts).alias("_n"))
    every = (F.octet_length("mask") == F.col("_n")) & (F.instr(F.col("mask").cast("string"), "0") == 0)
    stay = F.filter("_parts", lambda line, i: _set(i) | ~_takes_part(line, least_words))
    rows = rows.select("_row", "_n", F.when(every, F.col("_parts")).otherwise(stay).alias("_stay"))
    new = F.when(F.size("_stay") < F.col("_n"), F.array_join("_stay", "\n")).otherwise(F.col("_row.text"))
    columns = [new.alias("text") if c == "text" else F.length(new).cast("long").alias(c) if c == "n_chars" else F.col(f"_row.`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")]
    none = F.col("_row.text").isNull()
    n_lines = F.when(none, 0).otherwise(F.col("_n")).cast("long")
    n_removed = F.when(none, 0).otherwise(F.col("_n") - F.size("_stay")).cast("long")
    return rows.select(*columns, n_lines.alias("n_lines"), n_removed.alias("n_removed"))


def _takes_part(line: Column, least_words: int) -> Column:
    """Whether a line has so many distinct words."""
    if least_words == 1:
        return line.rlike(r"[^\x20\x09-\x0D]")
    lower = F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.size(F.array_distinct(F.filter(F.split(lower, r"[\x20\x09-\x0D]+"), lambda w: w != ""))) >= least_words
