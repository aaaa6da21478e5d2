"""Operator 7: licence scan by a positional rare-token index, with DataFrame functions only.

Templates are word sequences of licence notices. The index holds, for each template, postings (word, template, position)
of its words of highest IDF in the corpus: as many as a file may lack and still hold enough of the template, and two more.
So a file that holds the template has two of them at the template's distance. A file's licence words of highest IDF
are looked up; postings that agree on where the template starts, give or take the words a file may have put in or left
out, are intersected; there the template's words are counted, and its key phrases must stand whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statera.llm.common import stored
from statera.llm.license_texts import BASE, NOTICES

#: Lower-case ASCII letters and digits, and all that is not ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Share of a template's words that must stand near their places; words that a notice may be shifted by, at most; postings
#: that must agree.
COVER, DRIFT, AGREE = 0.75, 3, 2


def split_words(text: str) -> list[str]:
    return re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


@dataclass(frozen=True)
class Template:
    """words, phrases that must stand whole within them; base phrases are matched whole, at every place."""

    label: str
    words: tuple[str, ...]
    keys: tuple[tuple[str, ...], ...] = ()
    base: bool = False

    @property
    def need(self) -> int:
        """Words that must stand near their places."""
        return len(self.words) if self.base else -int(-COVER * len(self.words) // 1)

    @property
    def drift(self) -> int:
        return 0 if self.base else min(DRIFT, len(self.words) // 4)


def _templates() -> list[Template]:
    base = [Template(label, tuple(split_words(t)), (), True) for label, t in BASE]
    return base + [Template(label, tuple(split_words(t)), tuple(tuple(split_words(k)) for k in keys)) for label, t, keys in NOTICES]


TEMPLATES = _templates()


def words_of(text: Column) -> Column:
    """Words after lower-casing A-Z. The Kelvin sign is the one other character that lower() would make ASCII."""
    return F.regexp_extract_all(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ"))), F.lit(WORD), 0)


def licence_files(docs: DataFrame, templates: list[Template]) -> DataFrame:
    """doc_id, n_words, held (licence words of the text), words: all of them where ``held`` has enough of a template's, else null.

    A file with too few of the distinct words of every template matches none, so only the others' words are kept.
    """
    vocabulary = sorted({w for t in templates for w in t.words})
    rows = docs.select("doc_id", words_of(F.col("text")).alias("_words"))
    rows = rows.select("doc_id", F.size("_words").cast("long").alias("n_words"), "_words", F.array_intersect("_words", _strings(vocabulary)).alias("held"))
    least: dict[tuple[str, ...], int] = {}
    for t in templates:
        own = tuple(sorted(set(t.words)))
        least[own] = min(least.get(own, len(own)), max(1, len(own) - (len(t.words) - t.need)))
    enough = F.lit(False)
    for own, n in least.items():
        enough = enough | ((F.size("held") >= n) & (F.size(F.array_intersect("held", _strings(own))) >= n))
    return rows.select("doc_id", "n_words", "held", F.when(enough, F.col("_words")).alias("words"))


def postings(templates: list[Template], frequency: dict[str, int]) -> list[tuple[str, int, int]]:
    """(word, template, position) of each template's words of highest IDF; ties to the first position."""
    out = []
    for i, t in enumerate(templates):
        by = sorted(range(len(t.words)), key=lambda j: (frequency[t.words[j]], j))
        out += [(t.words[j], i, j) for j in sorted(by[: len(t.words) - t.need + AGREE])]
    return out


def scan(docs: DataFrame, templates: list[Template] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, matches: array of (start (word, from 0), label, base, words, cover) in order of start.

    A notice matches at a start if COVER of its words stand no more than its drift from their places there, and its key
    phrases stand whole; of starts within a drift of each other the best cover counts, ties to the first. Null text is
    empty and has no match; whole texts of any length are scanned; repeated rows give equal rows; other columns of docs
    play no part; no rows give none. Texts are split into words once. Nothing is shuffled but a count for each licence word.
    """
    files = stored(licence_files(docs, templates), "licences")
    vocabulary = {w for t in templates for w in t.words}
    counted = files.select(F.explode("held").alias("word")).groupBy("word").count().collect()
    index = postings(templates, dict.fromkeys(vocabulary, 0) | {r[0]: r[1] for r in counted})
    found = F.when(F.col("words").isNotNull(), _matches(templates, index)).otherwise(F.array().cast(_KIND))
    return files.select("doc_id", "n_words", found.alias("matches"))


_KIND = "array<struct<start: int, label: string, base: boolean, words: int, cover: double>>"


def _strings(words: tuple[str, ...] | list[str]) -> Column:
    return F.array(*map(F.lit, words))


def _of(values: list, t: Column) -> Column:
    """The value of a template."""
    return F.get(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), t)


def _matches(templates: list[Template], index: list[tuple[str, int, int]]) -> Column:
    rare = sorted({w for w, _, _ in index})
    listed = [F.array(*[F.struct(F.lit(t).alias("t"), F.lit(j).alias("j")) for x, t, j in index if x == w]) for w in rare]
    numbered = F.transform("words", lambda w, i: F.struct(i.alias("i"), w.alias("w")))
    looked_up = F.transform(
        F.filter(numbered, lambda x: x["w"].isin(rare)),
        lambda x: F.transform(_of(listed, F.array_position(_strings(rare), x["w"]).cast("int") - 1), lambda p: F.struct(p["t"].alias("t"), (x["i"] - p["j"]).alias("s"))),
    )
    # postings by template and start; as many as must agree, side by side, within twice the drift
    hits = F.array_sort(F.flatten(looked_up))
    drift, size = [t.drift for t in templates], [len(t.words) for t in templates]
    agree = [min(AGREE, len(t.words)) for t in templates]

    def agreeing(every: Column) -> Column:
        def stands(c: Column, i: Column) -> Column:
            other = F.get(every, i + _of(agree, c["t"]) - 1)
            return F.coalesce((other["t"] == c["t"]) & (other["s"] - c["s"] <= 2 * _of(drift, c["t"])), F.lit(False))

        return F.filter(every, stands)

    def starts(c: Column) -> Column:
        d = _of(drift, c["t"])
        return F.transform(F.sequence(c["s"] - d, c["s"] + d), lambda s: F.struct(c["t"].alias("t"), s.alias("s")))

    said = [_strings(t.words) for t in templates]
    phrases = [F.array(*[_strings(k) for k in t.keys]) if t.keys else F.array().cast("array<array<string>>") for t in templates]

    def cover(c: Column) -> Column:
        d, own = _of(drift, c["t"]), _of(said, c["t"])
        near = F.filter(own, lambda w, j: F.exists(F.sequence(-d, d), lambda e: F.coalesce(F.get("words", c["s"] + j + e) == w, F.lit(False))))
        return F.size(near) / _of(size, c["t"])

    def whole(c: Column) -> Column:
        d, n = _of(drift, c["t"]), _of(size, c["t"])
        stands = lambda k, i: F.forall(F.transform(k, lambda w, q: F.coalesce(F.get("words", i + q) == w, F.lit(False))), lambda x: x)
        return F.forall(_of(phrases, c["t"]), lambda k: F.exists(F.sequence(c["s"] - d, c["s"] + n + d), lambda i: stands(k, i)))

    # computed once each: a transform over an array of one element names what it holds
    once = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))
    tried = once(hits, lambda every: F.array_sort(F.array_distinct(F.flatten(F.transform(agreeing(every), starts)))))
    scored = F.transform(tried, lambda c: F.struct(c["t"].alias("t"), c["s"].alias("s"), cover(c).cast("double").alias("cover")))
    least = [1.0 if t.base else COVER for t in templates]
    good = F.filter(scored, lambda c: (c["cover"] >= _of(least, c["t"])) & whole(c))

    def best(every: Column) -> Column:
        def beaten(c: Column, i: Column) -> Column:
            d = _of(drift, c["t"])
            around = F.slice(every, F.greatest(i + 1 - d, F.lit(1)), 2 * d + 1)
            return F.exists(around, lambda o: (o["t"] == c["t"]) & (F.abs(o["s"] - c["s"]) <= d) & ((o["cover"] > c["cover"]) | ((o["cover"] == c["cover"]) & (o["s"] < c["s"]))))

        return F.filter(every, lambda c, i: ~beaten(c, i))

    labels, base = [t.label for t in templates], [t.base for t in templates]
    rows = F.transform(
        once(good, best),
        lambda c: F.struct(
            c["s"].cast("int").alias("start"), _of(labels, c["t"]).alias("label"), _of(base, c["t"]).alias("base"),
            _of(size, c["t"]).alias("words"), c["cover"].alias("cover"),
        ),
    )
    return F.array_sort(rows).cast(_KIND)
