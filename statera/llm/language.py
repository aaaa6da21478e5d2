"""Operator 3: language identification by rank-order profiles of character n-grams.

A profile is the list of a language's most frequent n-grams (one to three letters, words padded with a space). A text's
own most frequent n-grams are compared to each profile by the sum of how far out of place they are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statera.llm.common import lean

#: N-grams of a profile and of a text; languages that one run may have; letters of texts whose n-grams are sorted at a time,
#: and distinct n-grams that a task holds of a language before it sends their counts.
PROFILE, OWN, MOST_LANGUAGES, SORTED, HELD = 400, 300, 1_000, 1 << 19, 1 << 17
UNKNOWN = "und"
#: A text is in none of the languages learnt below this share of the score that all but LOW of the texts with a language reach.
LOW, SHARE = 0.1, 0.5


@cache
def _letters() -> np.ndarray:
    """Code point to lower-case letter, or to a space."""
    out = np.full(0x110000, 32, np.int64)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, coded in 63 bits, and their counts; none without a letter."""
    x = _letters()[np.frombuffer((" " + text + "  ").encode("utf-32-le"), np.uint32)]
    a, b, c = x[:-2], x[1:-1], x[2:]
    space_a, space_b, space_c = a == 32, b == 32, c == 32
    one = b[~space_b] << 42
    two = ((a << 42) | (b << 21))[~(space_a & space_b)]
    three = ((a << 42) | (b << 21) | c)[~space_b & ~(space_a & space_c)]
    if not len(one):
        return one, one
    return np.unique(np.concatenate((one, two, three)), return_counts=True)


def learnable(docs: DataFrame) -> DataFrame:
    return docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")


def known(docs: DataFrame, learnt_docs: int | None = None) -> DataFrame | None:
    """lang and text of the documents that profiles are learnt from: all with both, or of each language about so many, those
    with the smallest hashes of their ids; None if there are none."""
    rows = learnable(docs).select("text", "lang", F.pmod(F.xxhash64("doc_id"), F.lit(2**30)).alias("_h"))
    counts = rows.groupBy("lang").count().collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"{len(counts)} languages; profiles take {MOST_LANGUAGES}")
    if not counts:
        return None
    if learnt_docs is not None:
        share = F.create_map(*[F.lit(x) for lang, n in counts for x in (lang, int(2**30 * min(1.0, learnt_docs / n)))])
        rows = rows.where(F.col("_h") < F.element_at(share, F.col("lang")))
    return rows.select("lang", "text")


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and their counts added up."""
    by = np.argsort(key, kind="stable")
    key, n = key[by], n[by]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))[: len(key)]
    return key[first], np.add.reduceat(n, first) if len(key) else n


def profiles(docs: DataFrame, learnt_docs: int | None = None, size: int = PROFILE) -> dict[str, list[int]]:
    """The n-grams of each language by rank, learnt from texts and languages of all rows given (see ``known``)."""
    rows = known(docs, learnt_docs)
    if rows is None:
        return {}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for lang, some in b.groupby("lang"):
                for text in joined(some["text"]):
                    key, n = grams(text)
                    if lang in held:
                        key, n = _summed(np.concatenate((held[lang][0], key)), np.concatenate((held[lang][1], n)))
                    held[lang] = key, n
                    if len(key) > HELD:
                        yield sent(lang, *held.pop(lang))
        for lang, (key, n) in held.items():
            yield sent(lang, key, n)

    def joined(texts: Iterable[str]) -> Iterator[str]:
        """Texts with a space between, so that no n-gram spans two, of about SORTED letters; a longer one is taken alone."""
        run, letters = [], 0
        for t in texts:
            if run and letters + len(t) > SORTED:
                yield " ".join(run)
                run, letters = [], 0
            run.append(t)
            letters += len(t) + 1
        if run:
            yield " ".join(run)

    def sent(lang: str, key: np.ndarray, n: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"lang": lang, "gram": key, "n": n.astype(np.int64)})

    sums = rows.mapInPandas(lean(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = sums.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")))
    out: dict[str, list[int]] = {}
    for r in sorted(ranked.where(F.col("rank") <= size).collect(), key=lambda r: (r["lang"], r["rank"])):
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


class Ranks:
    """Ranks of all profiles' n-grams in a table of n-grams by languages, for distances of many texts."""

    def __init__(self, learnt: dict[str, list[int]]) -> None:
        self.langs = sorted(learnt)
        self.keys = np.unique(np.array([g for x in learnt.values() for g in x], np.int64))
        self.missing = max([1, *map(len, learnt.values())])
        self.ranks = np.full((len(self.keys) + 1, len(self.langs)), -1, np.int64)
        for j, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.keys, learnt[lang]), j] = np.arange(len(learnt[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language least out of place (ties to the smaller name), and 1 less its distance as a share of the most there can be."""
        key, n = grams(text or "")
        if not len(key) or not self.langs:
            return UNKNOWN, 0.0
        key = key[np.lexsort((key, -n))[:OWN]]
        at = np.searchsorted(self.keys, key)
        at = np.where(self.keys[np.minimum(at, len(self.keys) - 1)] == key, at, len(self.keys))
        ranks = self.ranks[at]
        off = np.where(ranks < 0, self.missing, np.minimum(np.abs(ranks - np.arange(len(key))[:, None]), self.missing)).sum(axis=0)
        best = int(off.argmin())
        return self.langs[best], float(1 - off[best] / (self.missing * len(key)))


def predictions(docs: DataFrame, learnt: dict[str, list[int]], columns: list[str]) -> DataFrame:
    """The given columns of docs (text among them is read whole), lang_pred and score.

    ``und`` with score 0 for null text, text without a letter, or where nothing was learnt. Repeated rows get equal results.
    """
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields if f.name in columns}
    whole = [c for c in columns if kinds[c] in ("bigint", "int")]  # as strings, so that nulls don't turn ids into floats

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks = Ranks(learnt)
        for b in batches:
            found = [ranks.predict(t) for t in b[own]]
            yield b[columns].assign(lang_pred=[x for x, _ in found], score=[s for _, s in found])

    own = "text" if "text" in columns else "_text"
    read = [] if "text" in columns else [F.col("text").alias(own)]
    rows = docs.select(*[F.col(c).cast("string").alias(c) if c in whole else F.col(c) for c in columns], *read)
    inner = ", ".join(f"`{c}` {'string' if c in whole else kinds[c]}" for c in columns)
    out = rows.mapInPandas(lean(run), f"{inner}, lang_pred string, score double")
    return out.withColumns({c: F.col(c).cast(kinds[c]) for c in whole})


def limit(docs: DataFrame, learnt: dict[str, list[int]]) -> float:
    """The least score of a text in one of the languages learnt, from the scores of all texts with a language."""
    return least_score(predictions(docs, learnt, ["doc_id", "text", "lang"]))


def least_score(found: DataFrame) -> float:
    """``limit`` from what ``predictions`` gave (doc_id, text, lang, score)."""
    scored = learnable(found).where("score > 0").select(F.floor(F.col("score") * 1000).alias("score"))
    low = scored.agg(F.percentile("score", F.lit(LOW))).collect()[0][0]  # of 1,001 values at most
    return SHARE * (low or 0.0) / 1000


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; a null id is not held out, and not learnt from either."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
