"""Language identification by rank-order profiles: n-grams ranked by frequency, compared by how far out of place they are.

A language's profile are its most frequent n-grams over all texts learned from; a document is ranked likewise. The distance is
the sum of the differences of rank, a whole profile's length for an n-gram that the profile lacks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattiq.llm.common import Scratch, by_bytes, ship
from lattiq.llm.quality import held_out

#: N-grams of a profile, of a language and of a document alike.
RANKS = 300
#: N-grams that a task holds while it counts; beyond that it passes on what it has.
HELD = 1 << 20
#: Profiles are broadcast; so many of their n-grams are (16,666 languages of 300), more are an error.
MOST = 5_000_000


@lru_cache(1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter (any of the categories L)."""
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)


def grams(text: str) -> np.ndarray:
    """The n-grams of one to three characters of a text, each occurrence, as integers in the order of their code points.

    The text is in lower case; all between two words is one space, and one stands before the first and after the last; an n-gram
    has a space at its ends only and is not a space alone."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(0, np.int64)
    c = np.zeros(len(codes) + 2, np.int64)
    c[1:-1] = np.where(letter, codes, 32)
    c[0] = c[-1] = 32
    c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
    is_letter = c != 32
    one = c[is_letter] << 42
    two = (c[:-1] << 42) | (c[1:] << 21)
    three = ((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])[is_letter[1:-1]]
    return np.concatenate([one, two, three])


def ranked(text: str, ranks: int = RANKS) -> np.ndarray:
    """The most frequent n-grams of a text, most frequent first, equally frequent ones by their code points."""
    found, n = np.unique(grams(text), return_counts=True)
    return found[np.argsort(-n, kind="stable")[:ranks]]


class Profiles:
    """place[l, i]: the rank of n-gram known[i] in language l, the profile's length if it is not there."""

    def __init__(self, rows: list[tuple[str, int, int]], ranks: int = RANKS):
        self.ranks, self.names = ranks, sorted({r[0] for r in rows})
        self.known = np.unique(np.array([r[1] for r in rows], np.int64))
        self.place = np.full((len(self.names), len(self.known)), ranks, np.int64)
        if rows:
            number = {name: i for i, name in enumerate(self.names)}
            self.place[[number[r[0]] for r in rows], np.searchsorted(self.known, [r[1] for r in rows])] = [r[2] for r in rows]

    def guess(self, text: str | None) -> tuple[str, float]:
        """Language and score: 1 less the share of the greatest possible distance; of equally near languages the first by name."""
        mine = ranked(text, self.ranks) if text and self.names else ()
        if not len(mine):
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.known, mine), len(self.known) - 1)
        there = np.flatnonzero(self.known[at] == mine)
        far = np.abs(self.place[:, at[there]] - there).sum(1, where=self.place[:, at[there]] < self.ranks)
        far = far + self.ranks * (len(mine) - (self.place[:, at[there]] < self.ranks).sum(1))
        best = int(far.argmin())
        return self.names[best], 1 - int(far[best]) / (self.ranks * len(mine))


def counts(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """lang, gram, n: how often each n-gram occurs in all texts of a language (rows: lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, (gram, n) in held.items():
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(gram), pa.string()), "gram": gram, "n": n})
            held.clear()

        for whole in batches:
            for b in by_bytes(whole, 1):
                new: dict[str, list[np.ndarray]] = {}
                for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    new.setdefault(lang, []).append(grams(text))
                for lang, each in new.items():
                    gram, n = np.unique(np.concatenate(each), return_counts=True)
                    if lang in held:
                        both, at = np.unique(np.concatenate([held[lang][0], gram]), return_inverse=True)
                        gram, n = both, np.bincount(at, np.concatenate([held[lang][1], n]).astype(float), len(both)).astype(np.int64)
                    held[lang] = gram, n.astype(np.int64)
                if sum(len(g) for g, _ in held.values()) > HELD:
                    yield from out()
        yield from out()

    return rows.select("lang", "text").mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(spark: SparkSession, docs: DataFrame, ranks: int = RANKS) -> Profiles:
    """The profile of every language of docs (doc_id, text, lang), counted over all texts outside the held-out fold.

    Rows without a language or a text teach nothing, nor do texts without letters; repeated rows count as often as they occur;
    a null doc_id is not held out; without rows nothing is known."""
    ship(spark)
    rows = docs.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts(spark, rows).withColumn("place", F.row_number().over(best) - 1).filter(F.col("place") < ranks)  # cut before the shuffle, too
    found = Scratch(spark, "language").keep(top.select("lang", "gram", F.col("place").cast("bigint").alias("place")), "profiles")
    if (n := found.count()) > MOST:
        raise ValueError(f"{n} n-grams in the profiles are more than the {MOST} that are broadcast")
    return Profiles([tuple(r) for r in found.collect()], ranks)


def predicted(spark: SparkSession, docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, lang_pred, score of every whole text of docs.

    A null text, one without letters, and any text where nothing was learned is `und` with score 0; repeated rows give equal
    rows; an empty table gives an empty result; other columns play no part."""
    ship(spark)
    shared = spark.sparkContext.broadcast(profiles)  # MOST n-grams at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in by_bytes(whole):
                out = [shared.value.guess(text) for text in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def identify(spark: SparkSession, docs: DataFrame, ranks: int = RANKS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs, learned from the rows outside the held-out fold.

    Nothing but the text enters a prediction; see learn() and predicted() for nulls, repeated rows and empty tables."""
    return predicted(spark, docs, learn(spark, docs, ranks)).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
