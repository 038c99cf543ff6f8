"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are sequences of lower-cased words. Shared runs of `least` words, found with
running Karp-Rabin hashes, seed the matches; the longest match whose words are free on both sides is marked
as a tile, again and again, until none of `least` words is left. An item leaked if tiles cover a large enough
part of it, in whatever order they stand in the document.

The benchmark is the small side: it is broadcast in slices of bounded size and every document is compared
with every slice, so there is no shuffle of documents and no limit on the benchmark's size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.llm.common import Scratch, by_bytes, ship, unused

WORD = re.compile(r"[^\W_]+")
#: Texts of more characters have their words counted one by one.
LONG = 1 << 20
#: Bytes of benchmark text that one broadcast may hold.
SLICE_BYTES = 16 << 20
#: Broadcasts that one stage looks for.
SLICES = 4


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def ids_of(texts: list[str], number: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the words of all texts in one array (-1: unknown), and the offsets of the texts in it.

    The words of a text are not held at once, so a long one costs 8 bytes a word."""
    get, parts = number.get, []
    for text in texts:
        lower = text.lower()
        if len(lower) > LONG:
            parts.append(np.fromiter((get(m.group(), -1) for m in WORD.finditer(lower)), np.int64))
        else:
            found = WORD.findall(lower)
            parts.append(np.fromiter(map(get, found, repeat(-1)), np.int64, len(found)))
    return np.concatenate([np.zeros(0, np.int64), *parts]), np.concatenate([[0], np.cumsum([len(x) for x in parts], dtype=np.int64)])


class Hashes:
    """Karp-Rabin hashes modulo 2**64 of a sequence of ids: those of all windows of any size, from one running sum."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, ids: np.ndarray, base: int = 0x9E3779B97F4A7C15):
        n = len(ids)
        up, down = self._powers.get(base, (np.zeros(0, np.uint64), np.zeros(0, np.uint64)))
        if len(up) <= n:
            size = max(1 << 12, 2 * n)
            up, down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)])) for b in (base, pow(base, -1, 1 << 64)))
            if size <= 1 << 20:
                self._powers[base] = up, down
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        self.up, self.sums = up[: n + 1], np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * down[:n], dtype=np.uint64)])

    def windows(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return (self.sums[size:] - self.sums[:n]) * self.up[:n] if n > 0 else np.zeros(0, np.uint64)


def shared_runs(ids: np.ndarray, other: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of ids that lie in a window of `least` ids whose hash occurs in other too, and the ids there, runs parted by -1."""
    mine, theirs = Hashes(ids).windows(least), np.sort(Hashes(other).windows(least))
    if not len(mine) or not len(theirs):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hit = theirs[np.minimum(np.searchsorted(theirs, mine), len(theirs) - 1)] == mine
    part = np.concatenate([hit, np.zeros(least, np.int64)]).astype(np.int64)
    part[least:] -= hit
    at = np.flatnonzero((np.cumsum(part)[:-1] > 0) & (ids >= 0))
    cut = np.flatnonzero(np.diff(at) > 1) + 1
    return np.insert(at, cut, -1), np.insert(ids[at], cut, -1)


def tiles(doc: np.ndarray, item: np.ndarray, least: int, base: int = 0x9E3779B97F4A7C15) -> list[tuple[int, int, int]]:
    """The tiles (start in doc, start in item, length) of a greedy tiling; ids below 0 match nothing.

    Longest first; among equals the earliest in the item, then in the document. The greatest length that still has a match
    on free words is found by bisection on running hashes, and all tiles of that length are marked in one pass over the
    item; so time and memory follow the two lengths, however often words repeat.
    """
    (at_doc, d), (at_item, i) = shared_runs(doc, item, least), shared_runs(item, doc, least)
    hd, hi, out = Hashes(d, base), Hashes(i, base), []
    used_d, used_i = d < 0, i < 0

    def open_windows(size: int) -> tuple[np.ndarray, ...]:
        """Places and hashes of the windows of free words, in both."""
        found = []
        for used, h in ((used_d, hd), (used_i, hi)):
            taken = np.concatenate([[0], np.cumsum(used)])
            place = np.flatnonzero(taken[size:] == taken[: len(used) - size + 1]) if len(used) >= size else np.zeros(0, np.int64)
            found += [place, h.windows(size)[place] if len(place) else np.zeros(0, np.uint64)]
        return tuple(found)

    def longest(used: np.ndarray) -> int:
        stops = np.flatnonzero(np.concatenate([[True], used, [True]]))
        return int(np.diff(stops).max()) - 1

    def some(size: int) -> bool:
        _, x, _, y = open_windows(size)
        return bool(len(x) and len(y) and np.isin(y, x).any())

    top = min(longest(used_d), longest(used_i)) if len(d) and len(i) else 0
    while top >= least:
        if not some(top):
            low, high = least - 1, top  # a match of `low` words is there (or none at all), one of `high` is not
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if some(middle) else (low, middle)
            top = low
            if top < least:
                break
        place_d, x, place_i, y = open_windows(top)
        order = np.argsort(x, kind="stable")
        x, place_d = x[order], place_d[order]
        begin, end = np.searchsorted(x, y, "left"), np.searchsorted(x, y, "right")
        after: dict[int, int] = {}
        for k in np.flatnonzero(end > begin).tolist():
            p = int(place_i[k])
            if used_i[p] or used_i[p + top - 1]:  # marks are as long as the window, so its ends tell
                continue
            b, e = int(begin[k]), int(end[k])
            c = after.get(b, b)
            while c < e and (used_d[place_d[c]] or used_d[place_d[c] + top - 1]):
                c += 1
            after[b] = c
            if c == e:
                continue
            q = int(place_d[c])
            if not np.array_equal(d[q : q + top], i[p : p + top]):  # two windows of one hash: begin anew with another base
                return tiles(doc, item, least, (base * 0xD1342543DE82EF95 + 2) % (1 << 64) | 1)
            used_d[q : q + top] = used_i[p : p + top] = True
            out.append((int(at_doc[q]), int(at_item[p]), top))
        top = min(top - 1, longest(used_d), longest(used_i))
    return out


class Items:
    """A slice of the benchmark: its words as ids, and the seeds of its items."""

    def __init__(self, items: list[tuple], least: int):
        self.number: dict[str, int] = {}
        self.keys, self.ids = [], []
        for key, text in items:
            w = [self.number.setdefault(x, len(self.number)) for x in words(text or "")]
            if w:
                self.keys.append(key)
                self.ids.append(np.array(w, np.int64))
        by_size: dict[int, list] = {}
        for k, ids in enumerate(self.ids):
            size = min(least, len(ids))
            h = Hashes(ids).windows(size)
            by_size.setdefault(size, []).append((h, np.full(len(h), k)))
        self.seeds = {}
        for size, parts in by_size.items():
            h, k = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            self.seeds[size] = h[order], k[order]

    def candidates(self, ids: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, item, seed size) of the texts that share a seed with an item."""
        out: set[tuple[int, int, int]] = set()
        known, hashes = np.concatenate([[0], np.cumsum(ids >= 0)]), Hashes(ids)
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        for size, (h, k) in self.seeds.items():
            n = len(ids) - size + 1
            if n <= 0:
                continue
            at = np.flatnonzero((known[size:] - known[:n] == size) & (owner[:n] == owner[size - 1 :]))
            v = hashes.windows(size)[at]
            a, b = np.searchsorted(h, v, "left"), np.searchsorted(h, v, "right")
            hit = np.flatnonzero(b > a)
            for t, p, q in zip(owner[at[hit]].tolist(), a[hit].tolist(), b[hit].tolist(), strict=True):
                out.update((t, item, size) for item in set(k[p:q].tolist()))
        return sorted(out)

    def matches(self, column: pa.Array, coverage: float) -> list[tuple]:
        """(text, item key, coverage, words covered, words of the item, tiles) at or above the coverage."""
        ids, offsets = ids_of(column.to_pylist(), self.number)
        out = []
        for t, k, size in self.candidates(ids, offsets):
            item = self.ids[k]
            found = tiles(ids[offsets[t] : offsets[t + 1]], item, size)
            covered = sum(x[2] for x in found)
            if covered >= coverage * len(item):
                out.append((t, self.keys[k], covered / len(item), covered, len(item), found))
        return out


def slices(spark: SparkSession, benchmark: DataFrame, least: int, limit: int = SLICE_BYTES) -> Iterator:
    """The benchmark's different items in broadcasts of about `limit` bytes of text each; an empty benchmark gives one without items."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    n = max(1, -(-total // limit))
    for i in range(n):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) if n > 1 else items
        rows = sorted(map(tuple, part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        yield spark.sparkContext.broadcast(Items(rows, least))


def together(parts: Iterator, n: int = SLICES) -> Iterator[list]:
    """Slices in lists of n: one function looks for those of a list, so a task has one worker that holds n slices at most."""
    while some := list(islice(parts, n)):
        yield some


def leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, least: int = 5, coverage: float = 0.5, limit: int = SLICE_BYTES) -> DataFrame:
    """doc_id, item_id, coverage, n_covered, n_words, tiles: each document with each item that leaked into it.

    coverage: the part of an item's words that tiles of `least` words or more must cover (items of fewer words
    must occur whole). Null or empty texts and items without words never match. Repeated rows of docs give
    repeated rows; repeated items count once. An empty table gives an empty result.
    """
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = None
    for some in together(slices(spark, benchmark, least, limit)):

        def run(batches: Iterator[pa.RecordBatch], some=some) -> Iterator[pa.RecordBatch]:
            kind = pa.list_(pa.struct([("doc_start", pa.int64()), ("item_start", pa.int64()), ("length", pa.int64())]))
            for whole in batches:
                for batch in by_bytes(whole):
                    found = [f for items in some for f in items.value.matches(batch.column(1), coverage)]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pc.take(batch.column(0), pa.array([f[0] for f in found], pa.int64())), "item_id": pa.array([f[1] for f in found], pa.int64()), "coverage": pa.array([f[2] for f in found], pa.float64()),
                        "n_covered": pa.array([f[3] for f in found], pa.int64()), "n_words": pa.array([f[4] for f in found], pa.int64()),
                        "tiles": pa.array([[dict(zip(("doc_start", "item_start", "length"), t, strict=True)) for t in f[5]] for f in found], kind),
                    })

        part = rows.mapInArrow(run, "doc_id bigint, item_id bigint, coverage double, n_covered bigint, n_words bigint, tiles array<struct<doc_start:bigint,item_start:bigint,length:bigint>>")
        out = part if out is None else out.unionByName(part)
    return out


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, least: int = 5, coverage: float = 0.5, limit: int = SLICE_BYTES) -> DataFrame:
    """docs without the rows into which an item leaked; columns as in docs, no shuffle.

    A benchmark of more than SLICES slices takes a pass for each SLICES of them, with a table between.
    Null and empty texts stay, as do all rows if the benchmark is empty; repeated rows stay or go together; an empty table
    stays empty; columns may have any names."""
    ship(spark)
    columns, schema = docs.columns, docs.schema
    groups, scratch = list(together(slices(spark, benchmark, least, limit))), Scratch(spark, "clean")
    for i, some in enumerate(groups):

        def run(batches: Iterator[pa.RecordBatch], some=some) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in by_bytes(whole, len(columns)):
                    keep = np.ones(batch.num_rows, bool)
                    for items in some:
                        left = np.flatnonzero(keep)
                        keep[left[[f[0] for f in items.value.matches(batch.column(len(columns)).take(pa.array(left)), coverage)]]] = False
                    kept = batch.filter(pa.array(keep))
                    yield pa.RecordBatch.from_arrays(kept.columns[:-1], names=columns)

        docs = docs.select(*columns, F.coalesce(F.col("text").cast("string"), F.lit("")).alias(unused(columns, "text_"))).mapInArrow(run, schema)
        if i + 1 < len(groups):
            docs = scratch.keep(docs)  # the next stage begins anew, with workers of its own
    return docs
