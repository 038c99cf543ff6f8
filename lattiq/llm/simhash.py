"""Near-duplicates by SimHash fingerprints, found through anchor points of a covering code.

A fingerprint of 64 bits is cut into blocks, each with a share of the threshold: if the shares, plus one each,
sum to more than the threshold, two linked fingerprints keep to the share in some block. In each block the anchors are the words of a covering code: a Hamming code on 15 bits
(every word is within 1 of exactly one code word) beside free bits. A fingerprint is owned by the anchor
nearest to it, and copied to every anchor within the covering radius plus the block's share of the
threshold; so the owner's anchor sees all its partners, and only fingerprints that share an anchor are
compared. Only different fingerprints are compared: copies meet in an aggregate first.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattiq.llm.common import Scratch, by_bytes, ship, unused
from lattiq.llm.components import stars

HAMMING, RADIUS = 15, 1
#: (first bit, bits, share of the threshold) of the blocks: for 4 bits and for 7.
BLOCKS_4 = ((0, 21, 1), (21, 21, 1), (42, 22, 0))
BLOCKS_7 = ((0, 16, 1), (16, 16, 1), (32, 16, 1), (48, 16, 1))
#: Rows of an anchor that meet in one piece of work; an anchor with more is dealt out to a grid of pieces.
PIECE = 8192
#: Pairs that a task looks at together: each takes some 100 bytes for that time.
PAIRS = 1 << 18
#: Bits by which rows that surely meet nothing are left out before a shuffle: at most 2^18 words, whatever the corpus.
BITS = 1 << 24
#: Bytes of a text beyond which its words are taken part by part.
PART = 4 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def fingerprints(values: list[bytes], words: int = 4, seed: int = 42) -> np.ndarray:
    """The fingerprints of texts in UTF-8, as uint64.

    A to Z are lower-cased, words are runs without ASCII white space; each shingle of `words` words, joined by
    spaces and counted as often as it occurs, votes with its XXH64. Fewer words make one shingle, none gives 0.
    A long text votes in parts, so its words are not held at once.
    """
    hashed = xxhash.xxh64_intdigest
    out = np.zeros(len(values), np.uint64)
    short = [i for i, value in enumerate(values) if len(value) <= PART]
    votes: list[int] = []
    counts = np.zeros(len(short), np.int64)
    for k, i in enumerate(short):
        before = len(votes)
        votes += [hashed(s, seed) for s in _shingles(values[i].lower().split(), words)]
        counts[k] = len(votes) - before
    some = np.flatnonzero(counts)
    if len(some):
        starts = (np.cumsum(counts) - counts)[some]
        out[np.array(short)[some]] = _majority(np.add.reduceat(_bits(votes), starts, axis=0, dtype=np.int32), counts[some])
    for i in set(range(len(values))).difference(short):
        total, n = np.zeros((1, 64), np.int64), 0
        for w in _parts(values[i], words):
            votes = [hashed(s, seed) for s in _shingles(w, words)]
            total, n = total + _bits(votes).sum(0, dtype=np.int64), n + len(votes)
        if n:
            out[i] = _majority(total, np.array([n]))[0]
    return out


def _shingles(w: list[bytes], words: int) -> Iterator[bytes]:
    return map(b" ".join, zip(*(w[k:] for k in range(words)), strict=False)) if len(w) >= words else iter([b" ".join(w)] if w else [])


def _parts(value: bytes, words: int) -> Iterator[list[bytes]]:
    """The words of a long text in parts that overlap so that each shingle stands in one; too few words come in one part."""
    at, carried, few = 0, [], True
    while at < len(value):
        m = _SPACE.search(value, at + PART)
        stop = m.end() if m else len(value)
        carried, at = carried + value[at:stop].lower().split(), stop
        if len(carried) >= words:
            yield carried
            carried, few = carried[len(carried) - words + 1 :], False
    if few and carried:
        yield carried


def _bits(votes: list[int] | np.ndarray) -> np.ndarray:
    return np.unpackbits(np.array(votes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _majority(total: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.packbits(2 * total > counts[:, None], axis=1, bitorder="little").view("<u8").ravel()


def with_fingerprint(spark: SparkSession, docs: DataFrame, words: int = 4, seed: int = 42, name: str = "fingerprint", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (default: all) and the fingerprint of text as a bigint.

    A row for each row, repeated ones and null ids included; null texts count as empty (fingerprint 0); an empty table
    gives an empty result; columns may have any names."""
    ship(spark)
    keep = docs.columns if keep is None else keep
    schema = T.StructType([*docs.select(keep).schema.fields, T.StructField(name, T.LongType())])
    carried = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias(unused(keep, "text_")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, len(keep)):
                found = fingerprints(pc.cast(batch.column(len(keep)), pa.binary()).to_pylist(), words, seed)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found.view(np.int64))], names=[*keep, name])

    return carried.mapInArrow(run, schema)


def syndrome(word: int) -> int:
    out = 0
    for j in range(HAMMING):
        if word >> j & 1:
            out ^= j + 1
    return out


def moves(bits: int, reach: int) -> list[list[int]]:
    """By syndrome: the changes of at most `reach` bits that lead to an anchor, the nearest anchor's first."""
    out: list[list[int]] = [[] for _ in range(HAMMING + 1)]
    for weight in range(reach + 1):
        for chosen in combinations(range(bits), weight):
            mask = sum(1 << j for j in chosen)
            out[syndrome(mask & ((1 << HAMMING) - 1))].append(mask)
    return out


def anchors(prints: DataFrame, blocks: tuple, carry: tuple[str, ...] = ()) -> DataFrame:
    """key, fp, the columns of carry, own: each fingerprint at each of its anchors; own is true at the one that owns it."""
    checks = [sum(1 << j for j in range(HAMMING) if j + 1 >> k & 1) for k in range(4)]
    rows = None
    for number, (first, bits, share) in enumerate(blocks):
        block = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << bits) - 1))
        s = sum((F.bit_count(F.col("b").bitwiseAND(F.lit(c))) % 2 * (1 << k) for k, c in enumerate(checks)), F.lit(0))
        table = F.array(*(F.array(*(F.lit(m).cast("bigint") for m in ms)) for ms in moves(bits, RADIUS + share)))
        part = prints.select("fp", *carry, block.alias("b")).select("fp", *carry, "b", F.posexplode(F.element_at(table, (s + 1).cast("int"))).alias("i", "m"))
        part = part.select((F.col("b").bitwiseXOR(F.col("m")) + F.lit(number << 24)).alias("key"), "fp", *carry, (F.col("i") == 0).alias("own"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For links a-b: each node with the smallest node of its component, that node itself left out."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        pa_, pb = parent[a], parent[b]
        open_ = pa_ != pb
        if not open_.any():
            break
        a, b, pa_, pb = a[open_], b[open_], pa_[open_], pb[open_]
        np.minimum.at(parent, np.maximum(pa_, pb), np.minimum(pa_, pb))
        while (parent[parent] != parent).any():
            parent = parent[parent]
    moved = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[moved], nodes[parent[moved]]


def meetings(key: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of all pairs of an owned row with a row of the same key (keys are sorted), about PAIRS at a time."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(key)]]))
    group = np.repeat(np.arange(len(starts)), sizes)
    mine = np.flatnonzero(own)
    theirs = sizes[group[mine]]
    ends, at = np.cumsum(theirs), 0
    while at < len(mine):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        m, n = mine[at:stop], theirs[at:stop]
        first = np.repeat(starts[group[m]] - (np.cumsum(n) - n), n)
        yield np.repeat(m, n), first + np.arange(len(first))
        at = stop


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count((x ^ y).view(np.uint64))


class Links:
    """Links of the fingerprints themselves: any spanning forest will do."""

    def __init__(self, threshold: int):
        self.threshold, self.u, self.v = threshold, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def begin(self, fp: np.ndarray) -> None:
        pass

    def add(self, i: np.ndarray, j: np.ndarray, fp: np.ndarray) -> None:
        x, y = fp[i], fp[j]
        close = (_apart(x, y) <= self.threshold) & (x != y)
        if close.any():
            self.u, self.v = forest(np.concatenate([self.u, x[close]]), np.concatenate([self.v, y[close]]))


def links(spark: SparkSession, prints: DataFrame, scratch: Scratch, finder, blocks: tuple, carry: tuple[str, ...] = ()) -> DataFrame:
    """u, v: what `finder` (made anew in each task) keeps of the pairs that share an anchor.

    An anchor with more than PIECE rows is dealt out: its owned rows and all its rows are cut into parts, and
    each pair of parts is a piece of work of its own, so no task holds an anchor's whole group.
    """
    rows = anchors(prints, blocks, carry)
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.count_if("own").alias("o")).filter(F.col("n") > PIECE)
    hot = scratch.keep(sizes.select("key", F.ceil(F.col("n") / PIECE).alias("nj"), F.greatest(F.ceil(F.col("o") / PIECE), F.lit(1)).alias("ni")), "hot")
    n_hot = hot.count()
    if n_hot:
        rows = rows.join(F.broadcast(hot) if n_hot <= 100_000 else hot, "key", "left")
        part = lambda n: F.pmod(F.xxhash64("fp", *carry), F.col(n))
        as_one = rows.filter("own").withColumn("i", part("ni")).withColumn("j", F.explode(F.expr("sequence(0L, coalesce(nj, 1L) - 1)")))
        as_all = rows.withColumn("j", part("nj")).withColumn("i", F.explode(F.expr("sequence(0L, coalesce(ni, 1L) - 1)")))
        place = F.when(F.col("ni").isNull(), F.col("key")).otherwise(F.col("key") + (F.col("i") * F.col("nj") + F.col("j") + 1) * F.lit(1 << 26))
        rows = as_one.select(place.alias("key"), "fp", *carry, F.lit(True).alias("own")).unionByName(as_all.select(place.alias("key"), "fp", *carry, F.lit(False).alias("own")))
    ordered = rows.select("key", "own", "fp", *carry).repartition("key").sortWithinPartitions("key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        found = finder()

        def settle(parts: list[tuple]) -> None:
            key, own, *values = (np.concatenate(x) for x in zip(*parts, strict=True))
            found.begin(*values)
            for i, j in meetings(key, own):
                found.add(i, j, *values)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            key = held[-1][0]
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                last = held[-1]
                settle([*held[:-1], tuple(x[:cut] for x in last)])
                held = [tuple(x[cut:] for x in last)]
            elif len(held) > 1 and held[-2][0][-1] < key[0]:
                settle(held[:-1])
                held = held[-1:]
        if held:
            settle(held)
        yield pa.RecordBatch.from_pydict({"u": pa.array(np.maximum(found.u, found.v), pa.int64()), "v": pa.array(np.minimum(found.u, found.v), pa.int64())})

    return ordered.mapInArrow(run, "u bigint, v bigint")


def near_duplicates(spark: SparkSession, docs: DataFrame, threshold: int = 4, words: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id: the least doc_id that can be reached by links
    of at most `threshold` differing bits (4, or up to 7). One row per row of docs; rows of equal fingerprint are linked,
    empty texts (fingerprint zero) too. A null text is an empty one; null ids come last, and a component without any other
    has a null; an empty table gives an empty result.
    """
    if not 0 <= threshold <= 7:
        raise ValueError("the blocks serve thresholds of at most 7 bits")
    scratch = Scratch(spark, "simhash")
    hashed = scratch.keep(with_fingerprint(spark, docs, words, name="fp", keep=["doc_id"]), "hashed")
    prints = scratch.keep(hashed.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "prints")
    found = links(spark, prints.select("fp"), scratch, lambda: Links(threshold), BLOCKS_4 if threshold <= 4 else BLOCKS_7)
    root = stars(spark, found, scratch)
    rooted = prints.join(root, prints.fp == root.u, "left").select("fp", "doc_id", F.coalesce("v", "fp").alias("root"))
    first = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    found = rooted.join(first, "root").select("fp", "component_id")
    return hashed.join(found, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingles_of(text: str, words: int) -> set[str]:
    """The shingles of a text's lower-cased words; the whole sequence if there are fewer; none of an empty text."""
    w = text.lower().split()
    return {" ".join(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {" ".join(w)} if w else set()


def _hashes(text: str, words: int) -> np.ndarray:
    """The XXH64 of each shingle of shingles_of."""
    found = shingles_of(text, words)
    return np.fromiter((xxhash.xxh64_intdigest(s.encode(), 42) for s in found), np.uint64, len(found)).view(np.int64)


def common_shingles(docs: DataFrame, words: int, sample: int = 20_000, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that are common in a sample of docs (doc_id, text), each with its rank from 1, the commonest last.

    They only set the order in which shingles are looked at; any order gives the same pairs."""
    share = max(1, docs.count() // sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole):
                found = [_hashes(t, words) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_pydict({"key": pa.array(np.concatenate([np.zeros(0, np.int64), *found]))})

    keys = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).mapInArrow(run, "key bigint")
    rows = keys.groupBy("key").count().filter("count >= 4").orderBy(F.desc("count"), "key").limit(most).toArrow()
    keys = rows.column("key").to_numpy()[::-1]
    order = np.argsort(keys)
    return keys[order], (order + 1).astype(np.int64)


def sketched(spark: SparkSession, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """doc_id, nid, fp, size, prefix of each text: a hash of its lower-cased words in order, the fingerprint of its distinct
    shingles, their number, and the hashes of its rarest shingles, the rarest first, as many as must hold one of every
    text that is similar. A row for each row of docs; null texts count as empty (no shingle, fingerprint 0)."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    common = spark.sparkContext.broadcast(common_shingles(docs, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = common.value
        for whole in batches:
            for batch in by_bytes(whole):
                nid, prints, sizes, prefix = [], [], [], []
                for t in batch.column(1).to_pylist():
                    nid.append(xxhash.xxh64_intdigest(b" ".join(t.lower().encode().split()), 7))
                    h = _hashes(t, words)
                    prints.append(_majority(_bits(h.view(np.uint64)).sum(0, dtype=np.int64)[None, :], np.array([len(h)]))[0] if len(h) else 0)
                    weight = np.zeros(len(h), np.int64)
                    if len(known):
                        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                        weight = np.where(known[at] == h, rank[at], 0)
                    sizes.append(len(h))
                    prefix.append(h[np.lexsort((h, weight))[: len(h) - math.ceil(similarity * len(h) - 1e-9) + 1]])
                offsets = np.cumsum([0, *map(len, prefix)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(prefix)))
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "nid": pa.array(np.array(nid, np.uint64).view(np.int64)), "fp": pa.array(np.array(prints, np.uint64).view(np.int64)), "size": pa.array(sizes, pa.int32()), "prefix": lists})

    return docs.mapInArrow(run, "doc_id bigint, nid bigint, fp bigint, size int, prefix array<bigint>")


def met(rows: DataFrame) -> DataFrame:
    """The rows whose key another row has too; rows are dealt by key once, and only their neighbours are looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, again = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            if last is not None:
                batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            key = batch.column(0).to_numpy()
            same = key[1:] == key[:-1]
            keep = np.concatenate([[again], same]) | np.concatenate([same, [False]])
            last, again = batch.slice(batch.num_rows - 1), bool(keep[-1])
            yield batch.slice(0, batch.num_rows - 1).filter(pa.array(keep[:-1]))
        if last is not None and again:
            yield last

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, rows.schema)


def across(key: np.ndarray, part: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of all pairs of rows of one key and different parts (sorted by both), about PAIRS at a time."""
    new_key = np.concatenate([[True], key[1:] != key[:-1]])
    new_part = new_key | np.concatenate([[True], part[1:] != part[:-1]])
    end_key, end_part = (np.repeat(at[1:], np.diff(at)) for at in (np.append(np.flatnonzero(x), len(key)) for x in (new_key, new_part)))
    theirs = end_key - end_part
    mine = np.flatnonzero(theirs)
    ends, at = np.cumsum(theirs[mine]), 0
    while at < len(mine):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        m, n = mine[at:stop], theirs[mine[at:stop]]
        first = np.repeat(end_part[m] - (np.cumsum(n) - n), n)
        yield np.repeat(m, n), first + np.arange(len(first))
        at = stop


def possible(a: tuple, b: tuple, similarity: float):
    """Whether texts of (size, place of their first common shingle) a and b can be similar; numpy arrays or columns."""
    least, need = (np.minimum, np.ceil) if isinstance(a[0], np.ndarray) else (F.least, F.ceil)
    need = need(similarity / (1 + similarity) * (a[0] + b[0]) - 1e-9)
    return (a[0] >= similarity * b[0] - 1e-9) & (b[0] >= similarity * a[0] - 1e-9) & (least(a[0] - a[1], b[0] - b[1]) >= need)


def to_the_least(meet: DataFrame, similarity: float) -> DataFrame:
    """u, v (u > v): each text with the least one that it meets at a key, where the two can be similar."""
    centre = meet.groupBy("key").agg(F.min(F.struct("nid", "size", "pos")).alias("c"))
    pairs = meet.join(centre, "key").filter(F.col("nid") > F.col("c.nid"))
    return pairs.filter(possible((F.col("size"), F.col("pos")), (F.col("c.size"), F.col("c.pos")), similarity)).select(F.col("nid").alias("u"), F.col("c.nid").alias("v")).distinct()


def between_parts(meet: DataFrame, root: DataFrame, hot: DataFrame, similarity: float, one_of: int) -> DataFrame:
    """u, v (u > v): all pairs of texts of different parts that meet at a key and can be similar; of these one in `one_of`.

    Two texts with the same key before this one met there already, so a run of shared keys gives a pair but once. A key of more than PIECE rows (hot: key, np) is dealt out: each pair of pieces of its rows is work of its own."""
    rows = meet.join(root.select(F.col("u").alias("nid"), F.col("v").alias("part")), "nid", "left").withColumn("part", F.coalesce("part", "nid"))
    rows = rows.join(hot, "key", "left").withColumn("p", F.coalesce(F.pmod(F.xxhash64("nid"), "np"), F.lit(0)))
    rows = rows.withColumn("c", F.explode(F.expr("sequence(0L, coalesce(np, 1L) - 1)")))
    place = F.when(F.col("np").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("p", "c"), F.greatest("p", "c")))
    role = F.when(F.col("p") == F.col("c"), 0).when(F.col("p") < F.col("c"), 1).otherwise(2)
    ordered = rows.select(place.alias("key"), "part", role.alias("role"), "nid", "size", "pos", "prev").repartition("key").sortWithinPartitions("key", "part")

    def pairs_of(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, part, role, nid, size, pos, prev = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in range(7))
        for i, j in across(key, part):
            ok = ((role[i] + role[j]) % 3 == 0) & (prev[i] != prev[j])
            ok &= ((role[i] == 0) == (role[j] == 0)) & possible((size[i], pos[i]), (size[j], pos[j]), similarity)
            u, v = np.maximum(nid[i[ok]], nid[j[ok]]), np.minimum(nid[i[ok]], nid[j[ok]])
            if one_of > 1:
                mixed = (u.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ v.view(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(20)
                u, v = u[mixed % np.uint64(one_of) == 0], v[mixed % np.uint64(one_of) == 0]
            if len(u):
                uv = np.unique(np.stack([u, v]), axis=1)
                yield pa.RecordBatch.from_pydict({"u": pa.array(uv[0]), "v": pa.array(uv[1])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if held and held[-1].column(0)[-1].as_py() != key[0]:
                yield from pairs_of(held)
                held = []
            if cut:
                yield from pairs_of([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from pairs_of(held)

    return ordered.mapInArrow(run, "u bigint, v bigint").distinct()


def near_prints(spark: SparkSession, nodes: DataFrame, scratch: Scratch, threshold: int = 4) -> DataFrame:
    """u, v (u > v): texts (nid) with the least one of their own fingerprint, and least ones of fingerprints that anchors link."""
    prints = scratch.keep(nodes.groupBy("fp").agg(F.min("nid").alias("least")), "prints")
    same = nodes.join(prints, "fp").filter("nid > least").select(F.col("nid").alias("u"), F.col("least").alias("v"))
    found = links(spark, prints.select("fp"), scratch, lambda: Links(threshold), BLOCKS_4 if threshold <= 4 else BLOCKS_7)
    ends = prints.select(F.col("fp").alias("u"), F.col("least").alias("a")), prints.select(F.col("fp").alias("v"), F.col("least").alias("b"))
    return same.unionByName(found.join(ends[0], "u").join(ends[1], "v").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))


def verified(pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """u, v of the pairs (u, v, tu, tv) whose texts share at least `similarity` of their shingles (Jaccard)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            last: dict[int, tuple] = {}
            for k in range(batch.num_rows):
                sets = []
                for c in (0, 1):
                    nid = batch.column(c)[k].as_py()
                    if c not in last or last[c][0] != nid:
                        last[c] = (nid, shingles_of(batch.column(c + 2)[k].as_py(), words))
                    sets.append(last[c][1])
                a, b = sets
                both = len(a & b)
                keep[k] = both >= similarity * (len(a) + len(b) - both)
            kept = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays(kept.columns[:2], names=["u", "v"])

    return pairs.select("u", "v", "tu", "tv").mapInArrow(run, "u bigint, v bigint")


def possibly_in(df: DataFrame, column: str, ids: DataFrame, bits: int = BITS, how: str = "left_semi") -> DataFrame:
    """The rows of df whose value of `column` may be one of ids (one column of bigint, as this one), nulls like values: all that are, and
    of the others about as many as the share of the bits that the ids set. With how="left_anti", the rest of df."""
    at = lambda c: F.pmod(F.xxhash64(F.col(c).cast("bigint")), F.lit(bits))
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("bigint"), (h % 64).cast("int"))
    word, held = unused(df.columns, "_w"), unused(df.columns, "_b")
    words = ids.select(at(ids.columns[0]).alias("_h")).groupBy(F.floor(F.col("_h") / 64).alias(word)).agg(F.bit_or(bit(F.col("_h"))).alias(held))
    met = (F.floor(at(column) / 64) == F.col(word)) & (F.col(held).bitwiseAND(bit(at(column))) != 0)
    return df.join(F.broadcast(words), met, how)


def deduplicated(spark: SparkSession, docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of near-duplicates: that of the least doc_id; one of equal rows stays. Columns as in docs.

    Two texts are linked if they share `similarity` of their distinct shingles of `words` words (Jaccard). The anchors find those
    whose fingerprints lie near each other. Fingerprints do not cover all similar texts, so there is an exact complement:
    similar texts have a shingle in common among the rarest of either, 1 - similarity of its shingles and one more, so all
    pairs that meet at one of those are candidates too, but for those that sizes and places rule out. Every pair is
    verified on the texts before it joins anything: first what the anchors link, and each text with the least it meets,
    then all pairs of what are still different parts, in growing shares where there are many, until none is left. Texts of
    equal words are one text from the start. A null text counts as empty, and so does one without words; null ids come
    last; an empty table stays empty; columns may have any names.
    """
    ship(spark)
    scratch = Scratch(spark, "dedup")
    columns = docs.columns
    hashed = scratch.keep(sketched(spark, docs, words, similarity), "sketches")
    repeated = not hashed.groupBy("doc_id").count().filter("count > 1").isEmpty()
    first = scratch.keep(hashed.groupBy("nid").agg(F.min("doc_id").alias("doc_id"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("prefix").alias("prefix")), "first")
    scratch.drop(hashed)
    keys = F.transform("prefix", lambda x, i: F.struct(x.alias("key"), F.when(i > 0, F.get("prefix", i - 1)).otherwise(F.col("nid")).alias("prev")))
    meet = scratch.keep(met(first.select("nid", "size", F.posexplode(keys).alias("pos", "k")).select("k.key", "nid", "size", "pos", "k.prev")), "meet")
    nodes = scratch.keep(first.select("nid", "doc_id", "fp"), "nodes")
    scratch.drop(first)
    text = docs.select(F.col("doc_id").cast("bigint").alias("_d"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def links_of(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.col("u").alias("nid")).union(pairs.select(F.col("v").alias("nid"))).distinct()
        ids = scratch.keep(ids.join(nodes.select("nid", "doc_id"), "nid"), "ids")
        few = possibly_in(text, "_d", ids.select("doc_id"))  # a round shuffles the texts it compares, not all
        t = _words_hashed(ids.join(few.hint("merge"), ids.doc_id.eqNullSafe(few["_d"])).select("nid", "text"), "words").filter("words = nid")
        t = scratch.keep(t.select("nid", F.col("text").alias("t")), "texts")
        one = t.dropDuplicates(["nid"])
        both = pairs.join(one.select(F.col("nid").alias("u"), F.col("t").alias("tu")).hint("merge"), "u").join(one.select(F.col("nid").alias("v"), F.col("t").alias("tv")).hint("merge"), "v")
        found = scratch.keep(verified(both, words, similarity), "verified")
        scratch.drop(t)
        return found

    tested = scratch.keep(near_prints(spark, nodes, scratch).unionByName(to_the_least(meet, similarity)).distinct(), "pairs")
    found = links_of(tested)
    root = stars(spark, found, scratch)
    counts = meet.groupBy("key").agg(F.count("*").alias("n"))
    hot = scratch.keep(counts.filter(F.col("n") > PIECE).select("key", F.ceil(F.col("n") / PIECE).alias("np")), "hot")
    work, one_of = counts.agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2)).first()[0] or 0.0, 1
    while work / one_of > max(1_000_000, 4 * nodes.count()):
        one_of *= 8
    while True:
        pairs = scratch.keep(between_parts(meet, root, hot, similarity, one_of).join(tested, ["u", "v"], "left_anti"), "pairs")
        if not pairs.isEmpty():
            tested, found = tested.unionByName(pairs), found.unionByName(links_of(pairs))
            root = stars(spark, found, scratch)
        if one_of == 1:
            break
        one_of //= 8
    rooted = nodes.join(root, nodes.nid == root.u, "left").select("nid", "doc_id", F.coalesce("v", "nid").alias("root"))
    first = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "nid")).alias("f"))
    kept = scratch.keep(first.select(F.col("f.doc_id").alias("_d")).distinct(), "kept")
    # rows that share an id: only the first of equal texts, or of different ones, can be the group's; see below
    of_kept = lambda df, how: df.join(kept.hint("merge"), F.col("doc_id").cast("bigint").eqNullSafe(kept["_d"]), how)
    gone = scratch.keep(of_kept(docs.select("doc_id"), "left_anti").select(F.col("doc_id").cast("bigint").alias("_d")).distinct(), "gone")
    # only rows that may be gone meet the ids; the others are not shuffled
    out = possibly_in(docs, "doc_id", gone, how="left_anti").unionByName(of_kept(possibly_in(docs, "doc_id", gone), "left_semi"))
    if repeated:
        out = _one_of_equal(out, first)
    return out.select(columns)


def _words_hashed(df: DataFrame, name: str) -> DataFrame:
    """Adds the hash of the text's lower-cased words in order, as sketched() has it."""
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(columns.index("text")).cast(pa.string()), "").to_pylist()
            nid = np.array([xxhash.xxh64_intdigest(b" ".join(t.lower().encode().split()), 7) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nid.view(np.int64))], names=[*columns, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.LongType())]))


def _one_of_equal(out: DataFrame, first: DataFrame) -> DataFrame:
    """Where ids repeat: of the rows left only those whose words are a group's first, and one row of each."""
    columns, name = out.columns, unused(out.columns, "words")
    chosen = first.select(F.col("f.nid").alias(name), F.col("f.doc_id").alias("group_id"))
    rows = _words_hashed(out, name)
    return rows.join(chosen, (rows[name] == chosen[name]) & rows["doc_id"].cast("bigint").eqNullSafe(chosen["group_id"]), "left_semi").dropDuplicates([name]).select(columns)
