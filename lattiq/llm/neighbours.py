"""Approximate nearest neighbours (largest inner product): a forest of random-projection trees.

The trees are fitted on a bounded sample; every vector is put into a leaf of every tree. A query walks all
trees through one priority queue, ordered by how far it stands beyond the planes crossed, until it has seen
leaves that hold a given part of all vectors. The candidates of those leaves are reranked exactly.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattiq.llm.common import Scratch, ship

#: At most so many vectors are collected to fit the trees: those of the smallest hashes of their ids.
SAMPLE = 20_000
#: Rows of a leaf that lie together; of a shelf, which is a set of pieces of leaves that one task searches; and of queries it gets.
PIECE, SHELF, ASKED = 4096, 32_768, 16_384
#: Rows of a leaf, about, unless the table has fewer than 64 such leaves.
LEAF = 1024


class Forest:
    """Trees as flat arrays: node n splits by plane[n] at cut[n] into children left[n], right[n]; leaves have left = -1."""

    def __init__(self, sample: np.ndarray, trees: int, leaf: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.plane, self.cut, self.left, self.right, self.share, self.roots = [], [], [], [], [], []
        for _ in range(trees):
            self.roots.append(self._grow(sample, np.arange(len(sample)), leaf, rng, max(1, len(sample))))
        self.tree = np.searchsorted(self.roots, np.arange(len(self.left)), "right") - 1  # nodes of a tree follow its root
        self.plane = np.array(self.plane, np.float64).reshape(len(self.left), -1)
        self.cut, self.left, self.right, self.share = (np.array(x) for x in (self.cut, self.left, self.right, self.share))

    def _grow(self, x: np.ndarray, rows: np.ndarray, leaf: int, rng, total: int) -> int:
        n = len(self.left)
        for values, v in ((self.plane, np.zeros(x.shape[1])), (self.cut, 0.0), (self.left, -1), (self.right, -1), (self.share, len(rows) / total)):
            values.append(v)
        if len(rows) <= leaf:
            return n
        for _ in range(3):
            plane = rng.standard_normal(x.shape[1])
            plane /= np.linalg.norm(plane)
            at = x[rows] @ plane
            cut = float(np.median(at))
            low = at < cut
            if 0 < low.sum() < len(rows):
                self.plane[n], self.cut[n] = plane, cut
                self.left[n] = self._grow(x, rows[low], leaf, rng, total)
                self.right[n] = self._grow(x, rows[~low], leaf, rng, total)
                break
        return n

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        out = np.empty((len(x), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            at = np.full(len(x), root)
            while (inner := np.flatnonzero(self.left[at] >= 0)).size:
                n = at[inner]
                low = np.einsum("ij,ij->i", x[inner], self.plane[n]) < self.cut[n]
                at[inner] = np.where(low, self.left[n], self.right[n])
            out[:, t] = at
        return out

    def probe(self, q: np.ndarray, part: float, rows: np.ndarray, least: int) -> list[int]:
        """The leaves to search: best first over all trees, until each tree's share of the work sums to `part` a tree and the
        leaves of one tree hold `least` rows (rows: of each node), or no leaf is left."""
        side = self.plane @ q - self.cut
        queue = [(0.0, root) for root in self.roots]
        heapq.heapify(queue)
        out, seen, held = [], 0.0, np.zeros(len(self.roots), np.int64)
        while queue and (seen < part * len(self.roots) or held.max() < least):
            far, n = heapq.heappop(queue)
            while self.left[n] >= 0:
                near, other = (self.left[n], self.right[n]) if side[n] < 0 else (self.right[n], self.left[n])
                heapq.heappush(queue, (far + float(side[n]) ** 2, int(other)))
                n = near
            out.append(int(n))
            seen += self.share[n]
            held[self.tree[n]] += rows[n]
        return out


def vectors(table: DataFrame) -> DataFrame:
    """vec_id, embedding (array of double) of the vectors that take part: not null, no null or non-finite component,
    not zero, and of the most frequent dimension (the greatest of equally frequent ones)."""
    rows = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id is not null and embedding is not null")
    rows = rows.filter(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0))
    most = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("embedding") == (most.d if most else 0))


def fit(rows: DataFrame, trees: int, leaf: int, seed: int = 7) -> Forest:
    """Trees on a sample of SAMPLE vectors at most, cut until a leaf stands for about `leaf` rows of the table (8 of the sample at least)."""
    n = rows.count()
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").collect()
    x = np.unique(np.array([r.embedding for r in sample], np.float64), axis=0) if sample else np.zeros((0, 1))
    return Forest(x, trees, max(8, int(len(x) * min(leaf, n / 64) / max(n, 1))), seed)


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def best_of(qs: np.ndarray, q: np.ndarray, at: np.ndarray, leaf: np.ndarray, xs: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """query id, vector id, score of the k best rows (and those so near that rounding may decide) for each query.

    Query row at[i] asks leaf number i of `leaf`'s list; rows (xs, x) are (leaf, vectors) sorted by leaf. Products are taken leaf by
    leaf for all its queries at once; scores of what is left are sums rounded once."""
    rows_leaf, asked_leaf = leaf
    found = []
    order = np.argsort(asked_leaf, kind="stable")
    for n in np.unique(asked_leaf):
        a, b = np.searchsorted(rows_leaf, [n, n + 1])
        who = at[order[np.searchsorted(asked_leaf[order], n) : np.searchsorted(asked_leaf[order], n, "right")]]
        if b == a:
            continue
        most = k * int(np.unique(xs[a:b], return_counts=True)[1].max())  # rows that hold k different ids for certain
        for c in range(0, len(who), 1024):
            mine = who[c : c + 1024]
            near = q[mine] @ x[a:b].T
            near[qs[mine][:, None] == xs[None, a:b]] = -np.inf
            low = np.partition(near, -most, axis=1)[:, -most] if b - a > most else np.full(len(mine), -np.inf)
            i, j = np.nonzero((near >= (low - 1e-9 * np.maximum(1.0, np.abs(np.where(np.isfinite(low), low, 0))))[:, None]) & (near > -np.inf))
            found.append((mine[i], a + j, near[i, j]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    i, j, near = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((-near, xs[j], i))
    i, j, near = i[order], j[order], near[order]
    ids = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (xs[j[1:]] != xs[j[:-1]])]))  # an id may come from both trees
    ids = ids[np.lexsort((-near[ids], i[ids]))]
    asker, first = np.unique(i[ids], return_index=True)
    last = np.minimum(first + k, np.append(first[1:], len(ids))) - 1
    low = np.zeros(len(qs))
    low[asker] = near[ids[last]]
    keep = near >= low[i] - 1e-9 * np.maximum(1.0, np.abs(low[i]))
    i, j = i[keep], j[keep]
    return qs[i], xs[j], np.array([math.fsum(p) for c in range(0, len(i), 4096) for p in (q[i[c : c + 4096]] * x[j[c : c + 4096]]).tolist()])


def search(spark: SparkSession, table: DataFrame, every: int = 20, k: int = 20, trees: int = 2, leaf: int = LEAF, part: float = 0.6) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose id is divisible by `every` its k best others found.

    A query is shown leaves that hold `part` of all rows, and so many that k candidates are among them (all rows, if there
    are fewer); with part = 1 every leaf is searched, so the result is exact.
    Ties go to the smaller vec_id. A query is no candidate of its own. Vectors that take no part (see vectors())
    have no rows; a vec_id that repeats counts with each of its different vectors as a candidate and once in a
    result. Equal vectors form a class whose k + 1 smallest ids stand for it (no other can be among k), so a
    vector that a third of the rows share is no hot leaf; a leaf of more than PIECE rows is still dealt out. Pieces of
    leaves lie on shelves of about SHELF rows, and a task searches one shelf for ASKED queries at most.
    An empty table gives an empty result.
    """
    ship(spark)
    scratch = Scratch(spark, "neighbours")
    rows = vectors(table)
    alike = Window.partitionBy("embedding").orderBy("vec_id")
    rows = scratch.keep(rows.distinct().withColumn("_n", F.row_number().over(alike)).filter(F.col("_n") <= k + 1).drop("_n"), "vectors")
    asked = scratch.keep(vectors(table).filter(F.col("vec_id") % every == 0).distinct(), "queries")
    forest = spark.sparkContext.broadcast(fit(rows, trees, leaf))  # bounded by SAMPLE

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = forest.value.leaves(_matrix(b.column(1)))
            for t in range(found.shape[1]):
                yield pa.RecordBatch.from_pydict({"leaf": pa.array(found[:, t]), "vec_id": b.column(0), "embedding": b.column(1)})

    placed = scratch.keep(rows.mapInArrow(index, "leaf bigint, vec_id bigint, embedding array<double>"), "index")
    parts = scratch.keep(placed.groupBy("leaf").count().select("leaf", "count", F.ceil(F.col("count") / PIECE).alias("parts")), "parts")  # as many rows as leaves
    held = np.zeros(max(1, len(forest.value.left)), np.int64)
    for r in parts.collect():
        held[r.leaf] = r["count"]
    parts = parts.drop("count")
    # so many rows hold k ids beside the query's own for certain
    least = (k + 1) * (rows.groupBy("vec_id").count().agg(F.max("count")).first()[0] or 1)

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [forest.value.probe(q, part, held, least) if part < 1 else np.flatnonzero(forest.value.left < 0).tolist() for q in _matrix(b.column(1))]
            yield pa.RecordBatch.from_pydict({"vec_id": b.column(0), "embedding": b.column(1), "leaves": pa.array(found, pa.list_(pa.int64()))})

    shelves = max(1, placed.count() // SHELF)
    n_blocks = asked.count() // ASKED + 1
    shelf = lambda: F.pmod(F.xxhash64("leaf", "part"), F.lit(shelves))
    placed = placed.join(F.broadcast(parts), "leaf").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts"))).withColumn("shelf", shelf())
    placed = placed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)).cast("array<bigint>")))
    # where a query goes: the shelves that hold a piece of one of its leaves; it travels once to each
    ways = scratch.keep(asked.repartition("vec_id", "embedding").mapInArrow(probes, "vec_id bigint, embedding array<double>, leaves array<bigint>").withColumn("q", F.monotonically_increasing_id()), "ways")
    wanted = ways.select("q", F.explode("leaves").alias("leaf")).join(F.broadcast(parts), "leaf").withColumn("part", F.explode(F.expr("sequence(0L, parts - 1)"))).withColumn("shelf", shelf())
    wanted = wanted.groupBy("q", "shelf").agg(F.collect_set("leaf").alias("leaves"))  # at most the leaves of a shelf
    wanted = wanted.join(ways.select("q", "vec_id", "embedding"), "q").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)))

    def rerank(key, queries: pa.Table, found: pa.Table) -> pa.Table:
        out = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if queries.num_rows and found.num_rows:
            found = found.sort_by("leaf")
            lists = queries.column("leaves").combine_chunks()
            at = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            q, x = (_matrix(t.column("embedding").combine_chunks()) for t in (queries, found))
            out = best_of(queries.column("vec_id").to_numpy(), q, at, (found.column("leaf").to_numpy(), lists.flatten().to_numpy()), found.column("vec_id").to_numpy(), x, k)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    keys = ["shelf", "block"]
    found = wanted.select(*keys, "vec_id", "embedding", "leaves").groupBy(keys).cogroup(placed.select(*keys, "leaf", "vec_id", "embedding").groupBy(keys)).applyInArrow(rerank, "query_id bigint, vec_id bigint, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
