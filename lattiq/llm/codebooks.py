"""Compression of vectors to codes: a codebook for each part of a vector, trained by Yinyang Lloyd in integers.

Entries of a codebook are put into groups. A part keeps an upper bound of the distance to its entry and a lower bound for each
group of all its other entries; when entries move, bounds drift with them, and a group is looked at only where its bound
does not exceed the upper one. Bounds are rounded outwards; what is looked at is decided by exact integers, so codes
are those of a plain search, ties included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.llm.common import Scratch, ship

#: Components beyond this, after scaling, are an error: sums of a task would not fit.
LARGEST = 1 << 31
#: Labels up to this many are broadcast with their sums; beyond it they are joined by shuffle, a hot label dealt over SALTS.
FEW_LABELS, SALTS = 100_000, 32
#: Bounds are kept in single precision, rounded outwards by this share.
OUTWARD = 2.0**-22


@dataclass
class Codebooks:
    """entries[part]: a list of entries, each a list of integers; groups[part]: the group of each entry."""

    entries: list[list[list[int]]]
    groups: list[list[int]]

    @property
    def sha256(self) -> str:
        """The digest of all components by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(v) for part in self.entries for entry in part for v in entry).encode()).hexdigest()


def integers(table: DataFrame, parts: int, scale: int) -> DataFrame:
    """vec_id, label, x (array of bigint, rounded down) of the vectors that take part: not null, no null or non-finite component,
    and of the most frequent dimension that `parts` divides (the greatest of equally frequent ones)."""
    rows = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("e")).filter("e is not null")
    rows = rows.filter(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    sizes = rows.groupBy(F.size("e").alias("d")).count().filter((F.col("d") > 0) & (F.col("d") % parts == 0))
    most = sizes.orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("e") == (most.d if most else 0)).select("vec_id", "label", F.transform("e", lambda x: F.floor(x * scale)).alias("x"))


def grouped(entries: np.ndarray, groups: int) -> list[int]:
    """A group for each entry by a few rounds of means from spread starts; groups are numbered without gaps."""
    e = entries.astype(float)
    centres = e[np.linspace(0, len(e) - 1, min(groups, len(e))).astype(int)]
    for _ in range(5):
        of = ((e[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        centres = np.stack([e[of == g].mean(0) if (of == g).any() else centres[g] for g in range(len(centres))])
    return np.unique(of, return_inverse=True)[1].tolist()


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all of c; exact, as the type was chosen for it."""
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None]


def roots(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(float))


def first_codes(x: np.ndarray, new: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, ...]:
    """code, upper bound, lower bounds of the rows of a part, by a look at all entries."""
    d = squares(x, new)
    code = d.argmin(1)
    far = roots(d)
    upper = far[np.arange(len(x)), code]
    far[np.arange(len(x)), code] = np.inf
    return code, upper, np.stack([far[:, group == g].min(1) for g in range(group.max() + 1)], 1)


def next_codes(x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, old: np.ndarray, new: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same after the entries moved from old to new, by a look at the groups whose bound fails alone."""
    drift = roots(((new - old) ** 2).sum(1)) * (1 + 1e-12)
    upper = upper + drift[code]
    lower = np.maximum(lower - np.array([drift[group == g].max() for g in range(group.max() + 1)]), 0)
    live = np.flatnonzero((lower <= upper[:, None]).any(1))
    if not len(live):
        return code, upper, lower
    code, was, mine = code.copy(), code[live], x[live]
    own = ((mine - new[was]) ** 2).sum(1)
    upper[live] = roots(own) * (1 + 1e-12)
    look = lower[live] <= upper[live][:, None]
    d = np.full((len(live), len(new)), np.inf, x.dtype)
    d[np.arange(len(live)), was] = own
    for g in range(look.shape[1]):
        rows, members = np.flatnonzero(look[:, g]), np.flatnonzero(group == g)
        d[rows[:, None], members] = squares(mine[rows], new[members])
    best = d.argmin(1)  # the lower index of equally near entries; groups not looked at are farther
    far = roots(d)
    upper[live] = far[np.arange(len(live)), best]
    far[np.arange(len(live)), best] = np.inf
    for g in range(look.shape[1]):
        rows = np.flatnonzero(look[:, g])
        lower[live[rows], g] = far[rows][:, group == g].min(1)
    left = np.flatnonzero(best != was)
    lower[live[left], group[was[left]]] = np.minimum(lower[live[left], group[was[left]]], roots(own[left]))
    code[live] = best
    return code, upper, lower


def _pass(state: DataFrame, old: Codebooks | None, new: Codebooks, exact: type, last: bool) -> DataFrame:
    """One look at all rows: their codes and bounds for `new`; one further row a task holds what its rows add to the sums.

    A last pass gives error in place of the bounds, and no sums."""
    books = state.sparkSession.sparkContext.broadcast((old, new))  # parts x entries
    sizes = [len(new.entries), len(new.entries[0]), len(new.entries[0][0])]
    n_groups = [max(g) + 1 for g in new.groups]
    stride = 1 + max(n_groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, now = books.value
        parts, k, d = sizes
        after = [np.array(e, exact) for e in now.entries]
        earlier = [np.array(e, exact) for e in before.entries] if before else None
        group = [np.array(g) for g in now.groups]
        sums = np.zeros((parts, k, d + 1), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            whole = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, parts, d)
            codes = np.zeros((b.num_rows, parts), np.uint8)
            bounds = np.full((b.num_rows, parts, stride), np.inf, np.float32)
            if before:
                held = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(codes.shape)
                kept = np.frombuffer(b"".join(b.column(4).to_pylist()), np.float32).reshape(bounds.shape)
            error = np.zeros(b.num_rows, exact)
            for p in range(parts):
                x = whole[:, p].astype(exact)
                if before:
                    was = held[:, p].astype(np.int64)
                    code, upper, lower = next_codes(x, was, kept[:, p, 0].astype(float), kept[:, p, 1 : 1 + n_groups[p]].astype(float), earlier[p], after[p], group[p])
                    moved = np.flatnonzero(code != was)
                else:
                    was, (code, upper, lower) = None, first_codes(x, after[p], group[p])
                    moved = np.arange(len(x))
                codes[:, p] = code
                if last:
                    error += ((x - after[p][code]) ** 2).sum(1)
                    continue
                bounds[:, p, 0] = upper * (1 + OUTWARD)
                bounds[:, p, 1 : 1 + n_groups[p]] = lower * (1 - OUTWARD)
                np.add.at(sums[p, :, :d], code[moved], whole[moved, p])
                sums[p, :, d] += np.bincount(code[moved], minlength=k)
                if was is not None:
                    np.subtract.at(sums[p, :, :d], was[moved], whole[moved, p])
                    sums[p, :, d] -= np.bincount(was[moved], minlength=k)
            if last:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes().hex() for r in codes], pa.string()), pa.array([int(e) for e in error], pa.int64())], names=["vec_id", "label", "code", "error"])
            else:
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([r.tobytes() for r in codes], pa.binary()), pa.array([r.tobytes() for r in bounds], pa.binary()), pa.nulls(b.num_rows, pa.list_(pa.int64()))], names=["vec_id", "label", "x", "codes", "bounds", "sums"])
        if not last and sums.any():
            none = [pa.nulls(1, t) for t in (pa.int64(), label_type, pa.list_(pa.int64()), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*none, pa.array([sums.ravel().tolist()], pa.list_(pa.int64()))], names=["vec_id", "label", "x", "codes", "bounds", "sums"])

    from pyspark.sql.pandas.types import to_arrow_type

    label_type = to_arrow_type(state.schema["label"].dataType)
    kind = state.schema["label"].dataType.simpleString()
    if last:
        return state.mapInArrow(run, f"vec_id bigint, label {kind}, code string, error bigint")
    return state.mapInArrow(run, f"vec_id bigint, label {kind}, x array<bigint>, codes binary, bounds binary, sums array<bigint>")


def compress(spark: SparkSession, table: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, groups: int = 4) -> tuple[DataFrame, Codebooks | None]:
    """(vec_id, label, code, error) of every vector that takes part (see integers()), and the codebooks.

    The codebooks begin as the parts of the vectors of the `entries` smallest vec_ids (all, if there are fewer; of equal ids the
    lesser vector, null ids last). A round gives each part its nearest entry, the lower of equally near ones, and moves every
    entry to its parts' means, rounded down; entries without parts stay. A round costs one pass over a table of rows with their codes
    and bounds, without a shuffle; a task sends its sums alone. Rounds after one that moves nothing change nothing and are left out.
    Repeated rows give equal rows and count as often as they occur; without vectors the result is empty and there are no codebooks.
    Components of LARGEST or more after scaling are an error.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hexadecimal digits: 1 to 256 entries")
    ship(spark)
    scratch = Scratch(spark, "codebooks")
    state = scratch.keep(integers(table, parts, scale), "rows")
    start = [r.x for r in state.select("vec_id", "x").orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).collect()]
    if not start:
        return state.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error")), None
    low, high = state.agg(F.min(F.array_min("x")), F.max(F.array_max("x"))).first()
    most = max(high, -low)
    if most > LARGEST:
        raise ValueError(f"components of {LARGEST} or more after scaling")
    d = len(start[0]) // parts
    exact = float if 4 * d * most * most < 1 << 53 else object  # doubles hold these integers; beyond that Python's own
    books = [[v[p * d : (p + 1) * d] for v in start] for p in range(parts)]
    new = Codebooks(books, [grouped(np.array(e), groups) for e in books])
    old, sums = None, np.zeros((parts, len(start), d + 1), object)
    for _ in range(rounds):
        before, state = state, scratch.keep(_pass(state, old, new, exact, last=False), "round")
        scratch.drop(before)
        part = state.filter("sums is not null").select(F.posexplode("sums")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("s"))
        for r in part.collect():  # parts x entries x (components + 1)
            sums.reshape(-1)[r.pos] += int(r.s)
        state = _rows(state)
        moved = [[[int(s) // int(of[-1]) for s in of[:-1]] if of[-1] else e for e, of in zip(new.entries[p], sums[p], strict=True)] for p in range(parts)]
        old, new = new, Codebooks(moved, new.groups)
        if new.entries == old.entries:
            break
    return _pass(state, old, new, exact, last=True), new


def _rows(state: DataFrame) -> DataFrame:
    out = state.filter("sums is null").drop("sums")
    out._lattiq_path = state._lattiq_path
    return out


def with_label_errors(spark: SparkSession, coded: DataFrame) -> DataFrame:
    """coded with label_error: the sum of error over all rows of the same label, null labels together.

    Sums are made before the join, so a label may hold any share of the rows."""
    scratch = Scratch(spark, "codebooks")
    coded = scratch.keep(coded, "codes")
    totals = scratch.keep(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_of"), "labels")
    if totals.count() <= FEW_LABELS:
        return coded.join(F.broadcast(totals), F.col("label").eqNullSafe(F.col("_of"))).drop("_of")
    totals = totals.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = coded.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    return salted.join(totals, F.col("label").eqNullSafe(F.col("_of")) & (F.col("_salt") == F.col("_s"))).drop("_of", "_s", "_salt")


def digests(spark: SparkSession, table: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector that takes part.

    Nulls, repeated rows and empty tables as in compress()."""
    coded, books = compress(spark, table)
    rows = with_label_errors(spark, coded)
    return rows.select("vec_id", "code", "error", "label_error", F.lit(books.sha256 if books else hashlib.sha256(b"").hexdigest()).alias("codebooks_sha256"))
