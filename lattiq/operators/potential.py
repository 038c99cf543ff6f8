"""Laplace's equation on the voxels of a volume, solved block by block.

Conjugate gradients, preconditioned by a solve inside each block and one on a coarse grid of cells, so that iterations hardly grow
with the number with the number of blocks. The blocks are a bucketed table, so what they hold is never shuffled: an iteration hands the faces of the direction
to the neighbours, sums up how far to go, and moves the solution and solves inside the blocks. Only sums, and a number for each cell of the
coarse grid (COARSE**3 at most), come to the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattiq.operators.blocks import AXES, BLOCK, packed
from lattiq.operators.relaxation import reached
from lattiq.operators.tables import Workspace, apart

#: Cells of the coarse grid along an axis, at most: larger volumes have larger cells.
COARSE = 24
#: A solve inside a block ends when its residual has fallen by this, or after so many steps.
#: A looser end needs hardly more iterations (37 for 36 in a grid of 64**3 nearly full), and a third of the steps.
INNER, INNER_MOST = 3e-2, 3000
FREE, FIXED = 1, 2
INSIDE = (slice(1, -1),) * 3
#: Rows of blocks are large: few of them are handed to a Python worker at once.
FEW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "8"}


def near_sum(p: np.ndarray) -> np.ndarray:
    """The sum over the six neighbours of each voxel of a padded block."""
    return p[2:, 1:-1, 1:-1] + p[:-2, 1:-1, 1:-1] + p[1:-1, 2:, 1:-1] + p[1:-1, :-2, 1:-1] + p[1:-1, 1:-1, 2:] + p[1:-1, 1:-1, :-2]


def inner_solve(free: np.ndarray, degree: np.ndarray, r: np.ndarray) -> np.ndarray:
    """z with degree * z - (the sum over free neighbours inside the block) = r on the free voxels, by conjugate gradients."""
    z, p = np.zeros_like(r), np.zeros(tuple(s + 2 for s in r.shape))
    scale = np.where(free, 1 / np.maximum(degree, 1), 0.0)
    y = r * scale
    p[INSIDE] = y
    rz = float((r * y).sum())
    least = INNER * INNER * float((r * r).sum())
    for _ in range(INNER_MOST if rz > 0 else 0):
        ap = np.where(free, degree * p[INSIDE] - near_sum(p), 0.0)
        pap = float((p[INSIDE] * ap).sum())
        if pap <= 0:
            break
        z += rz / pap * p[INSIDE]
        r = r - rz / pap * ap
        if float((r * r).sum()) <= least:
            break
        y = r * scale
        new = float((r * y).sum())
        p[INSIDE] = y + new / rz * p[INSIDE]
        rz = new
    return z


def coarse_solve(rows: np.ndarray, columns: np.ndarray, weights: np.ndarray, diagonal: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x with diagonal * x - (the weighted sum over links) = b, by conjugate gradients; cells that nothing holds stay 0."""
    x, r = np.zeros(len(b)), b.copy()
    scale = np.where(diagonal > 0, 1 / np.maximum(diagonal, 1), 0.0)
    p = y = r * scale
    rz = float(r @ y)
    least = 1e-20 * float(b @ b)
    for _ in range(10 * len(b) if rz > 0 else 0):
        ap = diagonal * p - np.bincount(rows, weights * p[columns], len(b))
        pap = float(p @ ap)
        if pap <= 0:
            break
        x, r = x + rz / pap * p, r - rz / pap * ap
        if float(r @ r) <= least:
            break
        y = r * scale
        new = float(r @ y)
        p, rz = y + new / rz * p, new
    return x


def potential(cells: DataFrame, tolerance: float = 1e-3, most: int = 400, side: int = 32, joined: bool = False) -> DataFrame:
    """z, y, x, u: Laplace's equation with six neighbours on the voxels of cells (z, y, x, f: the value where it is fixed, else null;
    start: where the search for the others begins). Walls have no flux.

    The residual is at most `tolerance` of that of the fixed values alone; `most` iterations without that are an error. Voxels that no
    fixed one reaches keep their start, or 0.5; with joined = True there are none, which saves a search for them."""
    space = Workspace(cells.sparkSession, "potential")
    cells = cells if joined else space.keep(cells.select(*AXES, "f", "start"))
    there = None if joined else reached(cells.select(*AXES, F.col("f").isNotNull().alias("seed")))
    alone = None if joined else cells.join(apart(there), list(AXES), "left_anti").select(*AXES, F.coalesce("start", F.lit(0.5)).alias("u"))
    cells = cells if joined else cells.join(apart(there), list(AXES), "left_semi")
    rows = cells.select(*AXES, F.when(F.col("f").isNull(), FREE).otherwise(FIXED).alias("kind"), F.coalesce("f", "start", F.lit(0.5)).alias("u"), F.coalesce("f", F.lit(0.0)).alias("f"))
    whole = space.keep(packed(rows, ["kind", "u", "f"], side, 1))
    ends = whole.agg(*(f(b).alias(f"{b}{i}") for b in BLOCK for i, f in ((0, F.min), (1, F.max)))).first()
    if ends[0] is None:
        return cells.select(*AXES, F.lit(0.0).alias("u")).limit(0) if joined else alone
    low = np.array([ends[f"{b}0"] for b in BLOCK])
    per = -(-int(max(ends[f"{b}1"] - ends[f"{b}0"] + 1 for b in BLOCK)) // COARSE)  # blocks of a cell along an axis
    cell = lambda block: int(((np.array(block) - low) // per) @ np.array([COARSE * COARSE, COARSE, 1]))
    long = side + 2
    block_of = lambda r: (int(r.bz), int(r.by), int(r.bx))
    arrays = ("x", "r", "p", "z")
    shape = "bz bigint, by bigint, bx bigint, face int, kind binary, " + ", ".join(f"{a} binary" for a in arrays) + ", s0 double, s1 double, s2 double, s3 double, cell int"
    names = [*BLOCK, "face", "kind", *arrays, "s0", "s1", "s2", "s3", "cell"]
    sides = [(axis, end) for axis in range(3) for end in (0, 1)]

    def plane(axis: int, at: int) -> tuple:
        index: list = [slice(1, -1)] * 3
        index[axis] = at
        return tuple(index)

    def read(data: bytes) -> np.ndarray:
        return np.frombuffer(data).reshape(side, side, side)

    def masks(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        kind = np.frombuffer(data, np.uint8).reshape(long, long, long)
        return kind, kind[INSIDE] == FREE, near_sum((kind > 0).astype(float))

    def begin(batches):
        """r = b - A x, z, and the links of a block's cell: rows of face -2 have the other cell in s0 and the links in s1."""
        for pdf in batches:
            for row in pdf.itertuples():
                block = block_of(row)
                grid = np.frombuffer(row.cells).reshape(long, long, long, 3)
                data = grid[..., 0].astype(np.uint8).tobytes()
                kind, free, degree = masks(data)
                if not (kind[INSIDE] > 0).any():
                    continue  # only a halo: no voxel of its own
                r = np.where(free, near_sum(np.where(kind > 0, grid[..., 1], 0.0)) - degree * grid[INSIDE][..., 1], 0.0)
                b = np.where(free, near_sum(np.where(kind == FIXED, grid[..., 2], 0.0)), 0.0)
                z = inner_solve(free, degree, r)
                mine = cell(block)
                out = [(*block, -1, data, np.ascontiguousarray(grid[INSIDE][..., 1]).tobytes(), r.tobytes(), np.zeros_like(r).tobytes(), z.tobytes(), float((r * r).sum()), float((r * z).sum()), float(b.ravel() @ b.ravel()), float(r.sum()), mine)]
                held = float((near_sum((kind == FIXED).astype(float)) * free).sum())
                for axis, end in sides:
                    to = list(block)
                    to[axis] += 1 if end else -1
                    links = float(((kind[plane(axis, -2 if end else 1)] == FREE) & (kind[plane(axis, -1 if end else 0)] == FREE)).sum())
                    if links and cell(to) != mine:
                        held += links
                        out.append((*block, -2, *[None] * 5, float(cell(to)), links, 0.0, 0.0, mine))
                out.append((*block, -2, *[None] * 5, float(mine), held, 0.0, 0.0, mine))
                yield pd.DataFrame(out, columns=names)

    def direction(row, free: np.ndarray, beta: float, coarse: dict[int, float]) -> np.ndarray:
        """p = z + beta p, padded; its halo is 0."""
        p = np.zeros((long, long, long))
        p[INSIDE] = np.where(free, read(row.z) + coarse.get(row.cell, 0.0), 0.0) + beta * read(row.p)
        return p

    def faces(beta: float, coarse: dict[int, float]):
        """The faces of p for the neighbours."""

        def run(batches):
            for pdf in batches:
                for row in pdf.itertuples():
                    p, out = direction(row, masks(row.kind)[1], beta, coarse), []
                    for axis, end in sides:
                        face = p[plane(axis, -2 if end else 1)]
                        if face.any():
                            to = list(block_of(row))
                            to[axis] += 1 if end else -1
                            out.append((*to, 2 * axis + 1 - end, face.tobytes()))
                    yield pd.DataFrame(out, columns=[*BLOCK, "face", "plane"])

        return run

    def applied(row, near: pd.DataFrame, beta: float, coarse: dict[int, float]) -> tuple:
        """p and q = A p of a block, what is free in it and the degrees."""
        _, free, degree = masks(row.kind)
        p = direction(row, free, beta, coarse)
        for face, data in zip(near["face"], near["plane"], strict=True):
            p[plane(face // 2, -1 if face % 2 else 0)] = np.frombuffer(data).reshape(side, side)
        return p[INSIDE], np.where(free, degree * p[INSIDE] - near_sum(p), 0.0), free, degree

    def product(beta: float, coarse: dict[int, float]):
        """The block's part of p q."""

        def run(own: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
            found = [applied(row, near, beta, coarse) for row in own.itertuples()]
            return pd.DataFrame({"s0": [float((p * q).sum()) for p, q, *_ in found]})

        return run

    def moved(alpha: float, beta: float, coarse: dict[int, float]):
        """x, r, p and z after a step; s0 to s3 are the block's parts of r r, r z, r times the z before, and r."""

        def run(own: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
            out = []
            for row in own.itertuples():
                p, q, free, degree = applied(row, near, beta, coarse)
                x, r = read(row.x) + alpha * p, read(row.r) - alpha * q
                before = np.where(free, read(row.z) + coarse.get(row.cell, 0.0), 0.0)
                z = inner_solve(free, degree, r)
                out.append((*block_of(row), -1, row.kind, x.tobytes(), r.tobytes(), p.tobytes(), z.tobytes(), float((r * r).sum()), float((r * z).sum()), float((r * before).sum()), float(r.sum()), row.cell))
            return pd.DataFrame(out, columns=names)

        return run

    def summed(state: DataFrame) -> tuple[list[float], dict[int, float], float]:
        """The sums of s0, s1 and s2, what the coarse grid adds to z in each cell, and to r z."""
        found = state.filter("face = -1").groupBy("cell").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(4))).collect()  # COARSE**3 rows at most
        b = np.zeros(len(diagonal))
        for r in found:
            b[index[r.cell]] = r.s3
        add = coarse_solve(*links, diagonal, b)
        return [math.fsum(r[f"s{i}"] for r in found) for i in range(3)], {c: float(add[i]) for c, i in index.items()}, float(b @ add)

    state = space.bucketed(whole.mapInPandas(begin, shape), BLOCK, FEW)
    coupling = state.filter("face = -2").groupBy("cell", F.col("s0").cast("int").alias("other")).agg(F.sum("s1").alias("w")).collect()  # seven a cell at most
    index = {c: i for i, c in enumerate(sorted({r.cell for r in coupling} | {r.other for r in coupling}))}
    diagonal = np.zeros(len(index))
    for r in coupling:
        if r.cell == r.other:
            diagonal[index[r.cell]] = r.w
    between = [r for r in coupling if r.cell != r.other]
    links = np.array([index[r.cell] for r in between], int), np.array([index[r.other] for r in between], int), np.array([r.w for r in between], float)
    (rr, rz, bb), coarse, more = summed(state)
    rz, beta, done = rz + more, 0.0, 0
    while rr > tolerance * tolerance * bb:
        if done == most:
            raise ValueError(f"the potential has not converged after {most} iterations: residual {np.sqrt(rr / max(bb, 1e-300)):.2g}")
        own = state.filter("face = -1")
        news = space.keep(own.mapInPandas(faces(beta, coarse), "bz bigint, by bigint, bx bigint, face int, plane binary"), FEW)
        both = own.groupBy(*BLOCK).cogroup(news.groupBy(*BLOCK))
        pq = both.applyInPandas(product(beta, coarse), "s0 double").agg(F.sum("s0")).first()[0]
        if not pq or pq <= 0:
            raise ValueError("the potential's search has no direction left")
        last, state = state, space.bucketed(both.applyInPandas(moved(rz / pq, beta, coarse), shape), BLOCK)
        space.drop(last)
        space.drop(news)
        (rr, new, old), coarse, more = summed(state)
        new += more
        beta, rz, done = (new - old) / rz, new, done + 1

    def voxels(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                kind, _, _ = masks(row.kind)
                at = np.argwhere(kind[INSIDE] > 0)
                place = at + np.array(block_of(row)) * side
                yield pd.DataFrame({**{a: place[:, k] for k, a in enumerate(AXES)}, "u": read(row.x)[tuple(at.T)]})

    found = space.keep(state.filter("face = -1").mapInPandas(voxels, "z bigint, y bigint, x bigint, u double"), FEW)
    return found if joined else found.unionByName(alone)


def along(cells: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """cells with start: their place between the middles of source and target, 0 to 1; 0.5 where these are one."""
    middle = [s.agg(*(F.avg(a).alias(a) for a in AXES)).first() for s in (source, target)]
    if middle[0].z is None or middle[1].z is None:
        return cells.withColumn("start", F.lit(0.5))
    way = {a: middle[1][a] - middle[0][a] for a in AXES}
    squared = sum(w * w for w in way.values())
    if squared <= 1e-18:
        return cells.withColumn("start", F.lit(0.5))
    share = sum(((F.col(a) - middle[0][a]) * way[a] for a in AXES), F.lit(0.0)) / squared
    return cells.withColumn("start", F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)))
