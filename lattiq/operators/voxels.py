"""Operators on voxel tables: vol columns z, y, x (bigint) and a value v (double); absent voxels are background."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattiq.operators.tables import Workspace, quantiles

AXES = ("z", "y", "x")


def same_extent(a: DataFrame, b: DataFrame) -> bool:
    """Whether two volumes reach equally far on every axis."""
    ends = lambda df: df.agg(*(F.max(c).alias(c) for c in AXES)).first()
    return ends(a) == ends(b)


def profile(df: DataFrame, value: str = "v") -> DataFrame:
    """One row: count, least, greatest, mean, median, 95th percentile, positive values, distinct values."""
    df = Workspace(df.sparkSession, "profile").keep(df.select(F.col(value).alias("v")))
    row = df.agg(F.count("*").alias("n"), F.min("v").alias("v_min"), F.max("v").alias("v_max"), F.avg("v").alias("v_mean"), F.count_if(F.col("v") > 0).alias("n_pos"), F.countDistinct("v").alias("n_values"), F.count("v").alias("_n"))
    r = row.first()
    p50, p95 = quantiles(df, "v", [0.5, 0.95], known=(r["_n"], r.v_min, r.v_max, r.n_values))
    kinds = {f.name: f.dataType for f in row.schema.fields} | {"p50": "double", "p95": "double"}
    values = r.asDict() | {"p50": p50, "p95": p95}
    return df.sparkSession.range(1).select(*(F.lit(values[c]).cast(kinds[c]).alias(c) for c in ("n", "v_min", "v_max", "v_mean", "p50", "p95", "n_pos", "n_values")))


def combined(a: DataFrame, b: DataFrame, name: str, check: bool = True) -> DataFrame:
    """Two aligned volumes voxel by voxel; b's value becomes column `name`. Raises if the extents differ."""
    if check and not same_extent(a, b):
        raise ValueError("volumes of different extents")
    return a.join(b.select(*AXES, F.col("v").alias(name)), list(AXES))


def excluded(df: DataFrame, outer: DataFrame, sentinel: float = -1.0) -> DataFrame:
    """Values of voxels that outer (a set of voxels of the same volume) holds become the sentinel. Voxels of outer beyond the volume are
    an error: they come of another one."""
    last, far = ends(df), ends(outer)
    if any(far[c] > last[c] for c in AXES):
        raise ValueError("volumes of different extents")
    marks = outer.select(*AXES, F.lit(True).alias("_out")).distinct()
    return df.join(marks, list(AXES), "left").withColumn("v", F.when(F.col("_out"), F.lit(sentinel)).otherwise(F.col("v"))).drop("_out")


def within(df: DataFrame, mask: DataFrame) -> DataFrame:
    """df restricted to the mask, or df itself if nothing would be left."""
    kept = df.join(mask.select(*AXES).distinct(), list(AXES), "left_semi")
    return df if kept.isEmpty() else kept


def ends(df: DataFrame) -> dict[str, int]:
    """The greatest index of each axis (one row)."""
    r = df.agg(*(F.max(c).alias(c) for c in AXES)).first()
    return {c: -1 if r[c] is None else r[c] for c in AXES}


def on_face(last: dict[str, int]) -> Column:
    return reduce(lambda p, q: p | q, ((F.col(c) == 0) | (F.col(c) == n) for c, n in last.items()))


def sealed(df: DataFrame, fill: float) -> DataFrame:
    """The six outer faces set to `fill`."""
    return df.withColumn("v", F.when(on_face(ends(df)), F.lit(float(fill))).otherwise(F.col("v")))


def face_values(df: DataFrame) -> DataFrame:
    """face, n_values: distinct values on each of the six faces."""
    last = ends(df)
    faces = F.array_compact(F.array(*(F.when(F.col(c) == at, F.lit(f"{c}{end}")) for c, n in last.items() for end, at in (("min", 0), ("max", n)))))
    return df.select(F.explode(faces).alias("face"), "v").groupBy("face").agg(F.countDistinct("v").alias("n_values"))


def cleaned(value: Column, most: float) -> Column:
    """A distance: not finite, negative or greater than `most` becomes 0."""
    return F.when(F.isnan(value) | value.isNull() | (F.abs(value) == float("inf")) | (value < 0) | (value > most), 0.0).otherwise(value)


def cleaning_counts(value: Column, most: float) -> list[Column]:
    bad = F.isnan(value) | value.isNull() | (F.abs(value) == float("inf"))
    return [F.count_if(bad).alias("n_not_finite"), F.count_if(~bad & (value < 0)).alias("n_negative"), F.count_if(~bad & (value > most)).alias("n_too_large")]


def without_sentinels(df: DataFrame, factor: float = 100.0, share: float = 0.999) -> DataFrame:
    """Values above `factor` times the given percentile of the positive values become 0."""
    (top,) = quantiles(df.filter("v > 0"), "v", [share])
    return df if top is None else df.withColumn("v", F.when(F.col("v") > factor * top, 0.0).otherwise(F.col("v")))


def cropped(df: DataFrame, part: float) -> DataFrame:
    """The first round(part * n) planes of the longest axis (the first of equally long ones)."""
    last = ends(df)
    axis = max(AXES, key=lambda c: (last[c], -AXES.index(c)))
    return df.filter(F.col(axis) < round(part * (last[axis] + 1)))


def banded(df: DataFrame, low: float, high: float) -> DataFrame:
    """v clamped to the band; opacity 1 inside it, 0 outside."""
    v = F.col("v")
    return df.withColumn("opacity", F.when(v.between(low, high), 1.0).otherwise(0.0)).withColumn("v", F.least(F.greatest(v, F.lit(low)), F.lit(high)))


def strided(df: DataFrame, steps: dict[str, int]) -> DataFrame:
    return df.filter(reduce(lambda p, q: p & q, (F.col(c) % s == 0 for c, s in steps.items())))


def chunk_of(index: Column, total: int, chunks: int) -> Column:
    """The chunk k whose range [k * total // chunks, (k + 1) * total // chunks) holds the index."""
    return F.floor(((index + 1) * chunks - 1) / total).cast("bigint")


def stretched(df: DataFrame, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """v rescaled so that the two percentiles become 0 and 255, cut off beyond them."""
    a, b = (q or 0.0 for q in quantiles(df, "v", [low, high]))
    return df.withColumn("v", F.least(F.greatest((F.col("v") - a) / max(b - a, 1e-9), F.lit(0.0)), F.lit(1.0)) * 255)


def rescaled(df: DataFrame) -> DataFrame:
    """v rescaled so that its least and greatest value become 0 and 255."""
    r = df.agg(F.min("v").alias("a"), F.max("v").alias("b")).first()
    return df.withColumn("v", (F.col("v") - (r.a or 0.0)) / max((r.b or 0.0) - (r.a or 0.0), 1e-9) * 255)


def moved(df: DataFrame, offsets: list[tuple[int, int, int]], keep: list[str] = ()) -> DataFrame:
    """Each voxel at each offset (dz, dy, dx)."""
    o = F.explode(F.array(*(F.struct(*(F.lit(d).cast("bigint").alias(f"d{c}") for c, d in zip(AXES, ds, strict=True))) for ds in offsets))).alias("o")
    return df.select(*AXES, *keep, o).select(*((F.col(c) + F.col(f"o.d{c}")).alias(c) for c in AXES), *keep)


SIX = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
TWENTY_SIX = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) != (0, 0, 0)]


def dilated(df: DataFrame, shape: tuple[int, int, int], keep: list[str] = ()) -> DataFrame:
    """The voxels and their six neighbours, within the shape."""
    grown = moved(df, [(0, 0, 0), *SIX], keep)
    return grown.filter(reduce(lambda p, q: p & q, (F.col(c).between(0, n - 1) for c, n in zip(AXES, shape, strict=True)))).distinct()


def exposed_faces(df: DataFrame) -> DataFrame:
    """z, y, x, dz, dy, dx: the voxel sides that border on background: the surface before any smoothing."""
    sides = df.select(*AXES, F.explode(F.array(*(F.struct(*(F.lit(d).cast("bigint").alias(f"d{c}") for c, d in zip(AXES, ds, strict=True))) for ds in SIX))).alias("o")).select(*AXES, "o.*")
    there = df.select(*(F.col(c).alias(f"n{c}") for c in AXES))
    return sides.join(there, reduce(lambda p, q: p & q, (F.col(c) + F.col(f"d{c}") == F.col(f"n{c}") for c in AXES)), "left_anti")


def dense(df: DataFrame, n: int, fill: float = 0.0) -> DataFrame:
    """All n**3 voxels, absent ones with the fill value."""
    spine = df.sparkSession.range(n**3).select((F.col("id") / (n * n)).cast("bigint").alias("z"), ((F.col("id") / n).cast("bigint") % n).alias("y"), (F.col("id") % n).alias("x"))
    return spine.join(df.select(*AXES, "v"), list(AXES), "left").withColumn("v", F.coalesce("v", F.lit(fill)))


def gradient(df: DataFrame, n: int, value: str = "v") -> DataFrame:
    """Adds gz, gy, gx on a dense grid: central differences inside, one-sided at the ends."""
    for c in AXES:
        line = Window.partitionBy(*(a for a in AXES if a != c)).orderBy(c)
        up, down, here = F.lead(value).over(line), F.lag(value).over(line), F.col(value)
        df = df.withColumn(f"g{c}", F.when(F.col(c) == 0, up - here).when(F.col(c) == n - 1, here - down).otherwise((up - down) / 2))
    return df


def divergence(df: DataFrame, n: int, parts: tuple[str, str, str]) -> DataFrame:
    """Adds div: the sum of the parts' differences along their own axes."""
    out = None
    for c, p in zip(AXES, parts, strict=True):
        line = Window.partitionBy(*(a for a in AXES if a != c)).orderBy(c)
        up, down, here = F.lead(p).over(line), F.lag(p).over(line), F.col(p)
        d = F.when(F.col(c) == 0, up - here).when(F.col(c) == n - 1, here - down).otherwise((up - down) / 2)
        out = d if out is None else out + d
    return df.withColumn("div", out)


def nearest_sample(points: DataFrame, df: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """points (pz, py, px doubles) with the value of the nearest voxel: rounded half to even, clipped to the shape."""
    at = points.withColumns({c: F.least(F.greatest(F.bround(f"p{c}").cast("bigint"), F.lit(0)), F.lit(n - 1)) for c, n in zip(AXES, shape, strict=True)})
    return at.join(df.select(*AXES, "v"), list(AXES), "left")


def trilinear(points: DataFrame, df: DataFrame, key: str = "pid") -> DataFrame:
    """key, v: each point's (pz, py, px) value from its eight corners; corners outside the table count as 0."""
    corner = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in (0, 1) for b in (0, 1) for c in (0, 1))))
    p = points.select(key, *(f"p{c}" for c in AXES), corner.alias("k"))
    w = reduce(lambda u, t: u * t, (F.when(F.col(f"k.{k}") == 1, F.col(f"p{c}") - F.floor(f"p{c}")).otherwise(1 - (F.col(f"p{c}") - F.floor(f"p{c}"))) for c, k in zip(AXES, "abc", strict=True)))
    p = p.select(key, w.alias("w"), *((F.floor(f"p{c}") + F.col(f"k.{k}")).alias(c) for c, k in zip(AXES, "abc", strict=True)))
    return p.join(df.select(*AXES, "v"), list(AXES), "left").groupBy(key).agg(F.sum(F.col("w") * F.coalesce("v", F.lit(0.0))).alias("v"))


def slice_at(df: DataFrame, axis: str, at: int) -> DataFrame:
    return df.filter(F.col(axis) == at).drop(axis)


def resized(df: DataFrame, size: int, n: int) -> DataFrame:
    """A slice (rows r, columns c) of n by n drawn at size by size: each pixel takes the source pixel floor(i * n / size)."""
    spine = df.sparkSession.range(size * size).select((F.col("id") / size).cast("bigint").alias("i"), (F.col("id") % size).alias("j"))
    at = spine.withColumn("r", F.floor(F.col("i") * n / size)).withColumn("c", F.floor(F.col("j") * n / size))
    return at.join(df, ["r", "c"], "left").select("i", "j", F.coalesce("v", F.lit(0.0)).alias("v"))


def padded(df: DataFrame, n: int, by: int = 1) -> DataFrame:
    """An n**3 volume in a frame of `by` voxels that lie above its greatest value, so that no surface at a level leaves the grid."""
    top = df.agg(F.max("v")).first()[0] or 0.0
    wide = n + 2 * by
    grid = df.sparkSession.range(wide**3).select((F.col("id") / (wide * wide)).cast("bigint").alias("z"), ((F.col("id") / wide).cast("bigint") % wide).alias("y"), (F.col("id") % wide).alias("x"))
    frame = grid.filter(reduce(lambda p, q: p | q, ((F.col(c) < by) | (F.col(c) >= n + by) for c in AXES))).withColumn("v", F.lit(float(top) + 1.0))
    return df.select(*((F.col(c) + by).alias(c) for c in AXES), "v").unionByName(frame)


def grown_crop(component: DataFrame, volume: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """The box of a component grown by one voxel each way: values of the volume on the component and its six neighbours, -1 elsewhere."""
    grown = dilated(component, shape)
    box = grown.agg(*(f(c).alias(f"{c}{i}") for c in AXES for i, f in ((0, F.min), (1, F.max))))
    sides = reduce(lambda d, c: d.withColumn(c, F.explode(F.sequence(f"{c}0", f"{c}1"))), AXES, box).select(*AXES)
    kept = grown.join(volume.select(*AXES, "v"), list(AXES), "left").select(*AXES, F.coalesce("v", F.lit(0.0)).alias("v"))
    return sides.join(kept, list(AXES), "left").withColumn("v", F.coalesce("v", F.lit(-1.0)))


def square_crop(df: DataFrame, row: int, column: int, side: int, n: int) -> DataFrame:
    """The side * side square of an n * n slice (r, c, v) around a place, pushed inside the slice; r and c count from its corner."""
    low = lambda at: max(0, min(at - side // 2, n - side))
    r, c = low(row), low(column)
    return df.filter(F.col("r").between(r, r + side - 1) & F.col("c").between(c, c + side - 1)).select((F.col("r") - r).alias("r"), (F.col("c") - c).alias("c"), "v")
