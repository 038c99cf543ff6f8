"""Window operators on ordered tracks: differences, islands, carried values, schedules, as-of joins, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(key: list[str], by: list[str]):
    return Window.partitionBy(*key).orderBy(*by)


def so_far(key: list[str], by: list[str]):
    return ordered(key, by).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def differenced(df: DataFrame, key: list[str], by: list[str], value: str, name: str) -> DataFrame:
    return df.withColumn(name, F.col(value) - F.lag(value).over(ordered(key, by)))


def islands(df: DataFrame, key: list[str], by: list[str], breaks: Column, name: str = "island") -> DataFrame:
    """Numbers runs from 0: a new one begins where `breaks` holds (nulls do not break)."""
    return df.withColumn(name, F.sum(F.when(breaks, 1).otherwise(0)).over(so_far(key, by)).cast("bigint"))


def carried(df: DataFrame, key: list[str], by: list[str], value: str, name: str) -> DataFrame:
    """The last value that was not null, up to each row."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(so_far(key, by)))


def switches(df: DataFrame, key: list[str], by: list[str], mode: str) -> DataFrame:
    """Rows whose mode differs from the one before, with that one."""
    return df.withColumn("previous", F.lag(mode).over(ordered(key, by))).filter(F.col("previous") != F.col(mode))


def smootherstep(x: Column) -> Column:
    x = F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    return x * x * x * (x * (x * 6 - 15) + 10)


def smoothstep(x: Column) -> Column:
    x = F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    return x * x * (3 - 2 * x)


def crossfade(events: DataFrame, ticks: DataFrame, key: list[str], half: int) -> DataFrame:
    """Per tick (key, frame) the ramp 0 ... 1 through the latest event (key, at) within half frames of it, else null.

    A tick meets events through equal buckets of 2 * half + 1 frames, not by a nested loop."""
    size = 2 * half + 1
    e = events.withColumn("_b", F.explode(F.array(F.floor((F.col("at") - half) / size), F.floor((F.col("at") + half) / size)))).distinct()
    t = ticks.withColumn("_b", F.floor(F.col("frame") / size))
    near = t.join(e, [*key, "_b"]).filter(F.abs(F.col("frame") - F.col("at")) <= half)
    last = near.groupBy(*key, "frame").agg(F.max("at").alias("at"))
    return ticks.join(last, [*key, "frame"], "left").withColumn("ramp", F.when(F.col("at").isNotNull(), smootherstep((F.col("frame") - F.col("at") + half) / (2 * half))))


def as_of(left: DataFrame, right: DataFrame, key: list[str], at: str, values: list[str]) -> DataFrame:
    """left with the values of the last right row of its key at or before it: one union, one window, no pairs."""
    both = left.withColumn("_side", F.lit(1)).unionByName(right.select(*key, at, *values).withColumn("_side", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = F.last(F.when(F.col("_side") == 0, F.struct(*values)), ignorenulls=True).over(w)
    return both.withColumn("_h", held).filter("_side = 1").select(*left.columns, *(F.col(f"_h.{v}").alias(v) for v in values))


def bracketed(df: DataFrame, key: list[str], by: str, values: list[str]) -> DataFrame:
    """Each row with the next one's place and values: the intervals between keyframes."""
    w = ordered(key, [by])
    return df.select(*key, by, *values, F.lead(by).over(w).alias(f"next_{by}"), *(F.lead(v).over(w).alias(f"next_{v}") for v in values))


def chord_lengths(df: DataFrame, key: list[str], by: list[str], axes: list[str]) -> DataFrame:
    """Adds seg (the distance from the row before, 0 for the first) and cum (their sum up to the row)."""
    w = ordered(key, by)
    seg = F.sqrt(sum(((F.col(a) - F.lag(a).over(w)) * (F.col(a) - F.lag(a).over(w)) for a in axes), F.lit(0.0)))
    return df.withColumn("seg", F.coalesce(seg, F.lit(0.0))).withColumn("cum", F.sum("seg").over(so_far(key, by)))


def resampled(df: DataFrame, key: list[str], by: list[str], axes: list[str], n: int) -> DataFrame:
    """n points on each polyline at equal arc length, (i + 0.5) / n of the whole, by linear interpolation, with tangents.

    Each segment finds the samples it holds by arithmetic on its own ends, so nothing is joined."""
    line = chord_lengths(df, key, by, axes)
    w = ordered(key, by)
    whole = F.max("cum").over(Window.partitionBy(*key))
    segs = line.select(*key, F.col("cum").alias("c0"), F.lead("cum").over(w).alias("c1"), whole.alias("total"), *(c for a in axes for c in (F.col(a).alias(f"{a}0"), F.lead(a).over(w).alias(f"{a}1"))))
    segs = segs.filter("c1 > c0").withColumn("first", F.ceil(F.col("c0") / F.col("total") * n - 0.5)).withColumn("last", F.ceil(F.col("c1") / F.col("total") * n - 0.5) - 1)
    segs = segs.withColumn("last", F.least(F.col("last"), F.lit(n - 1))).filter("last >= first").withColumn("i", F.explode(F.sequence("first", "last")))
    f = ((F.col("i") + 0.5) / n * F.col("total") - F.col("c0")) / (F.col("c1") - F.col("c0"))
    return segs.select(*key, "i", *((F.col(f"{a}0") + f * (F.col(f"{a}1") - F.col(f"{a}0"))).alias(a) for a in axes), *(((F.col(f"{a}1") - F.col(f"{a}0")) / (F.col("c1") - F.col("c0"))).alias(f"t{a}") for a in axes))


def rings(df: DataFrame, key: list[str], by: list[str], axes: list[str], spacing: float, up: dict, offset: float = 0.0) -> DataFrame:
    """key, i, axes, t<axis>: places at one, two, ... spacings along each polyline moved by `offset` along `up` (axis to column), before its end,
    and the unit direction there, from the point before the segment's first to its last."""
    moved = df.select(*key, *by, *((F.col(a) + up[a] * offset).alias(a) for a in axes))
    line = chord_lengths(moved, key, by, axes)
    w = ordered(key, by)
    segs = line.select(*key, F.max("cum").over(Window.partitionBy(*key)).alias("total"), F.col("cum").alias("c0"), F.lead("cum").over(w).alias("c1"), *(c for a in axes for c in (F.col(a).alias(f"{a}0"), F.lead(a).over(w).alias(f"{a}1"), F.coalesce(F.lag(a).over(w), F.col(a)).alias(f"{a}_"))))
    segs = segs.filter("c1 > c0").withColumn("first", F.floor(F.col("c0") / spacing) + 1).withColumn("last", F.floor(F.col("c1") / spacing)).filter("last >= first")
    segs = segs.withColumn("i", F.explode(F.sequence("first", "last"))).filter(F.col("i") * spacing < F.col("total"))
    f = (F.col("i") * spacing - F.col("c0")) / (F.col("c1") - F.col("c0"))
    way = {a: F.col(f"{a}1") - F.col(f"{a}_") for a in axes}
    long = F.sqrt(sum((d * d for d in way.values()), F.lit(0.0)))
    return segs.select(*key, "i", *((F.col(f"{a}0") + f * (F.col(f"{a}1") - F.col(f"{a}0"))).alias(a) for a in axes), *(F.when(long > 0, d / long).otherwise(0.0).alias(f"t{a}") for a, d in way.items()))


def velocity_profile(df: DataFrame, key: list[str], by: str, limit: str, twice_a_ds: float) -> DataFrame:
    """v: the greatest speed under `limit` whose square changes by at most twice_a_ds a step, forwards and backwards.

    The recurrences are running minima: v2[i] = min over j <= i of (limit2[j] + 2 a ds (i - j))."""
    rows = df.withColumn("_i", F.row_number().over(ordered(key, [by])).cast("double"))
    sq = F.col(limit) * F.col(limit)
    ahead = F.min(sq - twice_a_ds * F.col("_i")).over(so_far(key, ["_i"])) + twice_a_ds * F.col("_i")
    rows = rows.withColumn("_f", ahead)
    back = F.min(F.col("_f") + twice_a_ds * F.col("_i")).over(Window.partitionBy(*key).orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - twice_a_ds * F.col("_i")
    return rows.withColumn("v", F.sqrt(F.greatest(back, F.lit(0.0)))).drop("_i", "_f")


def drifted(df: DataFrame, key: list[str], by: str, velocities: list[str], most: float = 1.0) -> DataFrame:
    """Adds moved_<v>: the way made up to each row at the velocity each row sets, by the times between rows (column `by`, seconds);
    times of more than `most`, or of none, move nothing."""
    w = ordered(key, [by])
    dt = F.col(by) - F.lag(by).over(w)
    rows = df.withColumn("_dt", F.when((dt > 0) & (dt <= most), dt).otherwise(0.0))
    rows = rows.withColumns({f"_{v}": F.coalesce(F.lag(v).over(w), F.lit(0.0)) * F.col("_dt") for v in velocities})
    return rows.withColumns({f"moved_{v}": F.sum(f"_{v}").over(so_far(key, [by])) for v in velocities}).drop("_dt", *(f"_{v}" for v in velocities))


def monotone_bounds(df: DataFrame, key: list[str], by: str, low: str, least: float) -> DataFrame:
    """lo[i] = max(low[i], lo[i-1] + least): a running maximum of low - least * i."""
    rows = df.withColumn("_i", F.row_number().over(ordered(key, [by])).cast("double"))
    return rows.withColumn("lo", F.max(F.col(low) - least * F.col("_i")).over(so_far(key, ["_i"])) + least * F.col("_i")).drop("_i")


def modular(df: DataFrame, frame: Column, phase: Column, life: int) -> DataFrame:
    """Adds at, the template frame of (frame + phase) modulo life, and alpha, the triangle over a life (1 in its middle)."""
    at = F.pmod(frame + phase, F.lit(life))
    return df.withColumn("at", at.cast("bigint")).withColumn("alpha", 1 - F.abs(2 * at / F.lit(float(life)) - 1))


def visibility(track: DataFrame, key: list[str], fps: int, intro_s: float = 35.0, fixed_mode: str = "mesh_all", fixed_s: float = 64.0, fixed_for_s: float = 5.0, mode_s: int = 6, lames_s: int = 3, calm_degrees: float = 1.0, calm_s: float = 0.3, wait_s: float = 8.0) -> DataFrame:
    """key, kind, mode, start, stop: the frames [start, stop) in which a panel shows. track: key, frame (0, 1, ...), mode, lames
    (boolean), turn (degrees since the frame before).

    mode: from the first frame of each mode after the intro, but for the fixed one. lames: from every frame after the intro where
    lames appear, put off to the first calm_s of little turning that begin there within wait_s. fixed: from fixed_s on. No
    interval goes beyond the track."""
    w, last = ordered(key, ["frame"]), Window.partitionBy(*key)
    calm_n, wait = max(1, round(fps * calm_s)), round(fps * wait_s)
    rows = track.withColumn("_n", F.max("frame").over(last) + 1)
    late = F.col("frame") / fps >= intro_s
    first = rows.filter(late & F.col("mode").isNotNull() & (F.col("mode") != "") & (F.col("mode") != fixed_mode))
    modes = first.groupBy(*key, "mode").agg(F.min("frame").alias("start"), F.first("_n").alias("_n")).select(*key, F.lit("mode").alias("kind"), "mode", "start", F.least(F.col("start") + mode_s * fps, "_n").alias("stop"))
    # how many calm frames in a row end here, and the next frame that ends enough of them
    calm = F.coalesce(F.col("turn"), F.lit(0.0)) < calm_degrees
    rows = rows.withColumn("_calm", calm).withColumn("_break", F.max(F.when(~calm, F.col("frame"))).over(so_far(key, ["frame"])))
    enough = F.when(F.col("frame") - F.coalesce("_break", F.lit(-1)) >= calm_n, F.col("frame"))
    backwards = so_far(key, [F.desc("frame")])  # a running minimum; a frame to the end would be gone through anew for every row
    rows = rows.withColumn("_next", F.min(enough).over(backwards))
    rows = rows.withColumn("_end", F.lead("_next", calm_n - 1).over(w)).withColumn("_up", F.col("lames") & ~F.coalesce(F.lag("lames").over(w), F.lit(False)))
    start = F.when(F.col("_end") < F.col("frame") + wait, F.col("_end") - calm_n + 1).otherwise(F.col("frame"))
    lames = rows.filter(late & F.col("_up")).select(*key, F.lit("lames").alias("kind"), "mode", start.alias("start"), F.least(start + lames_s * fps, "_n").alias("stop"))
    t = F.col("frame") / fps
    fixed = rows.filter(late & (t >= fixed_s) & (t < fixed_s + fixed_for_s)).groupBy(*key).agg(F.min("frame").alias("start"), (F.max("frame") + 1).alias("stop")).select(*key, F.lit("fixed").alias("kind"), F.lit(fixed_mode).alias("mode"), "start", "stop")
    return modes.unionByName(lames).unionByName(fixed)


def gaussian_smoothed(df: DataFrame, key: list[str], by: str, value: str, sigma: int, name: str) -> DataFrame:
    """A Gaussian cut at 2 sigma run forwards and then backwards, the ends repeated: its kernel with itself, as shifted columns
    of one window."""
    import numpy as np

    one = np.exp(-0.5 * (np.arange(-2 * sigma, 2 * sigma + 1) / sigma) ** 2)
    weights = np.convolve(one / one.sum(), one / one.sum()).tolist()
    reach = 4 * sigma
    w = ordered(key, [by])
    whole = Window.partitionBy(*key).orderBy(by).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = df.withColumn("_a", F.first(value).over(whole)).withColumn("_z", F.last(value).over(whole))
    terms = [F.lit(g) * F.coalesce(F.lag(value, -k).over(w), F.col("_a")) if k < 0 else F.lit(g) * F.coalesce(F.lead(value, k).over(w), F.col("_z")) if k else F.lit(g) * F.col(value) for k, g in zip(range(-reach, reach + 1), weights, strict=True)]
    return rows.withColumn(name, sum(terms, F.lit(0.0))).drop("_a", "_z")
