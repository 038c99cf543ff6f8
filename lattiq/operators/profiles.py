"""Histograms, grids, budgets and summaries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattiq.operators.tables import quantiles

HALF_TURN = 3.141592653589793


def bin_of(value: Column, low: float, high: float, bins: int) -> Column:
    """The bin of a value on equal edges from low to high; the last one holds high as well; null outside."""
    b = F.floor((value - low) / ((high - low) / bins)).cast("bigint")
    return F.when(value == high, bins - 1).when((value >= low) & (value < high), b)


def filled(df: DataFrame, key: str, n: int, counts: list[str]) -> DataFrame:
    """Rows for all of 0 ... n - 1, missing counts as 0."""
    spine = df.sparkSession.range(n).select(F.col("id").alias(key))
    return spine.join(df, key, "left").fillna(0, counts)


def level_histogram(df: DataFrame, low: float, high: float, bins: int, value: str = "v") -> DataFrame:
    b = df.withColumn("bin", bin_of(F.col(value), low, high, bins)).filter("bin is not null")
    return filled(b.groupBy("bin").agg(F.count("*").alias("n")), "bin", bins, ["n"])


def thickening(hist: DataFrame, first: int = 5, low: float = 0.5, high: float = 3.0) -> DataFrame:
    """alpha of each bin: its count over the mean of the first five positive ones, clipped; 1 where nothing is counted."""
    positive = hist.filter("n > 0").withColumn("rn", F.row_number().over(Window.orderBy("bin"))).filter(F.col("rn") <= first)
    base = positive.agg(F.avg("n")).first()[0]
    ratio = F.col("n") / F.lit(float(base or 1.0))
    return hist.withColumn("alpha", F.when(F.col("n") > 0, F.least(F.greatest(ratio, F.lit(low)), F.lit(high))).otherwise(1.0))


def cylindrical(df: DataFrame, cy: float, cx: float, n_long: int, n_angle: int, length: int) -> DataFrame:
    """Adds l and t (bins along the long axis z and of the angle) and radius, about the axis (cy, cx)."""
    dy, dx = F.col("y") - cy, F.col("x") - cx
    angle = (F.atan2(dy, dx) + HALF_TURN) / (2 * HALF_TURN)
    return df.withColumn("l", F.least(F.floor(F.col("z") * n_long / length).cast("bigint"), F.lit(n_long - 1))).withColumn("t", F.least(F.floor(angle * n_angle).cast("bigint"), F.lit(n_angle - 1))).withColumn("radius", F.sqrt(dy * dy + dx * dx))


def ratio_grid(df: DataFrame, condition: Column, n_long: int, n_angle: int) -> DataFrame:
    """l, t, total, hits, ratio on the complete grid; the ratio of an empty cell is 0."""
    cells = df.groupBy("l", "t").agg(F.count("*").alias("total"), F.count_if(condition).alias("hits"))
    spine = df.sparkSession.range(n_long * n_angle).select((F.col("id") / n_angle).cast("bigint").alias("l"), (F.col("id") % n_angle).alias("t"))
    return spine.join(cells, ["l", "t"], "left").fillna(0, ["total", "hits"]).withColumn("ratio", F.coalesce(F.try_divide("hits", "total"), F.lit(0.0)))


def radial_histogram(df: DataFrame, bins: int, by: list[str] = ("l", "t")) -> DataFrame:
    """l, t, k, total, hits: radial bins between the least and greatest radius of each sector; needs a boolean column hit."""
    ends = df.groupBy(*by).agg(F.min("radius").alias("r0"), F.max("radius").alias("r1"))
    k = F.least(F.floor((F.col("radius") - F.col("r0")) / F.greatest(F.col("r1") - F.col("r0"), F.lit(1e-9)) * bins).cast("bigint"), F.lit(bins - 1))
    return df.join(ends, list(by)).withColumn("k", k).groupBy(*by, "k").agg(F.count("*").alias("total"), F.count_if("hit").alias("hits"))


def radial_slope(hist: DataFrame, bins: int) -> DataFrame:
    """l, t, slope: of the density over its mean against the bin's centre in [0, 1], empty bins counting as density 0."""
    sectors = hist.select("l", "t").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).withColumn("k", F.col("k").cast("bigint"))
    full = sectors.join(hist, ["l", "t", "k"], "left").withColumn("d", F.coalesce(F.col("hits") / F.col("total"), F.lit(0.0)))
    mean = full.groupBy("l", "t").agg(F.avg("d").alias("m"))
    full = full.join(mean, ["l", "t"]).filter("m > 0")
    return full.groupBy("l", "t").agg(F.regr_slope(F.col("d") / F.col("m"), (F.col("k") + 0.5) / bins).alias("slope"))


def label_budgets(df: DataFrame, label: str, budget: int, override: dict | None = None) -> DataFrame:
    """label, n, budget: shares of a budget in proportion to counts (half to even), unless overridden."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    share = F.bround(F.col("n") / F.sum("n").over(Window.partitionBy()) * budget).cast("bigint")
    for key, value in (override or {}).items():
        share = F.when(F.col(label) == key, F.lit(value)).otherwise(share)
    return counts.withColumn("budget", share)


def component_budgets(stats: DataFrame, budget: int) -> DataFrame:
    """Budgets in proportion to n_vox ** (2/3), at least 1."""
    w = F.pow("n_vox", F.lit(2 / 3))
    total = stats.agg(F.sum(w)).first()[0] or 1.0
    return stats.withColumn("budget", F.greatest(F.lit(1), F.bround(w / total * budget)).cast("bigint"))


def padded_box(low: Column, high: Column, pad: int, n: int) -> tuple[Column, Column]:
    """The box [low, high] widened by pad and cut to [0, n): first index and the one after the last."""
    return F.greatest(F.lit(0), low - pad), F.least(F.lit(n), high + 1 + pad)


def majority(a: Column, b: Column, c: Column) -> Column:
    """The label that two of three share; the least if all differ."""
    return F.when((a == b) | (a == c), a).when(b == c, b).otherwise(F.least(a, b, c))


def summary(df: DataFrame, value: str) -> DataFrame:
    """v_min, v_mean, p50, p90, p95, p99, v_max of a column, in one row."""
    c, shares = F.col(value), (0.5, 0.9, 0.95, 0.99)
    ps = [F.lit(q).cast("double").alias(f"p{round(s * 100)}") for s, q in zip(shares, quantiles(df, value, list(shares)), strict=True)]
    return df.agg(F.min(c).alias("v_min"), F.avg(c).alias("v_mean"), F.max(c).alias("v_max")).select("v_min", "v_mean", *ps, "v_max")


def median_deviation(df: DataFrame, value: str) -> DataFrame:
    """median, mad, mean and population standard deviation of a column, in one row."""
    (m,), c = quantiles(df, value, [0.5]), F.col(value)
    (mad,) = quantiles(df.select(F.abs(c - F.lit(m).cast("double")).alias("_d")), "_d", [0.5])
    return df.agg(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).select(F.lit(m).cast("double").alias("median"), F.lit(mad).cast("double").alias("mad"), "mean", "std")


def nearest_centre(points: DataFrame, centres: list[tuple], axes: list[str]) -> DataFrame:
    """Adds centre (the number of the nearest one, the least on ties) and d2; the centres are parameters, k of them."""
    d2 = [sum(((F.col(a) - float(v)) * (F.col(a) - float(v)) for a, v in zip(axes, c, strict=True)), F.lit(0.0)) for c in centres]
    best = F.array_min(F.array(*(F.struct(d.alias("d2"), F.lit(i).cast("bigint").alias("centre")) for i, d in enumerate(d2))))
    return points.withColumn("_b", best).withColumn("centre", F.col("_b.centre")).withColumn("d2", F.col("_b.d2")).drop("_b")


def farthest_seeds(points: DataFrame, k: int, axes: list[str], first: tuple) -> list[tuple]:
    """k seeds: each the point farthest from those before (least coordinates on ties); one pass a seed."""
    seeds = [tuple(map(float, first))]
    while len(seeds) < k:
        far = nearest_centre(points, seeds, axes).orderBy(F.desc("d2"), *axes).limit(1).collect()
        if not far or far[0]["d2"] == 0:
            break
        seeds.append(tuple(float(far[0][a]) for a in axes))
    return seeds


def medoids(points: DataFrame, k: int, axes: list[str], first: tuple, rounds: int = 50, drift: float = 1e-6) -> list[tuple]:
    """K-medoids: seeds by distance, then means snapped to the nearest point, until the centres' ways sum to less than `drift`.

    A centre without points begins anew at one of the points farthest from all centres."""
    centres = farthest_seeds(points, k, axes, first)
    for _ in range(rounds):
        near = nearest_centre(points, centres, axes)
        means = {r.centre: tuple(r[a] for a in axes) for r in near.groupBy("centre").agg(*(F.avg(a).alias(a) for a in axes)).collect()}
        if not means:
            break
        lone = [i for i in range(len(centres)) if i not in means]
        far = [tuple(float(r[a]) for a in axes) for r in near.orderBy(F.desc("d2"), *axes).limit(len(lone)).collect()] if lone else []
        moved = [means[i] if i in means else far[lone.index(i)] for i in range(len(centres))]
        d = [sum(((F.col(a) - m) * (F.col(a) - m) for a, m in zip(axes, c, strict=True)), F.lit(0.0)) for c in moved]
        row = points.agg(*(F.min(F.struct(x.alias("d"), *axes)).alias(f"c{i}") for i, x in enumerate(d))).first()
        snapped = [tuple(float(row[f"c{i}"][a]) for a in axes) for i in range(len(moved))]
        way = sum(math.dist(a, b) for a, b in zip(snapped, centres, strict=True))
        centres = snapped
        if way < drift:
            break
    return centres


def particle_stats(df: DataFrame, template: str, frame: str, axes: list[str], alive: str, frozen: float = 0.01) -> DataFrame:
    """One row on the steps of particles that are alive before and after: n_alive of n_steps, mean, p5, p50, p95 and greatest
    length, mean and greatest way of a template, and the share of steps shorter than `frozen` in percent."""
    w = Window.partitionBy(template).orderBy(frame)
    way = F.sqrt(sum(((F.col(a) - F.lag(a).over(w)) * (F.col(a) - F.lag(a).over(w)) for a in axes), F.lit(0.0)))
    steps = df.withColumn("_d", way).withColumn("_both", F.col(alive) & F.lag(alive).over(w)).filter("_d is not null").select(template, F.when(F.col("_both"), F.col("_d")).alias("step"))
    p5, p50, p95 = quantiles(steps, "step", [0.05, 0.5, 0.95])
    per = steps.groupBy(template).agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("way"), F.count("*").alias("n"), F.count("step").alias("k"), F.max("step").alias("most"), F.count_if(F.col("step") < frozen).alias("still"))
    out = per.agg(F.sum("k").alias("n_alive"), F.sum("n").alias("n_steps"), (F.sum("way") / F.sum("k")).alias("mean"), F.max("most").alias("v_max"), F.avg("way").alias("path_mean"), F.max("way").alias("path_max"), (100 * F.sum("still") / F.sum("k")).alias("frozen_pct"))
    return out.select("n_alive", "n_steps", "mean", *(F.lit(q).cast("double").alias(k) for k, q in (("p5", p5), ("p50", p50), ("p95", p95))), "v_max", "path_mean", "path_max", "frozen_pct")
