"""Four panels of a raster blended by azimuth, with the seam at 0 degrees treated like the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.functions.shaping import clip01


def blend_weights(spark: SparkSession, size: int, bounds: tuple[float, float, float], wide: float, narrow: float) -> DataFrame:
    """y, x, w4, w3, w2, w1: each pixel's share of the panels 4 (from 0 degrees), 3, 2 and 1, which follow each other
    at the bounds; the transition is `wide` degrees at the centre and `narrow` at the rim."""
    c = (size - 1) / 2
    px = spark.range(size * size).select((F.col("id") / size).cast("bigint").alias("y"), (F.col("id") % size).alias("x"))
    dy, dx = F.lit(c) - F.col("y"), F.col("x") - c
    raw = F.degrees(F.atan2(dy, dx))
    px = px.withColumn("a", F.when(raw < 0, raw + 360).otherwise(raw)).withColumn("t", wide - (wide - narrow) * clip01(F.sqrt(dy * dy + dx * dx) / c))
    px = px.withColumn("d", F.when(F.col("a") > 180, F.col("a") - 360).otherwise(F.col("a")))
    step = lambda b: clip01((F.col("a") - b + F.col("t") / 2) / F.col("t"))
    seam = F.abs("d") < F.col("t") / 2
    first, second, third = F.when(seam, 0.0).otherwise(step(bounds[0])), step(bounds[1]), F.when(seam, 1.0).otherwise(step(bounds[2]))
    wrap = clip01((F.col("d") + F.col("t") / 2) / F.col("t"))
    return px.select("y", "x", (wrap * (1 - first)).alias("w4"), (first * (1 - second)).alias("w3"), (second * (1 - third)).alias("w2"), (third * (1 - wrap)).alias("w1"))


def blended(panels: DataFrame, weights: DataFrame) -> DataFrame:
    """panels: panel, y, x, r, g, b. The weighted sum of the four, cut to 0 ... 255 and truncated (after a rounding to nine decimals, so that sums
    of shares that add up to a whole number stay one). A pixel that a panel lacks is black there."""
    w = weights.select("y", "x", F.explode(F.create_map(*(v for i in (1, 2, 3, 4) for v in (F.lit(i), F.col(f"w{i}"))))).alias("panel", "w"))
    out = panels.join(w, ["panel", "y", "x"]).groupBy("y", "x").agg(*(F.sum(F.col(k) * F.col("w")).alias(k) for k in "rgb"))
    return out.select("y", "x", *(F.floor(F.round(F.least(F.greatest(F.col(k), F.lit(0.0)), F.lit(255.0)), 9)).cast("int").alias(k) for k in "rgb"))
