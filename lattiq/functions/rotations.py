"""Quaternions (arrays w, x, y, z) as column expressions, and tracks whose orientation is blended or locked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattiq.functions.shaping import cross, dot, norm, unit, upright


def _at(q: Column, i: int) -> Column:
    return F.get(q, F.lit(i))


def conjugate(q: Column) -> Column:
    return F.array(_at(q, 0), -_at(q, 1), -_at(q, 2), -_at(q, 3))


def multiplied(p: Column, q: Column) -> Column:
    """The rotation q followed by p."""
    a, b = [_at(p, i) for i in range(4)], [_at(q, i) for i in range(4)]
    return F.array(
        a[0] * b[0] - a[1] * b[1] - a[2] * b[2] - a[3] * b[3], a[0] * b[1] + a[1] * b[0] + a[2] * b[3] - a[3] * b[2],
        a[0] * b[2] - a[1] * b[3] + a[2] * b[0] + a[3] * b[1], a[0] * b[3] + a[1] * b[2] - a[2] * b[1] + a[3] * b[0],
    )


def about(axis: Column, angle: Column) -> Column:
    """The rotation by an angle about a unit axis."""
    s = F.sin(angle / 2)
    return F.array(F.cos(angle / 2), *(_at(axis, i) * s for i in range(3)))


def of_angles(degrees: list[Column]) -> Column:
    """The rotation about the fixed x, then y, then z axis."""
    (c0, s0), (c1, s1), (c2, s2) = ((F.cos(F.radians(d) / 2), F.sin(F.radians(d) / 2)) for d in degrees)
    return F.array(c0 * c1 * c2 + s0 * s1 * s2, s0 * c1 * c2 - c0 * s1 * s2, c0 * s1 * c2 + s0 * c1 * s2, c0 * c1 * s2 - s0 * s1 * c2)


def angles(q: Column) -> Column:
    """Degrees about the fixed x, then y, then z axis (an array)."""
    w, x, y, z = (_at(q, i) for i in range(4))
    return F.array(
        F.degrees(F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y))),
        F.degrees(F.asin(F.least(F.greatest(2 * (w * y - x * z), F.lit(-1.0)), F.lit(1.0)))),
        F.degrees(F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))),
    )


def turned(q: Column, v: Column) -> Column:
    """The vector v (array x, y, z) turned by the unit quaternion q."""
    u = F.slice(q, 2, 3)
    once = F.transform(cross(u, v), lambda x: 2 * x)
    return F.zip_with(F.zip_with(v, once, lambda a, b: a + _at(q, 0) * b), cross(u, once), lambda a, b: a + b)


def slerped(p: Column, q: Column, t: Column) -> Column:
    """Between two unit quaternions on the shorter arc, at even speed; straight and made unit where they nearly agree."""
    d = dot(p, q)
    q = F.when(d < 0, F.transform(q, lambda x: -x)).otherwise(q)
    d = F.least(F.abs(d), F.lit(1.0))
    a = F.acos(d)
    near = F.zip_with(p, q, lambda x, y: x + t * (y - x))
    arc = F.zip_with(p, q, lambda x, y: (F.sin((1 - t) * a) * x + F.sin(t * a) * y) / F.sin(a))
    return F.when(d > 0.9995, unit(near)).otherwise(arc)


def oriented(frames: DataFrame, keyframes: DataFrame) -> DataFrame:
    """frames (track, frame, keyframe: a place between keyframes, counted from 0) with q, blended between the keyframes around
    (track, i, q); beyond the last keyframe its own."""
    w = Window.partitionBy("track").orderBy("i")
    near = keyframes.select("track", (F.row_number().over(w) - 1).alias("_k"), F.col("q").alias("_p"), F.lead("q").over(w).alias("_q"), (F.count("*").over(Window.partitionBy("track")) - 1).alias("_last"))
    at = F.floor("keyframe").cast("int")
    both = frames.join(near.groupBy("track").agg(F.max("_last").alias("_last")), "track").withColumn("_k", F.least(at, F.col("_last")).cast("int")).drop("_last").join(near.drop("_last"), ["track", "_k"])
    q = F.when(F.col("_q").isNull(), F.col("_p")).otherwise(slerped(F.col("_p"), F.col("_q"), F.col("keyframe") - F.col("_k")))
    return both.select("track", "frame", "keyframe", q.alias("q"))


def locked(track: DataFrame, key: str, by: str) -> DataFrame:
    """The track (key, by, arrays place, focus, up) with the look, its length and the upright view-up of its first frame kept in all: only
    the place moves. A first frame without a look leaves its track as it is."""
    w = Window.partitionBy(key).orderBy(by)
    look = F.zip_with(F.first("focus").over(w), F.first("place").over(w), lambda f, p: f - p)
    rows = track.withColumn("_look", look).withColumn("_up0", F.first("up").over(w))
    ahead = unit(F.col("_look"))
    straight = F.zip_with(F.col("_up0"), ahead, lambda u, f: u - dot(F.col("_up0"), ahead) * f)
    up = F.when(norm(straight) < 1e-9, F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0))).otherwise(upright(F.col("_up0"), ahead))
    good = norm(F.col("_look")) >= 1e-9
    focus = F.zip_with(F.col("place"), F.col("_look"), lambda p, d: p + d)
    return rows.select(key, by, "place", F.when(good, focus).otherwise(F.col("focus")).alias("focus"), F.when(good, up).otherwise(F.col("up")).alias("up"))
