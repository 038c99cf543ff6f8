"""Scenes and games: boxes of columns, what a camera catches, margins, scores, camera rows, score documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattiq.operators.tables import Workspace, quantiles

AXES = ("z", "y", "x")


def caught(camera: DataFrame, boxes: DataFrame, margin: float, cell: int = 16) -> DataFrame:
    """camera (t, z, y, x) joined with the boxes (z0, z1, ..., ends included) that hold it once widened by margin.

    Boxes are dealt to the cells of a grid that they touch, camera rows to the one they lie in, so only near ones meet."""
    b, c = boxes, camera
    for a in AXES:
        b = b.withColumn(f"_{a}", F.explode(F.sequence(F.floor((F.col(f"{a}0") - margin) / cell), F.floor((F.col(f"{a}1") + margin) / cell))))
        c = c.withColumn(f"_{a}", F.floor(F.col(a) / cell))
    inside = reduce(lambda p, q: p & q, (F.col(a).between(F.col(f"{a}0") - margin, F.col(f"{a}1") + margin) for a in AXES))
    return c.join(b, [f"_{a}" for a in AXES]).filter(inside).drop(*(f"_{a}" for a in AXES))


def catch_margin(points: DataFrame, share: float = 0.02, least: float = 2.0) -> DataFrame:
    """margin, in one row: the share of the diagonal of all points' box, `least` at least."""
    span = points.agg(*(f(a).alias(f"{a}{i}") for a in AXES for i, f in ((0, F.min), (1, F.max))))
    diagonal = F.sqrt(sum(((F.col(f"{a}1") - F.col(f"{a}0")) * (F.col(f"{a}1") - F.col(f"{a}0")) for a in AXES), F.lit(0.0)))
    return span.select(F.greatest(F.lit(float(least)), F.coalesce(diagonal, F.lit(0.0)) * share).alias("margin"))


def step_sets(cells: DataFrame) -> DataFrame:
    """column_id, steps: the steps in which each column occurs, in ascending order."""
    return cells.select("column_id", "step_id").distinct().groupBy("column_id").agg(F.array_sort(F.collect_list("step_id")).alias("steps"))


def vanished(cells: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cells left once the columns of `gone` (column_id) have vanished, and the steps (step_id, left) that this changes,
    with the cells each has left."""
    left = cells.join(gone.select("column_id"), "column_id", "left_anti")
    dirty = cells.join(gone.select("column_id"), "column_id", "left_semi").select("step_id").distinct()
    return left, dirty.join(left.groupBy("step_id").agg(F.count("*").alias("left")), "step_id", "left").fillna(0, ["left"])


def ticks(dirty: DataFrame, order: str, a_tick: int = 30) -> DataFrame:
    """Adds tick: when each changed step is rebuilt if a tick rebuilds `a_tick` of them, in ascending order."""
    return dirty.withColumn("tick", F.floor((F.row_number().over(Window.orderBy(order)) - 1) / a_tick))


def seen(events: DataFrame, visible: DataFrame) -> DataFrame:
    """events (t, columns: array) with what of columns is visible too (visible: t, columns)."""
    return events.join(visible.select("t", F.col("columns").alias("_v")), "t").select("t", F.array_sort(F.array_intersect("columns", "_v")).alias("columns"))


def score_rows(catches: DataFrame, columns: int, limit_s: float = 120.0) -> DataFrame:
    """game_id, player_name, score, won, seconds, metadata of finished games from their catches (session, t, column_id; t in
    seconds from the start): catches after limit_s do not count, and catching all columns ends a game."""
    first = catches.filter(F.col("t") < limit_s).groupBy("session", "column_id").agg(F.min("t").alias("t"))
    games = catches.select("session").distinct().join(first.groupBy("session").agg(F.count("*").alias("score"), F.max("t").alias("last")), "session", "left").fillna(0, ["score"])
    won = F.col("score") >= columns
    seconds = F.when(won, F.col("last")).otherwise(F.lit(float(limit_s)))
    metadata = F.to_json(F.struct(F.lit(columns).alias("columns"), won.alias("won")))
    return games.select(F.lit("catch_flux").alias("game_id"), F.concat(F.lit("session "), F.col("session").cast("string")).alias("player_name"), F.col("score").cast("double").alias("score"), won.alias("won"), seconds.alias("seconds"), metadata.alias("metadata"))


def photo_scores(events: DataFrame, kind: str) -> DataFrame:
    """user_id, score: how many events of a kind each user has."""
    return events.groupBy("user_id").agg(F.count_if(F.col("event_type") == kind).alias("score"))


def photo_scale(width: Column, most: int = 8192) -> Column:
    """The greatest of 1, 2, 4 and 8 by which a window may be enlarged without exceeding `most` pixels."""
    return F.when(width * 8 <= most, 8).when(width * 4 <= most, 4).when(width * 2 <= most, 2).otherwise(1)


def shifted(cameras: DataFrame, offset: tuple[float, float, float]) -> DataFrame:
    """Camera rows (position, focal: arrays) moved by an offset, their direction kept."""
    move = lambda c: F.zip_with(F.col(c), F.array(*(F.lit(float(o)) for o in offset)), lambda p, o: p + o)
    return cameras.withColumn("position", move("position")).withColumn("focal", move("focal"))


def offset_path(track: DataFrame, share: float = 0.02, down: float = 0.5) -> DataFrame:
    """frame, z, y, x, radius: the path of the camera (frame, pz, py, px, fz, fy, fx) as a tube: its radius is a share of the
    median distance to the focal point, and it lies `down` radii below the camera on the axis z."""
    far = F.sqrt(sum(((F.col(f"f{a}") - F.col(f"p{a}")) * (F.col(f"f{a}") - F.col(f"p{a}")) for a in AXES), F.lit(0.0)))
    radius = (quantiles(track.select(far.alias("_d")), "_d", [0.5])[0] or 0.0) * share
    return track.select("frame", (F.col("pz") - down * radius).alias("z"), F.col("py").alias("y"), F.col("px").alias("x"), F.lit(radius).alias("radius"))


def scattered(points: DataFrame, key: str, by: str, per_path: DataFrame) -> DataFrame:
    """points with place: where each stands if the paths (per_path: key, first) are laid one after another."""
    inside = F.row_number().over(Window.partitionBy(key).orderBy(by)) - 1
    return points.withColumn("_i", inside).join(per_path, key).withColumn("place", F.col("first") + F.col("_i")).drop("_i", "first")


def path_starts(points: DataFrame, key: str) -> DataFrame:
    """key, first: how many points stand before each path.

    Paths are dealt to ranges of the key, which are summed first (a row a range), then counted inside each: no task sees all paths."""
    n = points.groupBy(key).agg(F.count("*").alias("n"))
    ranged = Workspace(points.sparkSession, "starts").keep(n.repartitionByRange(key).withColumn("_range", F.spark_partition_id()))  # written, so ranges stay
    totals = ranged.groupBy("_range").agg(F.sum("n").alias("_t"))
    before = totals.select("_range", (F.sum("_t").over(Window.orderBy("_range")) - F.col("_t")).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(key)
    return ranged.withColumn("_in", F.sum("n").over(inside) - F.col("n")).join(F.broadcast(before), "_range").select(key, (F.col("_before") + F.col("_in")).alias("first"))


def average_rate(packets: DataFrame, low: float, high: float) -> DataFrame:
    """n_bytes, seconds, kbps, odd, in one row: the mean rate of packets (ts, dur, size in seconds and bytes) and whether it lies
    outside [low, high]; the duration is that of the last packet's end."""
    sums = packets.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n_bytes"), F.coalesce(F.max(F.col("ts") + F.col("dur")), F.lit(0.0)).alias("seconds"))
    return sums.withColumn("kbps", F.coalesce(F.try_divide(F.col("n_bytes") * 8 / 1000, F.col("seconds")), F.lit(0.0))).withColumn("odd", ~F.col("kbps").between(low, high))
