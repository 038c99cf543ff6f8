"""Leaderboards, offline queues and time-binned profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: How the known games are ranked; a game that is not listed ranks by time_asc.
SCORE_TYPES = {
    "le_messager": "time_asc",
    "cross_the_beast": "time_asc",
    "catch_flux": "points_desc",
    "safari_photo": "points_desc",
    "circuit": "time_asc",
    "the_savior": "time_asc",
    "root_dive": "time_asc",
    "membrane_surfer": "points_desc",
    "aero_census": "points_desc",
    "infection": "time_asc",
}


def directed(score: Column, kind: Column) -> Column:
    """A score to sort by in ascending order."""
    return F.when(kind == "points_desc", -score).otherwise(score)


def registry(spark: SparkSession) -> DataFrame:
    """game_id, score_type of the known games."""
    return spark.createDataFrame(list(SCORE_TYPES.items()), "game_id string, score_type string")


def leaderboard(scores: DataFrame, games: DataFrame, k: int = 10) -> DataFrame:
    """The k best rows of each game, rank from 1; ties in the order of insertion (column idx).

    games: game_id, score_type; missing games rank by time_asc."""
    rows = scores.join(games, "game_id", "left").withColumn("score_type", F.coalesce("score_type", F.lit("time_asc")))
    w = Window.partitionBy("game_id").orderBy(directed(F.col("score"), F.col("score_type")), "idx")
    return rows.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)


def best_of_players(scores: DataFrame, exact: bool = True) -> DataFrame:
    """The best score of each player (name trimmed, lower case) of each game: the greatest; with exact=False by score_type."""
    player = F.lower(F.trim("player_name")).alias("player")
    best = F.max("score") if exact else F.when(F.first("score_type") == "points_desc", F.max("score")).otherwise(F.min("score"))
    return scores.groupBy("game_id", player).agg(best.alias("best"))


def merged(stored: DataFrame, pending: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows and those pending rows whose key is not stored yet: replaying a queue twice adds nothing."""
    return stored.unionByName(pending.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti"))


def report(board: DataFrame) -> DataFrame:
    """rank, line: rank, padded name and score with one decimal and its unit."""
    unit = F.when(F.col("score_type") == "points_desc", " pts").otherwise(" s")
    line = F.concat(F.lpad(F.col("rank").cast("string"), 2, " "), F.lit(". "), F.rpad("player_name", 24, " "), F.lit(" "), F.format_string("%.1f", "score"), unit)
    return board.select("game_id", "rank", line.alias("line"))


def valid_name(name: Column, most: int = 24) -> Column:
    return F.left(F.regexp_replace(name, r"[^A-Za-z0-9 _.\-]", ""), F.lit(most))


def packet_bins(packets: DataFrame, width: float) -> DataFrame:
    """bin, start_s, end_s, bytes, kbps: sums of size (ts in seconds) in bins of `width`, none left out; the last bin may be shorter.

    Negative times count as 0."""
    p = packets.withColumn("t", F.greatest("ts", F.lit(0.0))).withColumn("bin", F.floor(F.col("t") / width).cast("bigint"))
    sums = p.groupBy("bin").agg(F.sum("size").alias("bytes"), F.max("t").alias("last"))
    end = sums.agg(F.max("last").alias("end"), F.max("bin").alias("n")).first()
    if end.n is None:
        return sums.select("bin", F.lit(0.0).alias("start_s"), F.lit(0.0).alias("end_s"), "bytes", F.lit(0.0).alias("kbps"))
    spine = packets.sparkSession.range(end.n + 1).select(F.col("id").alias("bin"))
    stop = F.least((F.col("bin") + 1) * F.lit(width), F.greatest(F.lit(float(end.end)), F.col("bin") * F.lit(width) + 1e-9))
    out = spine.join(sums.drop("last"), "bin", "left").fillna(0, ["bytes"]).withColumn("start_s", F.col("bin") * F.lit(width)).withColumn("end_s", stop)
    return out.withColumn("kbps", F.col("bytes") * 8 / 1000 / (F.col("end_s") - F.col("start_s"))).select("bin", "start_s", "end_s", "bytes", "kbps")


def peaks(bins: DataFrame, n: int) -> DataFrame:
    return bins.orderBy(F.desc("kbps"), "bin").limit(n)
