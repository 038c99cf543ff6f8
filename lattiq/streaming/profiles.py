"""Structured Streaming: packet bins, score submissions, sessions of the catch game, coalesced ticks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

AXES = ("z", "y", "x")


def event_time(df: DataFrame, column: str = "ts") -> DataFrame:
    """A watermark needs a time with a zone; parquet's zoneless times become UTC."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def packet_bins(packets: DataFrame, width: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """start, bytes, n of tumbling windows (ts timestamp, size)."""
    w = event_time(packets).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"))
    return w.agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), "bytes", "n")


def sliding_rate(events: DataFrame, length: str = "30 seconds", every: str = "5 seconds", late: str = "10 seconds") -> DataFrame:
    w = event_time(events).withWatermark("ts", late).groupBy(F.window("ts", length, every).alias("w"))
    return w.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def held_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    w = event_time(events).withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return w.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def coalesced(requests: DataFrame, interval: str = "16 milliseconds", late: str = "1 second") -> DataFrame:
    """At most one request an interval and subscriber."""
    w = event_time(requests).withColumn("_w", F.window("ts", interval).getField("start")).withWatermark("ts", late)
    return w.dropDuplicatesWithinWatermark(["subscriber", "_w"]).drop("_w")


def submissions(scores: DataFrame, late: str = "1 day") -> DataFrame:
    """Each submission once by its id, however often the offline queue replays it."""
    return event_time(scores).withWatermark("ts", late).dropDuplicatesWithinWatermark(["submission_id"])


def catch_game(positions: DataFrame, boxes: DataFrame, limit_s: float = 120.0, cell: int = 16) -> DataFrame:
    """session, t, column_id, score: when a session's camera (session, t, z, y, x) is first inside the box of a column
    (column_id, z0 ... x1), while less than limit_s seconds have passed since its first position.

    Positions meet boxes in the cells of a grid, by a join with the table of boxes, however many there are. State per session:
    the first time and the set of columns caught."""
    b, p = boxes, positions
    for a in AXES:
        b = b.withColumn(f"_{a}", F.explode(F.sequence(F.floor(F.col(f"{a}0") / cell), F.floor(F.col(f"{a}1") / cell))))
        p = p.withColumn(f"_{a}", F.floor(F.col(a) / cell))
    inside = reduce(lambda m, n: m & n, (F.col(a).between(F.col(f"{a}0"), F.col(f"{a}1")) for a in AXES))
    met = p.join(b, [f"_{a}" for a in AXES], "left").select("session", F.col("t").cast("double").alias("t"), F.when(inside, F.col("column_id")).alias("column_id"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, before = state.get if state.exists else (None, [])
        rows = pd.concat(list(batches))
        start = float(rows["t"].min()) if start is None else start
        hits = rows[(rows["t"] - start < limit_s) & rows["column_id"].notna() & ~rows["column_id"].isin(before)]
        new = hits.sort_values(["t", "column_id"]).drop_duplicates("column_id")
        state.update((start, sorted([*before, *new["column_id"].astype("int64").tolist()])))
        yield pd.DataFrame({"session": key[0], "t": new["t"], "column_id": new["column_id"].astype("int64"), "score": range(len(before) + 1, len(before) + len(new) + 1)})

    return met.groupBy("session").applyInPandasWithState(step, "session bigint, t double, column_id bigint, score bigint", "start double, caught array<bigint>", "append", GroupStateTimeout.NoTimeout)


def fired(rows: pd.DataFrame, last: float | None, credit: float, most: float = 1.0) -> tuple[pd.DataFrame, float | None, float]:
    """The ticks (t, period_s, enabled; in the order of t) at which a subscriber runs, and its last time and credit after them.

    The first tick after it is enabled runs. Later ones add the time since the last tick to its credit, and it runs when that
    reaches a period, which it costs; what is left is cut to one period. A gap of more than `most` seconds, or time running
    backwards, empties the credit."""
    runs = []
    for t, period, enabled in rows[["t", "period_s", "enabled"]].itertuples(index=False):
        gap = None if last is None else t - last
        run = bool(enabled) and gap is None
        if not enabled or gap is None or not 0 <= gap <= most:
            last, credit = (t if enabled else None), 0.0
        else:
            last, credit = t, credit + gap
            if run := credit + 1e-9 >= period:
                credit = min(credit - period, period)
        runs.append(run)
    return rows[runs], last, credit


def scheduled(ticks: DataFrame) -> DataFrame:
    """subscriber, t: when each subscriber runs, from a stream of ticks (subscriber, t in seconds, period_s, enabled)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, credit = state.get if state.exists else (None, 0.0)
        out, last, credit = fired(pd.concat(list(batches)).sort_values("t"), last, credit)
        state.update((last, credit))
        yield pd.DataFrame({"subscriber": key[0], "t": out["t"]})

    return ticks.groupBy("subscriber").applyInPandasWithState(step, "subscriber bigint, t double", "last double, credit double", "append", GroupStateTimeout.NoTimeout)
