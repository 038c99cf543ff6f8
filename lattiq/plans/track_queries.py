"""Queries on ordered tracks: events of a user, orders of a customer."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from lattiq.functions import shaping
from lattiq.operators import paths, profiles, ranking, timelines
from lattiq.plans.base import query, table

U, T = ["user_id"], ["ts", "event_id"]
_W = "(PARTITION BY user_id ORDER BY ts, event_id)"
_PTS = "pts AS (SELECT o_custkey AS path_id, o_orderkey AS i, (o_orderkey % 97)::DOUBLE AS pz, (o_orderkey * 3 % 89)::DOUBLE AS py, (o_orderkey * 7 % 83)::DOUBLE AS px FROM orders)"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def _points(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path_id"), k.alias("i"), (k % 97).cast("double").alias("pz"), (k * 3 % 89).cast("double").alias("py"), (k * 7 % 83).cast("double").alias("px"))


_ARC = f"""WITH {_PTS}, s AS (SELECT *, sqrt((pz - lag(pz) OVER w) ** 2 + (py - lag(py) OVER w) ** 2 + (px - lag(px) OVER w) ** 2) AS seg FROM pts WINDOW w AS (PARTITION BY path_id ORDER BY i)),
tort AS (SELECT path_id, sum(seg) AS arc, greatest(abs(arg_min(sqrt((py - 44) ** 2 + (px - 41) ** 2), i) - arg_max(sqrt((py - 44) ** 2 + (px - 41) ** 2), i)), 1.0) AS radial FROM s GROUP BY path_id HAVING count(*) > 1), tt AS (SELECT *, greatest(arc / radial, 1.0) AS tortuosity FROM tort)"""


def _tortuosity(spark, sf_dir):
    return paths.tortuosity(_points(spark, sf_dir), "path_id", "i", 44.0, 41.0)


@query(_ARC + " SELECT path_id, round(arc, 6) AS arc, round(radial, 6) AS radial, round(tortuosity, 6) AS tortuosity FROM tt")
def path_tortuosity(spark, sf_dir):
    return _tortuosity(spark, sf_dir).select("path_id", *(F.round(c, 6).alias(c) for c in ("arc", "radial", "tortuosity")))


@query(_ARC + ", m AS (SELECT quantile_cont(tortuosity, 0.5) AS med FROM tt) SELECT round(any_value(med), 6) AS median, round(quantile_cont(abs(tortuosity - med), 0.5), 6) AS mad, round(avg(tortuosity), 6) AS mean, round(stddev_pop(tortuosity), 6) AS std FROM tt, m")
def path_stats_mad(spark, sf_dir):
    return profiles.median_deviation(_tortuosity(spark, sf_dir), "tortuosity").select(*(F.round(c, 6).alias(c) for c in ("median", "mad", "mean", "std")))


_EDGES = (1.0, 1.05, 1.1, 1.2, 1.3, 1.5, 1.75, 2.0)
_CASE = "CASE " + " ".join(f"WHEN tortuosity < {b} THEN {i}" for i, b in enumerate(_EDGES[1:])) + " ELSE 7 END"


@query(_ARC + f" SELECT ({_CASE})::BIGINT AS bin, count(*) AS n FROM tt GROUP BY 1")
def path_histogram(spark, sf_dir):
    return _tortuosity(spark, sf_dir).groupBy(F.expr(_CASE).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


@query(f"WITH {_PTS} SELECT path_id, least(floor(avg(pz) / 97.0 * 8)::BIGINT, 7) AS bin FROM pts GROUP BY path_id")
def path_bins(spark, sf_dir):
    return paths.axis_bin(_points(spark, sf_dir), "path_id", "pz", 97.0, 8)


@query(f"WITH s AS (SELECT *, event_id % 3 AS a, (event_id + user_id) % 3 AS b FROM events) SELECT event_id, user_id, sum(CASE WHEN a <> p THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM (SELECT *, lag(b) OVER {_W} AS p FROM s)")
def infer_paths(spark, sf_dir):
    """A new path begins where a segment does not start at the end of the one before."""
    e = _events(spark, sf_dir).withColumn("a", F.col("event_id") % 3).withColumn("b", (F.col("event_id") + F.col("user_id")) % 3)
    e = e.withColumn("p", F.lag("b").over(timelines.ordered(U, T)))
    return timelines.islands(e, U, T, F.col("a") != F.col("p")).select("event_id", "user_id", "island")


@query(f"WITH {_PTS} SELECT path_id, i FROM pts WHERE path_id % 3 = 0")
def stride_paths(spark, sf_dir):
    return _points(spark, sf_dir).filter("path_id % 3 = 0").select("path_id", "i")


@query(f"SELECT event_id, round(value - lag(value) OVER {_W}, 6) AS dv FROM events")
def first_diff_speed(spark, sf_dir):
    return timelines.differenced(_events(spark, sf_dir), U, T, "value", "dv").select("event_id", F.round("dv", 6).alias("dv"))


@query(f"WITH {_PTS}, s AS (SELECT *, coalesce(sqrt((pz - lag(pz) OVER w) ** 2 + (py - lag(py) OVER w) ** 2 + (px - lag(px) OVER w) ** 2), 0) AS seg FROM pts WINDOW w AS (PARTITION BY path_id ORDER BY i)) SELECT path_id, i, round(sum(seg) OVER (PARTITION BY path_id ORDER BY i ROWS UNBOUNDED PRECEDING), 6) AS cum FROM s")
def arc_length_cum(spark, sf_dir):
    return timelines.chord_lengths(_points(spark, sf_dir), ["path_id"], ["i"], ["pz", "py", "px"]).select("path_id", "i", F.round("cum", 6).alias("cum"))


@query("""WITH f AS (SELECT user_id, event_id, value AS z, (event_id % 3)::DOUBLE AS y, event_id % 7 <> 0 AS alive FROM events), d AS (SELECT user_id, sqrt((z - lag(z) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS d, alive AND lag(alive) OVER w AS both_ FROM f WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
s AS (SELECT user_id, CASE WHEN both_ THEN d END AS s FROM d WHERE d IS NOT NULL), t AS (SELECT user_id, coalesce(sum(s), 0) AS way FROM s GROUP BY user_id)
SELECT count(s) AS n_alive, count(*) AS n_steps, round(avg(s), 6) AS mean, round(quantile_cont(s, 0.05), 6) AS p5, round(quantile_cont(s, 0.5), 6) AS p50, round(quantile_cont(s, 0.95), 6) AS p95, round(max(s), 6) AS v_max, (SELECT round(avg(way), 5) FROM t) AS path_mean, (SELECT round(max(way), 5) FROM t) AS path_max, round(100.0 * count(*) FILTER (s < 0.01) / count(s), 6) AS frozen_pct FROM s""")
def particle_stats(spark, sf_dir):
    k = F.col("event_id")
    f = _events(spark, sf_dir).select("user_id", "event_id", F.col("value").alias("z"), (k % 3).cast("double").alias("y"), (k % 7 != 0).alias("alive"))
    out = profiles.particle_stats(f, "user_id", "event_id", ["z", "y"], "alive")
    return out.select("n_alive", "n_steps", *(F.round(c, 5 if c.startswith("path") else 6).alias(c) for c in out.columns[2:]))


@query("""WITH v AS (SELECT o_custkey AS k, o_orderkey AS i, o_totalprice % 50 + 1 AS lim, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::DOUBLE AS rn FROM orders),
f AS (SELECT *, min(lim * lim - 40 * rn) OVER (PARTITION BY k ORDER BY rn ROWS UNBOUNDED PRECEDING) + 40 * rn AS f FROM v)
SELECT k AS path_id, i, round(sqrt(greatest(min(f + 40 * rn) OVER (PARTITION BY k ORDER BY rn DESC ROWS UNBOUNDED PRECEDING) - 40 * rn, 0)), 6) AS v FROM f""")
def velocity_profile(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path_id"), F.col("o_orderkey").alias("i"), (F.col("o_totalprice") % 50 + 1).alias("lim"))
    return timelines.velocity_profile(o, ["path_id"], "i", "lim", 40.0).select("path_id", "i", F.round("v", 6).alias("v"))


@query("""WITH v AS (SELECT o_custkey AS k, o_orderkey AS i, o_totalprice % 10 AS lo, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::DOUBLE AS rn FROM orders)
SELECT k AS path_id, i, round(max(lo - 0.5 * rn) OVER (PARTITION BY k ORDER BY rn ROWS UNBOUNDED PRECEDING) + 0.5 * rn, 6) AS lo FROM v""")
def shell_bounds_monotone(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path_id"), F.col("o_orderkey").alias("i"), (F.col("o_totalprice") % 10).alias("low"))
    return timelines.monotone_bounds(o, ["path_id"], "i", "low", 0.5).select("path_id", "i", F.round("lo", 6).alias("lo"))


@query("SELECT event_id, last_value(CASE WHEN event_id % 3 = 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS held FROM events")
def carry_forward(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("sparse", F.when(F.col("event_id") % 3 == 0, F.col("event_type")))
    return timelines.carried(e, U, T, "sparse", "held").select("event_id", "held")


@query(f"SELECT event_id, previous, event_type FROM (SELECT *, lag(event_type) OVER {_W} AS previous FROM events) WHERE previous <> event_type")
def mode_switches(spark, sf_dir):
    return timelines.switches(_events(spark, sf_dir), U, T, "event_type").select("event_id", "previous", "event_type")


_SS = "CASE WHEN x <= 0 THEN 0.0 WHEN x >= 1 THEN 1.0 ELSE x * x * x * (x * (x * 6 - 15) + 10) END"


@query(f"""WITH tick AS (SELECT user_id, event_id % 500 AS frame FROM events GROUP BY ALL), ev AS (SELECT DISTINCT user_id, event_id % 500 AS "at" FROM events WHERE event_type = 'click'),
l AS (SELECT t.user_id, t.frame, max(e."at") AS "at" FROM tick t LEFT JOIN ev e ON e.user_id = t.user_id AND abs(t.frame - e."at") <= 20 GROUP BY ALL), q AS (SELECT *, (frame - "at" + 20) / 40.0 AS x FROM l)
SELECT user_id, frame, "at", CASE WHEN "at" IS NOT NULL THEN round({_SS}, 6) END::DOUBLE AS ramp FROM q""")
def crossfade(spark, sf_dir):
    e = _events(spark, sf_dir)
    ticks = e.select("user_id", (F.col("event_id") % 500).alias("frame")).distinct()
    marks = e.filter("event_type = 'click'").select("user_id", (F.col("event_id") % 500).alias("at")).distinct()
    return timelines.crossfade(marks, ticks, U, 20).select("user_id", "frame", "at", F.round("ramp", 6).alias("ramp"))


@query("""WITH tr AS (SELECT user_id % 4 AS track, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS frame, CASE WHEN event_type = 'view' THEN 'mesh_all' ELSE event_type END AS mode, event_id % 60 < 25 AS lames, (event_id % 5) * 0.3::DOUBLE AS turn FROM events),
r AS (SELECT *, count(*) OVER (PARTITION BY track) AS n, lames AND NOT coalesce(lag(lames) OVER (PARTITION BY track ORDER BY frame), false) AS up, frame / 2.0 >= 35 AS late FROM tr),
calm AS (SELECT a.track, a.frame FROM r a JOIN r b ON b.track = a.track AND b.frame BETWEEN a.frame AND a.frame + 1 GROUP BY a.track, a.frame, a.n HAVING max(b.turn) < 1 AND count(*) = 2),
wait AS (SELECT r.track, r.frame, r.n, r.mode, min(c.frame) AS s FROM r LEFT JOIN calm c ON c.track = r.track AND c.frame >= r.frame AND c.frame + 1 < r.frame + 16 WHERE up AND late GROUP BY ALL)
SELECT track, 'mode' AS kind, mode, min(frame) AS start, least(min(frame) + 12, any_value(n)) AS stop FROM r WHERE late AND mode <> 'mesh_all' GROUP BY track, mode
UNION ALL SELECT track, 'lames', mode, coalesce(s, frame), least(coalesce(s, frame) + 6, n) FROM wait
UNION ALL SELECT track, 'fixed', 'mesh_all', min(frame), max(frame) + 1 FROM r WHERE frame / 2.0 >= 64 AND frame / 2.0 < 69 GROUP BY track""")
def visibility_schedule(spark, sf_dir):
    """When panels show along four tracks at two frames a second."""
    k = F.col("event_id")
    w = Window.partitionBy("track").orderBy("event_id")
    e = _events(spark, sf_dir).withColumn("track", F.col("user_id") % 4)
    rows = e.select("track", (F.row_number().over(w) - 1).cast("bigint").alias("frame"), F.when(F.col("event_type") == "view", "mesh_all").otherwise(F.col("event_type")).alias("mode"), (k % 60 < 25).alias("lames"), (k % 5 * 0.3).alias("turn"))
    return timelines.visibility(rows, ["track"], 2, calm_s=1.0)


@query("""WITH a AS (SELECT event_id, user_id, ts FROM events WHERE event_id % 2 = 0), b AS (SELECT user_id, ts, max(value) AS v FROM events WHERE event_id % 2 = 1 GROUP BY ALL)
SELECT a.event_id, b.v FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.ts >= b.ts""")
def asof_segment_sample(spark, sf_dir):
    e = _events(spark, sf_dir)
    left = e.filter("event_id % 2 = 0").select("event_id", "user_id", "ts")
    right = e.filter("event_id % 2 = 1").groupBy("user_id", "ts").agg(F.max("value").alias("v"))
    return timelines.as_of(left, right, U, "ts", ["v"]).select("event_id", "v")


@query("SELECT user_id, event_id, value, lead(event_id) OVER w AS next_event_id, lead(value) OVER w AS next_value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def keyframe_brackets(spark, sf_dir):
    return timelines.bracketed(_events(spark, sf_dir), U, "event_id", ["value"])


@query(f"""WITH {_PTS}, s AS (SELECT *, coalesce(sqrt((pz - lag(pz) OVER w) ** 2 + (py - lag(py) OVER w) ** 2), 0) AS seg FROM pts WINDOW w AS (PARTITION BY path_id ORDER BY i)),
c AS (SELECT *, sum(seg) OVER (PARTITION BY path_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS c0, sum(seg) OVER (PARTITION BY path_id) AS total FROM s),
g AS (SELECT path_id, c0, total, lead(c0) OVER w AS c1, pz AS pz0, lead(pz) OVER w AS pz1, py AS py0, lead(py) OVER w AS py1 FROM c WINDOW w AS (PARTITION BY path_id ORDER BY i)),
k AS (SELECT g.*, r.range AS i, (r.range + 0.5) / 6 * total AS pos FROM g, range(6) r WHERE c1 > c0)
SELECT path_id, i, round(pz0 + (pos - c0) / (c1 - c0) * (pz1 - pz0), 4) AS pz, round(py0 + (pos - c0) / (c1 - c0) * (py1 - py0), 4) AS py FROM k WHERE pos >= c0 AND pos < c1""")
def arclength_resample(spark, sf_dir):
    out = timelines.resampled(_points(spark, sf_dir), ["path_id"], ["i"], ["pz", "py"], 6)
    return out.select("path_id", F.col("i").cast("bigint").alias("i"), F.round("pz", 4).alias("pz"), F.round("py", 4).alias("py"))


@query("SELECT event_id, (event_id + user_id) % 40 AS at, round(1 - abs(2 * ((event_id + user_id) % 40) / 40.0 - 1), 6)::DOUBLE AS alpha FROM events")
def modular_lookup(spark, sf_dir):
    return timelines.modular(_events(spark, sf_dir), F.col("event_id"), F.col("user_id"), 40).select("event_id", "at", F.round("alpha", 6).alias("alpha"))


@query("""WITH e AS (SELECT event_id, value, event_id % 90 AS s FROM events) SELECT event_id, round(greatest(least(greatest(1 - s / 12.0, 0), 1), least(greatest(1 - (80 - s) / 12.0, 0), 1)), 6)::DOUBLE AS glow,
round(CASE WHEN s < 30 THEN least(greatest(1 - s / 12.0, 0), 1) WHEN s < 60 THEN 0 ELSE least(greatest(1 - (29 - (s - 60)) / 12.0, 0), 1) END, 6)::DOUBLE AS glow3, round(CASE WHEN s <= 10 THEN 0.2 WHEN s <= 50 THEN 0.2 + (s - 10) / 40.0 * 0.6 WHEN s <= 80 THEN 0.8 - (s - 50) / 30.0 * 0.5 ELSE 0.3 END, 6)::DOUBLE AS ramp,
CASE WHEN greatest(25 * pow(s + 1, 2.0 / 3), 2.0 * (s + 1)) <= 6 THEN 1 ELSE greatest(1, least(6, round_even(sqrt(greatest(25 * pow(s + 1, 2.0 / 3), 2.0 * (s + 1)) / 6), 0))) END::BIGINT AS stride FROM e""")
def shaping_curves(spark, sf_dir):
    s = F.col("event_id") % 90
    e = _events(spark, sf_dir)
    return e.select("event_id", F.round(shaping.glow(s, 80, 12), 6).alias("glow"), F.round(shaping.glow_phases(s, 30, 30, 30, 12), 6).alias("glow3"), F.round(shaping.ramp(s, [(10, 0.2), (50, 0.8), (80, 0.3)]), 6).alias("ramp"), shaping.auto_stride(s + 1, 2).alias("stride"))


@query("""WITH v AS (SELECT event_id, [(event_id % 7 - 3)::DOUBLE, (event_id % 5 - 2)::DOUBLE, (event_id % 3 + 1)::DOUBLE] AS a, [1.0::DOUBLE, (event_id % 4)::DOUBLE, 2.0::DOUBLE] AS b FROM events)
SELECT event_id, round(a[1] * b[1] + a[2] * b[2] + a[3] * b[3], 6) AS dot, round(sqrt(a[1] ** 2 + a[2] ** 2 + a[3] ** 2), 6) AS norm, round(a[2] * b[3] - a[3] * b[2], 6) AS cx, round(a[3] * b[1] - a[1] * b[3], 6) AS cy, round(a[1] * b[2] - a[2] * b[1], 6) AS cz,
round(a[1] * cos(0.5) - a[2] * sin(0.5), 6) AS rx, round(a[1] * sin(0.5) + a[2] * cos(0.5), 6) AS ry FROM v""")
def vector_algebra(spark, sf_dir):
    k = F.col("event_id")
    v = _events(spark, sf_dir).select("event_id", F.array(*((x).cast("double") for x in (k % 7 - 3, k % 5 - 2, k % 3 + 1))).alias("a"), F.array(F.lit(1.0), (k % 4).cast("double"), F.lit(2.0)).alias("b"))
    c = shaping.cross(F.col("a"), F.col("b"))
    r = shaping.rotated(F.col("a"), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)), F.lit(0.5))
    return v.select("event_id", F.round(shaping.dot(F.col("a"), F.col("b")), 6).alias("dot"), F.round(shaping.norm(F.col("a")), 6).alias("norm"), *(F.round(F.get(c, F.lit(i)), 6).alias(n) for i, n in enumerate(("cx", "cy", "cz"))), *(F.round(F.get(r, F.lit(i)), 6).alias(n) for i, n in enumerate(("rx", "ry"))))


@query(f"""WITH {_PTS}, d AS (SELECT path_id, i, px - lag(px) OVER w AS ax, py - lag(py) OVER w AS ay, lead(px) OVER w - px AS bx, lead(py) OVER w - py AS by_ FROM pts WINDOW w AS (PARTITION BY path_id ORDER BY i))
SELECT path_id, i, round(CASE WHEN sqrt(ax * ax + ay * ay) < 1e-9 OR sqrt(bx * bx + by_ * by_) < 1e-9 THEN 0 ELSE degrees(acos(least(greatest((ax * bx + ay * by_) / (sqrt(ax * ax + ay * ay) * sqrt(bx * bx + by_ * by_)), -1), 1))) END, 4)::DOUBLE AS turn FROM d""")
def turn_angle(spark, sf_dir):
    return paths.turn_angles(_points(spark, sf_dir), "path_id", "i").select("path_id", "i", F.round("turn", 4).alias("turn"))


@query(f"""WITH {_PTS}, q AS (SELECT path_id, i, lag(px) OVER w AS p0, px AS p1, lead(px) OVER w AS p2, lead(px, 2) OVER w AS p3 FROM pts WINDOW w AS (PARTITION BY path_id ORDER BY i))
SELECT path_id, i, k.range AS k, round(0.5 * (2 * p1 + (p2 - p0) * (k.range / 5.0) + (2 * p0 - 5 * p1 + 4 * p2 - p3) * (k.range / 5.0) * (k.range / 5.0) + (3 * p1 - p0 - 3 * p2 + p3) * (k.range / 5.0) * (k.range / 5.0) * (k.range / 5.0)), 6) AS px FROM q, range(1, 5) k WHERE p0 IS NOT NULL AND p3 IS NOT NULL""")
def catmull_rom(spark, sf_dir):
    w = timelines.ordered(["path_id"], ["i"])
    q = _points(spark, sf_dir).select("path_id", "i", F.lag("px").over(w).alias("p0"), F.col("px").alias("p1"), F.lead("px").over(w).alias("p2"), F.lead("px", 2).over(w).alias("p3")).filter("p0 is not null and p3 is not null")
    q = q.withColumn("k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(4).cast("bigint"))))
    return q.select("path_id", "i", "k", F.round(paths.catmull_rom(*(F.col(f"p{j}") for j in range(4)), F.col("k") / 5.0), 6).alias("px"))


_TURN = lambda a, b, c: f"""CASE WHEN sqrt(({b}x - {a}x) ** 2 + ({b}y - {a}y) ** 2) < 1e-9 OR sqrt(({c}x - {b}x) ** 2 + ({c}y - {b}y) ** 2) < 1e-9 THEN 0 ELSE degrees(acos(least(greatest((({b}x - {a}x) * ({c}x - {b}x) + ({b}y - {a}y) * ({c}y - {b}y)) / (sqrt(({b}x - {a}x) ** 2 + ({b}y - {a}y) ** 2) * sqrt(({c}x - {b}x) ** 2 + ({c}y - {b}y) ** 2)), -1), 1))) END"""
_SPLINE = lambda c: f"0.5 * (2 * q2{c} + (q3{c} - q1{c}) * t + (2 * q1{c} - 5 * q2{c} + 4 * q3{c} - q4{c}) * t * t + (3 * q2{c} - q1{c} - 3 * q3{c} + q4{c}) * t * t * t)"


@query(f"""WITH {_PTS}, r AS (SELECT path_id, row_number() OVER (PARTITION BY path_id ORDER BY i) - 1 AS i, count(*) OVER (PARTITION BY path_id) AS n, px, py FROM pts),
q AS (SELECT r.path_id, r.i, {", ".join(f"q{d + 2}.px AS q{d + 2}x, q{d + 2}.py AS q{d + 2}y" for d in (-2, -1, 0, 1, 2))} FROM r {" ".join(f"JOIN r q{d + 2} ON q{d + 2}.path_id = r.path_id AND q{d + 2}.i = (r.i + {d} + 2 * r.n) % r.n" for d in (-2, -1, 0, 1, 2))}),
s AS (SELECT q.*, k.range AS k, k.range / 5.0::DOUBLE AS t FROM q, range(5) k WHERE k.range = 0 OR ({_TURN("q1", "q2", "q3")} <= 40 AND {_TURN("q2", "q3", "q4")} <= 40))
SELECT path_id, i, k, round(CASE WHEN k = 0 THEN q2x ELSE {_SPLINE("x")} END, 6) AS px, round(CASE WHEN k = 0 THEN q2y ELSE {_SPLINE("y")} END, 6) AS py FROM s""")
def polygon_smoothing(spark, sf_dir):
    out = paths.smoothed_polygon(_points(spark, sf_dir).select("path_id", "i", "px", "py"), "path_id", "i")
    return out.select("path_id", F.col("i").cast("bigint").alias("i"), F.col("k").cast("bigint").alias("k"), F.round("px", 6).alias("px"), F.round("py", 6).alias("py"))


@query(f"""WITH RECURSIVE {_PTS}, r AS (SELECT path_id, i, row_number() OVER (PARTITION BY path_id ORDER BY i) AS rn, pz, py, px FROM pts),
seg(path_id, a, b) AS (SELECT path_id, min(rn), max(rn) FROM r GROUP BY path_id UNION ALL SELECT path_id, unnest([a, k]), unnest([k, b]) FROM (
SELECT path_id, a, b, rn AS k, d FROM (SELECT s.path_id, s.a, s.b, m.rn, sqrt((m.pz - p.pz - f * (q.pz - p.pz)) ** 2 + (m.py - p.py - f * (q.py - p.py)) ** 2 + (m.px - p.px - f * (q.px - p.px)) ** 2) AS d FROM seg s JOIN r p ON p.path_id = s.path_id AND p.rn = s.a JOIN r q ON q.path_id = s.path_id AND q.rn = s.b JOIN r m ON m.path_id = s.path_id AND m.rn > s.a AND m.rn < s.b,
LATERAL (SELECT CASE WHEN (q.pz - p.pz) ** 2 + (q.py - p.py) ** 2 + (q.px - p.px) ** 2 > 0 THEN least(greatest(((m.pz - p.pz) * (q.pz - p.pz) + (m.py - p.py) * (q.py - p.py) + (m.px - p.px) * (q.px - p.px)) / ((q.pz - p.pz) ** 2 + (q.py - p.py) ** 2 + (q.px - p.px) ** 2), 0), 1) ELSE 0 END AS f) t)
QUALIFY row_number() OVER (PARTITION BY path_id, a, b ORDER BY round(d, 9) DESC, rn) = 1) WHERE d > 20.0), k AS (SELECT DISTINCT path_id, unnest([a, b]) AS rn FROM seg)
SELECT path_id, i, pz, py, px FROM k JOIN r USING (path_id, rn)""")
def douglas_peucker(spark, sf_dir):
    return paths.simplified(_points(spark, sf_dir), "path_id", "i", ["pz", "py", "px"], 20.0)


_KB = lambda c: f"(2 * t * t * t - 3 * t * t + 1) * {c} + (t * t * t - 2 * t * t + t) * 0.35 * ({c}1 - {c}0) + (3 * t * t - 2 * t * t * t) * {c}1 + (t * t * t - t * t) * 0.35 * ({c}2 - {c})"


@query(f"""WITH {_PTS}, r AS (SELECT path_id, row_number() OVER w - 1 AS rn, count(*) OVER (PARTITION BY path_id) AS n, {", ".join(f"{c}, coalesce(lag({c}) OVER w, {c}) AS {c}0, lead({c}) OVER w AS {c}1, coalesce(lead({c}, 2) OVER w, lead({c}) OVER w) AS {c}2" for c in ("pz", "py", "px"))} FROM pts WINDOW w AS (PARTITION BY path_id ORDER BY i)),
s AS (SELECT r.*, k.range AS k, k.range / 8.0::DOUBLE AS t FROM r, range(8) k WHERE pz1 IS NOT NULL)
SELECT path_id, rn * 8 + k AS i, {", ".join(f"round({_KB(c)}, 11) AS {c}" for c in ("pz", "py", "px"))} FROM s UNION ALL SELECT path_id, rn * 8, pz, py, px FROM r WHERE rn = n - 1""")
def kochanek_splines(spark, sf_dir):
    out = paths.splined(_points(spark, sf_dir), "path_id", "i", ["pz", "py", "px"], 8)
    return out.select("path_id", "i", *(F.round(c, 11).alias(c) for c in ("pz", "py", "px")))  # eighths cubed times 0.35 end after eleven decimals


@query(f"""WITH RECURSIVE {_PTS}, d AS (SELECT path_id, i, row_number() OVER (PARTITION BY path_id ORDER BY i) AS rn, {", ".join(f"last_value({c}) OVER w - first_value({c}) OVER w AS v{c}" for c in ("pz", "py", "px"))} FROM pts WINDOW w AS (PARTITION BY path_id ORDER BY i ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING)),
e AS (SELECT *, sqrt(vpz * vpz + vpy * vpy + vpx * vpx) AS s FROM d), m AS (SELECT path_id, quantile_cont(s, 0.5) * 0.005 AS least_s FROM e WHERE s > 0 GROUP BY path_id),
u AS (SELECT e.path_id, i, rn, CASE WHEN s > 0 THEN vpz / s ELSE 0 END AS uz, CASE WHEN s > 0 THEN vpy / s ELSE 0 END AS uy, CASE WHEN s > 0 THEN vpx / s ELSE 0 END AS ux, s > coalesce(least_s, 0.005) AS fast FROM e LEFT JOIN m USING (path_id)),
v AS (SELECT *, fast AND sqrt(ux * ux + uz * uz) > 0.05 AS counts FROM u),
h(path_id, rn, z, y, x) AS (SELECT path_id, rn, CASE WHEN counts THEN uz ELSE 1 END, CASE WHEN counts THEN uy ELSE 0 END, CASE WHEN counts THEN ux ELSE 0 END FROM v WHERE rn = 1
UNION ALL SELECT path_id, rn, CASE WHEN NOT counts OR g <= 1e-9 THEN oz ELSE mz / g END, CASE WHEN NOT counts OR g <= 1e-9 THEN oy ELSE my / g END, CASE WHEN NOT counts OR g <= 1e-9 THEN ox ELSE mx / g END FROM (SELECT *, sqrt(mz * mz + my * my + mx * mx) AS g FROM (SELECT v.path_id, v.rn, counts, h.z AS oz, h.y AS oy, h.x AS ox, 0.88 * h.z + 0.12 * uz AS mz, 0.88 * h.y + 0.12 * uy AS my, 0.88 * h.x + 0.12 * ux AS mx FROM h JOIN v ON v.path_id = h.path_id AND v.rn = h.rn + 1)))
SELECT v.path_id, v.i, round(z, 6) + 0.0 AS dz, round(y, 6) + 0.0 AS dy, round(x, 6) + 0.0 AS dx FROM h JOIN v USING (path_id, rn)""")
def travel_directions(spark, sf_dir):
    out = paths.travel_directions(_points(spark, sf_dir), "path_id", "i", ["pz", "py", "px"])
    return out.select("path_id", "i", *((F.round(f"dp{a}", 6) + 0.0).alias(f"d{a}") for a in ("z", "y", "x")))


_ONE = [math.exp(-0.5 * k * k) for k in range(-2, 3)]
_TWICE = [sum(_ONE[i] * _ONE[k - i] for i in range(5) if 0 <= k - i < 5) / sum(_ONE) ** 2 for k in range(9)]
_GSUM = " + ".join(f"{g!r} * " + (f"coalesce(lag(px, {-k}) OVER w, first_value(px) OVER f)" if k < 0 else f"coalesce(lead(px, {k}) OVER w, last_value(px) OVER f)" if k else "px") for k, g in zip(range(-4, 5), _TWICE, strict=True))


@query(f"WITH {_PTS} SELECT path_id, i, round({_GSUM}, 5) AS smooth FROM pts WINDOW w AS (PARTITION BY path_id ORDER BY i), f AS (PARTITION BY path_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def gaussian_positions(spark, sf_dir):
    return timelines.gaussian_smoothed(_points(spark, sf_dir), ["path_id"], "i", "px", 1, "smooth").select("path_id", "i", F.round("smooth", 5).alias("smooth"))


_SC = "sc AS (SELECT event_id AS idx, event_type AS game_id, 'Player ' || (user_id % 50) || CASE WHEN user_id % 3 = 0 THEN ' ' ELSE '' END AS player_name, round(value, 1) AS score, CASE WHEN event_type IN ('click', 'view') THEN 'points_desc' ELSE 'time_asc' END AS score_type FROM events)"


def _scores(spark, sf_dir):
    e = _events(spark, sf_dir)
    name = F.concat(F.lit("Player "), (F.col("user_id") % 50).cast("string"), F.when(F.col("user_id") % 3 == 0, " ").otherwise(""))
    return e.select(F.col("event_id").alias("idx"), F.col("event_type").alias("game_id"), name.alias("player_name"), F.round("value", 1).alias("score"))


def _games(spark):
    return spark.createDataFrame([("click", "points_desc"), ("view", "points_desc")], "game_id string, score_type string")


@query(f"WITH {_SC} SELECT game_id, idx, player_name, score, score_type, rank FROM (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY CASE WHEN score_type = 'points_desc' THEN -score ELSE score END, idx) AS rank FROM sc) WHERE rank <= 10")
def leaderboard_topk(spark, sf_dir):
    return ranking.leaderboard(_scores(spark, sf_dir), _games(spark)).select("game_id", "idx", "player_name", "score", "score_type", "rank")


@query(f"WITH {_SC}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY CASE WHEN score_type = 'points_desc' THEN -score ELSE score END, idx) AS rank FROM sc) WHERE rank <= 10) SELECT game_id, lower(trim(player_name)) AS player, max(score) AS best FROM t GROUP BY 1, 2")
def leaderboard_best(spark, sf_dir):
    """The reference mode: best of the rows that the limit of ten left, always the greatest."""
    return ranking.best_of_players(ranking.leaderboard(_scores(spark, sf_dir), _games(spark)))


@query(f"WITH {_SC} SELECT game_id, lower(trim(player_name)) AS player, CASE WHEN any_value(score_type) = 'points_desc' THEN max(score) ELSE min(score) END AS best FROM sc GROUP BY 1, 2")
def leaderboard_best_corrected(spark, sf_dir):
    s = _scores(spark, sf_dir).join(_games(spark), "game_id", "left").withColumn("score_type", F.coalesce("score_type", F.lit("time_asc")))
    return ranking.best_of_players(s, exact=False)


@query(f"WITH {_SC} SELECT game_id, rank, lpad(rank::VARCHAR, 2, ' ') || '. ' || rpad(player_name, 24, ' ') || ' ' || printf('%.1f', score) || CASE WHEN score_type = 'points_desc' THEN ' pts' ELSE ' s' END AS line FROM (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY CASE WHEN score_type = 'points_desc' THEN -score ELSE score END, idx) AS rank FROM sc) WHERE rank <= 10")
def leaderboard_report(spark, sf_dir):
    return ranking.report(ranking.leaderboard(_scores(spark, sf_dir), _games(spark)))


@query(f"WITH {_SC} SELECT idx, game_id, score FROM sc WHERE idx % 2 = 0 UNION ALL SELECT idx, game_id, score FROM sc WHERE idx % 3 = 0 AND idx % 2 <> 0")
def pending_merge(spark, sf_dir):
    s = _scores(spark, sf_dir).select("idx", "game_id", "score")
    return ranking.merged(s.filter("idx % 2 = 0"), s.filter("idx % 3 = 0"), ["idx"])


_PK = "pk AS (SELECT event_id * 0.37 AS ts, (user_id % 900) + 100 AS size FROM events), pb AS (SELECT floor(ts / 2.5)::BIGINT AS bin, sum(size)::BIGINT AS bytes FROM pk GROUP BY 1), en AS (SELECT max(ts) AS e, max(floor(ts / 2.5))::BIGINT AS n FROM pk), bn AS (SELECT r.range AS bin, r.range * 2.5 AS start_s, least((r.range + 1) * 2.5, greatest(e, r.range * 2.5 + 1e-9)) AS end_s, coalesce(bytes, 0) AS bytes FROM en, range((SELECT n + 1 FROM en)) r LEFT JOIN pb ON pb.bin = r.range), br AS (SELECT *, bytes * 8 / 1000 / (end_s - start_s) AS kbps FROM bn)"


def _bins(spark, sf_dir):
    e = _events(spark, sf_dir).select((F.col("event_id") * F.lit(0.37)).alias("ts"), (F.col("user_id") % 900 + 100).alias("size"))
    return ranking.packet_bins(e, 2.5)


@query(f"WITH {_PK} SELECT bin, round(start_s, 6)::DOUBLE AS start_s, round(end_s, 6)::DOUBLE AS end_s, bytes, round(kbps, 5)::DOUBLE AS kbps FROM br")
def bitrate_bins(spark, sf_dir):
    return _bins(spark, sf_dir).select("bin", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"), "bytes", F.round("kbps", 5).alias("kbps"))


@query(f"WITH {_PK} SELECT round(min(kbps), 5)::DOUBLE AS v_min, round(avg(kbps), 5)::DOUBLE AS v_mean, round(quantile_cont(kbps, 0.5), 5)::DOUBLE AS p50, round(quantile_cont(kbps, 0.9), 5)::DOUBLE AS p90, round(quantile_cont(kbps, 0.95), 5)::DOUBLE AS p95, round(quantile_cont(kbps, 0.99), 5)::DOUBLE AS p99, round(max(kbps), 5)::DOUBLE AS v_max FROM br")
def bitrate_summary(spark, sf_dir):
    s = profiles.summary(_bins(spark, sf_dir), "kbps")
    return s.select(*(F.round(c, 5).alias(c) for c in s.columns))


@query(f"WITH {_PK} SELECT bin, bytes FROM br ORDER BY kbps DESC, bin LIMIT 5")
def bitrate_peaks(spark, sf_dir):
    return ranking.peaks(_bins(spark, sf_dir), 5).select("bin", "bytes")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 300 PRECEDING AND CURRENT ROW) AS recent FROM events")
def sliding_rate(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id").rangeBetween(-300, 0)
    return _events(spark, sf_dir).select("event_id", F.count("*").over(w).alias("recent"))


@query(f"WITH g AS (SELECT *, sum(CASE WHEN epoch(ts) - epoch(p) >= 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, lag(ts) OVER {_W} AS p FROM events)) SELECT user_id, min(ts)::TIMESTAMP AS start, count(*) AS n FROM g GROUP BY user_id, s")
def session_hold(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


@query("SELECT event_type AS view_mode, count(*) AS n FROM events GROUP BY 1")
def view_mode_frames(spark, sf_dir):
    return _events(spark, sf_dir).groupBy(F.col("event_type").alias("view_mode")).agg(F.count("*").alias("n"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_keyframes(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", F.from_json("props", "k bigint").getField("k").alias("k"))


@query("SELECT event_id, event_id % 40 + 0.5::DOUBLE AS cy FROM events")
def parse_axis(spark, sf_dir):
    text = F.format_string("# axis\nX=%d.25\ny=%d.5\n", F.col("event_id") % 30, F.col("event_id") % 40)
    return _events(spark, sf_dir).select("event_id", shaping.axis_value(text, "Y").alias("cy"))


@query("SELECT event_id, list_aggregate(list_distinct([event_id % 5 + 1, event_id % 3 + 1, 24]), 'sum')::BIGINT AS total FROM events")
def parse_variants(spark, sf_dir):
    text = F.concat_ws(", ", (F.col("event_id") % 5 + 1).cast("string"), (F.col("event_id") % 3 + 1).cast("string"), F.lit("0; 24 fps"))
    return _events(spark, sf_dir).select("event_id", F.aggregate(shaping.parsed_ints(text), F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total"))


@query("SELECT d.doc_id, d.lang, l.quality FROM documents d JOIN labels l USING (doc_id)")
def doc_label_dimension_join(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


_PANELS = """WITH px AS (SELECT a.range AS y, b.range AS x FROM range(60) a, range(60) b), g AS (SELECT y, x, sqrt((y - 29.5) * (y - 29.5) + (x - 29.5) * (x - 29.5)) AS r, CASE WHEN degrees(atan2(29.5 - y, x - 29.5)) < 0 THEN degrees(atan2(29.5 - y, x - 29.5)) + 360 ELSE degrees(atan2(29.5 - y, x - 29.5)) END AS a FROM px),
t AS (SELECT *, 40 - 25 * least(greatest(r / 29.5, 0), 1) AS t, CASE WHEN a > 180 THEN a - 360 ELSE a END AS d FROM g),
w AS (SELECT *, CASE WHEN abs(d) < t / 2 THEN 0 ELSE least(greatest((a - 90 + t / 2) / t, 0), 1) END AS a43, least(greatest((a - 190 + t / 2) / t, 0), 1) AS a32, CASE WHEN abs(d) < t / 2 THEN 1 ELSE least(greatest((a - 280 + t / 2) / t, 0), 1) END AS a21, least(greatest((d + t / 2) / t, 0), 1) AS a14 FROM t)"""


@query(_PANELS + """
SELECT y, x, round(a14 * (1 - a43), 6)::DOUBLE AS w4, round(a43 * (1 - a32), 6)::DOUBLE AS w3, round(a32 * (1 - a21), 6)::DOUBLE AS w2, round(a21 * (1 - a14), 6)::DOUBLE AS w1 FROM w""")
def panel_blend_weights(spark, sf_dir):
    from lattiq.operators.rasters import blend_weights

    return blend_weights(spark, 60, (90.0, 190.0, 280.0), 40.0, 15.0).select("y", "x", *(F.round(f"w{i}", 6).alias(f"w{i}") for i in (4, 3, 2, 1)))


@query(_PANELS + """, ww AS (SELECT y, x, a14 * (1 - a43) AS w4, a43 * (1 - a32) AS w3, a32 * (1 - a21) AS w2, a21 * (1 - a14) AS w1 FROM w), pn AS (SELECT l_linenumber % 4 + 1 AS panel, l_orderkey % 60 AS y, l_partkey % 60 AS x, max(l_quantity) * 5 AS r, (min(l_suppkey) * 7 % 256)::DOUBLE AS g, (count(*) * 40 % 256)::DOUBLE AS b FROM lineitem GROUP BY ALL),
j AS (SELECT y, x, r, g, b, CASE panel WHEN 1 THEN w1 WHEN 2 THEN w2 WHEN 3 THEN w3 ELSE w4 END AS k FROM pn JOIN ww USING (y, x))
SELECT y, x, floor(round(least(greatest(sum(r * k), 0), 255), 9))::INTEGER AS r, floor(round(least(greatest(sum(g * k), 0), 255), 9))::INTEGER AS g, floor(round(least(greatest(sum(b * k), 0), 255), 9))::INTEGER AS b FROM j GROUP BY y, x""")
def panel_mosaic(spark, sf_dir):
    """Four panels drawn from the lines of orders, blended by azimuth into one raster."""
    from lattiq.operators.rasters import blend_weights, blended

    k = table(spark, sf_dir, "lineitem")
    at = (F.col("l_linenumber") % 4 + 1).cast("int").alias("panel"), (F.col("l_orderkey") % 60).alias("y"), (F.col("l_partkey") % 60).alias("x")
    panels = k.groupBy(*at).agg((F.max("l_quantity") * 5).alias("r"), (F.min("l_suppkey") * 7 % 256).alias("g"), (F.count("*") * 40 % 256).alias("b"))
    return blended(panels, blend_weights(spark, 60, (90.0, 190.0, 280.0), 40.0, 15.0))
