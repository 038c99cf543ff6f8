"""Queries of scenes and games, crops and masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattiq.functions import shaping
from lattiq.operators import fields, profiles, scene, timelines, voxels
from lattiq.plans.base import VOX, query, table, vox
from lattiq.plans.track_queries import _PTS, _points
from lattiq.plans.volume_queries import _cells, _labels, _STEP

ZYX = ["z", "y", "x"]


@query(_STEP + " SELECT column_id, len(list(DISTINCT step_id))::BIGINT AS n, list_aggregate(list(DISTINCT step_id), 'sum')::BIGINT AS total, min(step_id) AS first FROM cells GROUP BY column_id")
def step_sets(spark, sf_dir):
    """The set of steps of each column, by its size, sum and least member."""
    s = scene.step_sets(_cells(spark, sf_dir))
    return s.select("column_id", F.size("steps").cast("bigint").alias("n"), F.aggregate("steps", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"), F.element_at("steps", 1).alias("first"))


@query(_STEP + ", d AS (SELECT DISTINCT step_id FROM cells WHERE column_id >= 3), l AS (SELECT step_id, count(*) AS k FROM cells WHERE column_id < 3 GROUP BY step_id) SELECT step_id, coalesce(k, 0) AS \"left\", (row_number() OVER (ORDER BY step_id) - 1) // 6 AS tick FROM d LEFT JOIN l USING (step_id)")
def vanish_columns(spark, sf_dir):
    """Columns from 3 on vanish: the steps that change, what is left of them, and the tick that rebuilds each."""
    cells = _cells(spark, sf_dir)
    dirty = scene.vanished(cells, cells.filter("column_id >= 3").select("column_id").distinct())[1]
    return scene.ticks(dirty, "step_id", 6).select("step_id", "left", "tick")


@query(VOX + " SELECT round(greatest(2.0, 0.2 * sqrt((max(z) - min(z)) ** 2 + (max(y) - min(y)) ** 2 + (max(x) - min(x)) ** 2)), 9)::DOUBLE AS margin FROM vox")
def catch_margin(spark, sf_dir):
    return scene.catch_margin(vox(spark, sf_dir)[0], 0.2).select(F.round("margin", 9).alias("margin"))


@query("SELECT event_id AS t, list_aggregate(list_filter([event_id % 5, event_id % 7 + 1, 3], lambda c: c IN (event_id % 4, 3, 5)), 'sum')::BIGINT AS total FROM (SELECT * FROM events)")
def seen_columns(spark, sf_dir):
    """What is both inside and visible at each time (repeats once), summed."""
    k = F.col("event_id")
    e = table(spark, sf_dir, "events")
    inside = e.select(k.alias("t"), F.array(k % 5, k % 7 + 1, F.lit(3).cast("bigint")).alias("columns"))
    visible = e.select(k.alias("t"), F.array(k % 4, F.lit(3).cast("bigint"), F.lit(5).cast("bigint")).alias("columns"))
    both = inside.join(scene.seen(inside, visible).withColumnRenamed("columns", "_b"), "t")
    return both.select("t", F.aggregate(F.filter("columns", lambda c: F.array_contains("_b", c)), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query("""WITH c AS (SELECT user_id AS session, event_id % 200 AS t, event_id % 9 AS column_id FROM events), f AS (SELECT session, column_id, min(t) AS t FROM c WHERE t < 120 GROUP BY ALL), g AS (SELECT session, count(*) AS score, max(t) AS last_t FROM f GROUP BY session)
SELECT 'session ' || s.session AS player_name, coalesce(score, 0)::DOUBLE AS score, coalesce(score, 0) >= 6 AS won, (CASE WHEN coalesce(score, 0) >= 6 THEN last_t ELSE 120 END)::DOUBLE AS seconds FROM (SELECT DISTINCT session FROM c) s LEFT JOIN g USING (session)""")
def score_records(spark, sf_dir):
    """A score record for every game of a user who catches columns."""
    k = F.col("event_id")
    catches = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), (k % 200).alias("t"), (k % 9).alias("column_id"))
    return scene.score_rows(catches, 6).select("player_name", "score", "won", F.col("seconds").cast("double").alias("seconds"))


@query("SELECT user_id, count(*) FILTER (event_type = 'click') AS score, CASE WHEN user_id * 8 <= 4000 THEN 8 WHEN user_id * 4 <= 4000 THEN 4 WHEN user_id * 2 <= 4000 THEN 2 ELSE 1 END::INTEGER AS scale FROM events GROUP BY user_id")
def photo_scores(spark, sf_dir):
    return scene.photo_scores(table(spark, sf_dir, "events"), "click").withColumn("scale", scene.photo_scale(F.col("user_id"), 4000))


@query(f"WITH {_PTS} SELECT path_id, i, pz + 1.5 AS z, py - 2 AS y, px AS x, 2.5::DOUBLE AS fz FROM pts")
def shifted_cameras(spark, sf_dir):
    """Cameras of a second eye."""
    cams = _points(spark, sf_dir).select("path_id", "i", F.array("pz", "py", "px").alias("position"), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)).alias("focal"))
    out = scene.shifted(cams, (1.5, -2.0, 0.0))
    return out.select("path_id", "i", *(F.element_at("position", k + 1).alias(a) for k, a in enumerate(ZYX)), F.element_at("focal", 1).alias("fz"))


@query(f"WITH {_PTS}, r AS (SELECT quantile_cont(sqrt(pz * pz + py * py + px * px), 0.5) * 0.02 AS r FROM pts) SELECT path_id * 1000000 + i AS frame, round(pz - 0.5 * r, 9) AS z, round(r, 9) AS radius FROM pts, r")
def offset_path(spark, sf_dir):
    """A tube below the camera's path."""
    t = _points(spark, sf_dir).select((F.col("path_id") * 1000000 + F.col("i")).alias("frame"), "pz", "py", "px", *(F.lit(0.0).alias(f"f{a}") for a in ZYX))
    return scene.offset_path(t).select("frame", F.round("z", 9).alias("z"), F.round("radius", 9).alias("radius"))


@query(f"WITH {_PTS} SELECT path_id, i, row_number() OVER (ORDER BY path_id, i) - 1 AS place FROM pts")
def scattered_points(spark, sf_dir):
    """Where each point stands when paths are laid end to end."""
    p = _points(spark, sf_dir)
    return scene.scattered(p, "path_id", "i", scene.path_starts(p, "path_id")).select("path_id", "i", "place")


@query("WITH s AS (SELECT sum(user_id % 900 + 100)::BIGINT AS n_bytes, max(event_id * 0.37 + 0.04) AS seconds FROM events) SELECT n_bytes, round(seconds, 6)::DOUBLE AS seconds, round(n_bytes * 8 / 1000 / seconds, 6)::DOUBLE AS kbps, NOT (n_bytes * 8 / 1000 / seconds BETWEEN 1 AND 50000) AS odd FROM s")
def average_rate(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("event_id") * F.lit(0.37)).alias("ts"), F.lit(0.04).alias("dur"), (F.col("user_id") % 900 + 100).alias("size"))
    return scene.average_rate(e, 1.0, 50000.0).select("n_bytes", F.round("seconds", 6).alias("seconds"), F.round("kbps", 6).alias("kbps"), "odd")


@query(VOX + " SELECT z, y, x FROM vox WHERE v >= 45 ORDER BY least((z - 3) ** 2 + (y - 3) ** 2 + (x - 3) ** 2, (z - 20) ** 2 + (y - 5) ** 2 + (x - 15) ** 2) DESC, z, y, x LIMIT 15")
def farthest_points(spark, sf_dir):
    """The 15 voxels farthest from two centres."""
    near = profiles.nearest_centre(vox(spark, sf_dir)[0].filter("v >= 45").select(*ZYX), [(3, 3, 3), (20, 5, 15)], ZYX)
    return near.orderBy(F.desc("d2"), *ZYX).limit(15).select(*ZYX)


@query("SELECT event_type AS species, event_id % 6 AS level, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS v_max FROM events GROUP BY 1, 2")
def level_sweep(spark, sf_dir):
    """A diagnostic row for every species and level."""
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("species"), (F.col("event_id") % 6).alias("level")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("v_max"))


_MOVED = ", ".join(f"p{a} + 2.0::DOUBLE * ({a} / greatest(sqrt(z * z + y * y + x * x), 1e-9)) AS p{a}" for a in "zyx")


@query(f"""WITH {_PTS}, u AS (SELECT path_id, avg(pz) AS z, avg(py) AS y, avg(px) AS x FROM pts GROUP BY path_id), mv AS (SELECT path_id, i, {_MOVED} FROM pts JOIN u USING (path_id)),
s AS (SELECT *, coalesce(sqrt((pz - lag(pz) OVER w) ** 2 + (py - lag(py) OVER w) ** 2 + (px - lag(px) OVER w) ** 2), 0) AS seg FROM mv WINDOW w AS (PARTITION BY path_id ORDER BY i)), c AS (SELECT *, sum(seg) OVER (PARTITION BY path_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS c0 FROM s),
g AS (SELECT path_id, c0, lead(c0) OVER w AS c1, max(c0) OVER (PARTITION BY path_id) AS total, {", ".join(f"p{a} AS {a}0, lead(p{a}) OVER w AS {a}1, coalesce(lag(p{a}) OVER w, p{a}) AS {a}b" for a in "zyx")} FROM c WINDOW w AS (PARTITION BY path_id ORDER BY i)),
r AS (SELECT g.*, k.range AS i, (k.range * 25.0::DOUBLE - c0) / (c1 - c0) AS f, sqrt((z1 - zb) ** 2 + (y1 - yb) ** 2 + (x1 - xb) ** 2) AS t FROM g, range(1, 400) k WHERE c1 > c0 AND k.range * 25.0 > c0 AND k.range * 25.0 <= c1 AND k.range * 25.0 < total)
SELECT path_id, i, {", ".join(f"round({a}0 + f * ({a}1 - {a}0), 4) + 0.0 AS p{a}, round(CASE WHEN t > 0 THEN ({a}1 - {a}b) / t ELSE 0 END, 4) + 0.0 AS t{a}" for a in "zyx")} FROM r""")
def path_rings(spark, sf_dir):
    """Rings every 25 along each path, which is moved by two along its own up, and their directions."""
    pts = _points(spark, sf_dir)
    mean = pts.groupBy("path_id").agg(*(F.avg(f"p{a}").alias(a) for a in ZYX))
    size = F.greatest(F.sqrt(sum((F.col(a) * F.col(a) for a in ZYX), F.lit(0.0))), F.lit(1e-9))
    out = timelines.rings(pts.join(mean, "path_id").select("path_id", "i", "pz", "py", "px", *((F.col(a) / size).alias(f"u{a}") for a in ZYX)), ["path_id"], ["i"], ["pz", "py", "px"], 25.0, {f"p{a}": F.col(f"u{a}") for a in ZYX}, 2.0)
    return out.select("path_id", F.col("i").cast("bigint").alias("i"), *((F.round(f"p{a}", 4) + 0.0).alias(f"p{a}") for a in ZYX), *((F.round(f"tp{a}", 4) + 0.0).alias(f"t{a}") for a in ZYX))


@query(VOX + ", t AS (SELECT max(v) + 1 AS top FROM vox), g AS (SELECT a.range AS z, b.range AS y, c.range AS x FROM range((SELECT n + 2 FROM p)) a, range((SELECT n + 2 FROM p)) b, range((SELECT n + 2 FROM p)) c) SELECT z + 1 AS z, y + 1 AS y, x + 1 AS x, v FROM vox UNION ALL SELECT z, y, x, top FROM g, t, p WHERE least(z, y, x) < 1 OR greatest(z, y, x) > n")
def padded_volume(spark, sf_dir):
    v, n = vox(spark, sf_dir)
    return voxels.padded(v.select(*ZYX, "v"), n)


@query(VOX + """, m AS (SELECT z, y, x FROM vox WHERE v >= 49), g AS (SELECT DISTINCT z + dz AS z, y + dy AS y, x + dx AS x FROM m, (VALUES (0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) o(dz, dy, dx), p WHERE least(z + dz, y + dy, x + dx) >= 0 AND greatest(z + dz, y + dy, x + dx) < n),
b AS (SELECT a.range AS z, bb.range AS y, c.range AS x FROM range((SELECT min(z) FROM g), (SELECT max(z) + 1 FROM g)) a, range((SELECT min(y) FROM g), (SELECT max(y) + 1 FROM g)) bb, range((SELECT min(x) FROM g), (SELECT max(x) + 1 FROM g)) c)
SELECT b.z, b.y, b.x, CASE WHEN g.z IS NULL THEN -1.0 ELSE coalesce(v, 0) END AS v FROM b LEFT JOIN g USING (z, y, x) LEFT JOIN vox USING (z, y, x)""")
def grown_crop(spark, sf_dir):
    """The voxels of 49 or more, grown by one, in their box."""
    v, n = vox(spark, sf_dir)
    return voxels.grown_crop(v.filter("v >= 49"), v, (n, n, n))


@query(VOX + ", c AS (SELECT greatest(0, least(3 - 5, n - 10)) AS r0, greatest(0, least(21 - 5, n - 10)) AS c0 FROM p) SELECT y - r0 AS r, x - c0 AS c, v FROM vox, c WHERE z = 5 AND y BETWEEN r0 AND r0 + 9 AND x BETWEEN c0 AND c0 + 9")
def square_crop(spark, sf_dir):
    v, n = vox(spark, sf_dir)
    return voxels.square_crop(v.filter("z = 5").select(F.col("y").alias("r"), F.col("x").alias("c"), "v"), 3, 21, 10, n)


_ERODE = lambda of, name: f"{name} AS (SELECT z, y + dy AS y, x + dx AS x FROM {of}, (VALUES (-1), (0), (1)) a(dy), (VALUES (-1), (0), (1)) b(dx) GROUP BY ALL HAVING count(*) = 9)"
_DILATE = lambda of, name: f"{name} AS (SELECT DISTINCT z, y + dy AS y, x + dx AS x FROM {of}, (VALUES (-1), (0), (1)) a(dy), (VALUES (-1), (0), (1)) b(dx))"
_PARTS = _labels("b.z = a.z AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1 AND b.id <> a.id", "y BETWEEN 0 AND n - 1 AND x BETWEEN 0 AND n - 1").replace(", m AS (SELECT", f", big AS (SELECT z, y, x FROM vox WHERE v >= 12), {_ERODE('big', 'e1')}, {_ERODE('e1', 'e2')}, {_DILATE('e2', 'd1')}, {_DILATE('d1', 'd2')}, m AS MATERIALIZED (SELECT", 1).replace("FROM vox, p WHERE y BETWEEN", "FROM d2, p WHERE y BETWEEN")


@query(_PARTS + ", s AS (SELECT z, cid, count(*) AS k FROM lab GROUP BY z, cid), t AS (SELECT z, cid FROM s QUALIFY row_number() OVER (PARTITION BY z ORDER BY k DESC, cid) = 1) SELECT lab.z, lab.y, lab.x FROM lab JOIN t USING (z, cid) JOIN big USING (z, y, x)")
def outside_mask(spark, sf_dir):
    """The largest part of each plane's opening by two rounds, within the mask."""
    v, n = vox(spark, sf_dir)
    return fields.outside_mask(v.filter("v >= 12").select(*ZYX), n)


@query(VOX + ", pts AS (SELECT event_id AS pid, (event_id % 40) - 4 + 0.5 AS pz, (event_id % 19) + 0.5 AS py, (event_id % 17) + 0.75 AS px FROM events), a AS (SELECT pid, least(greatest(round_even(pz, 0)::BIGINT, 0), n - 1) AS z, least(greatest(round_even(py, 0)::BIGINT, 0), n - 1) AS y, least(greatest(round_even(px, 0)::BIGINT, 0), n - 1) AS x FROM pts, p) SELECT pid, v FROM a LEFT JOIN vox USING (z, y, x)")
def nearest_sample(spark, sf_dir):
    """Samples at the nearest voxel, halves to even, outside places at the border."""
    v, n = vox(spark, sf_dir)
    e = F.col("event_id")
    pts = table(spark, sf_dir, "events").select(e.alias("pid"), (e % 40 - 4 + 0.5).alias("pz"), (e % 19 + 0.5).alias("py"), (e % 17 + 0.75).alias("px"))
    return voxels.nearest_sample(pts, v, (n, n, n)).select("pid", "v")


@query("SELECT event_id, round((b - 0.8 * (0.6 * a + 0.8 * b)) / sqrt((a - 0.6 * (0.6 * a + 0.8 * b)) ** 2 + (b - 0.8 * (0.6 * a + 0.8 * b)) ** 2 + 4), 6) AS uy FROM (SELECT event_id, (event_id % 7 - 3)::DOUBLE AS a, (event_id % 5 - 2)::DOUBLE AS b FROM events)")
def upright_vectors(spark, sf_dir):
    """View-ups made upright against one direction."""
    k = F.col("event_id")
    up = F.array((k % 7 - 3).cast("double"), (k % 5 - 2).cast("double"), F.lit(2.0))
    u = shaping.upright(up, F.array(F.lit(0.6), F.lit(0.8), F.lit(0.0)))
    return table(spark, sf_dir, "events").select("event_id", F.round(F.element_at(u, 2), 6).alias("uy"))


@query("SELECT event_id, CASE WHEN event_id >= 3600 THEN (event_id // 3600) || 'h' || lpad((event_id % 3600 // 60)::VARCHAR, 2, '0') || 'm' WHEN event_id >= 60 THEN (event_id // 60) || 'm' || lpad((event_id % 60)::VARCHAR, 2, '0') || 's' ELSE event_id || 's' END AS eta FROM events")
def progress_eta(spark, sf_dir):
    """Times left, in words."""
    return table(spark, sf_dir, "events").select("event_id", shaping.eta(F.col("event_id").cast("double")).alias("eta"))


_WHOLE = "greatest(ceil(({last} + 1e-6 - {first}) / 4.0::DOUBLE), 1)"
_STOPS = f"{_WHOLE} + CASE WHEN {{last}} - ({{first}} + 4.0::DOUBLE * ({_WHOLE} - 1)) >= 1.0 THEN 1 ELSE 0 END"


@query(VOX + f""", c AS (SELECT c AS column_id, max(v) - 0.1::DOUBLE AS top FROM vox GROUP BY c HAVING max(v) - 0.1::DOUBLE >= 0.3),
s AS (SELECT *, {_STOPS.format(first="0.2::DOUBLE", last="top")} AS n0, CASE WHEN top - 0.1::DOUBLE > 0.1::DOUBLE + 1e-6 THEN {_STOPS.format(first="4.1::DOUBLE", last="(top - 0.1::DOUBLE)")} ELSE 0 END AS n2 FROM c), r AS (SELECT *, round_even((n0 + n2) * 0.5, 0) AS n1 FROM s)
SELECT column_id, k.range AS frame, CASE WHEN k.range < n0 THEN 0 WHEN k.range < n0 + n1 THEN 1 ELSE 2 END::INTEGER AS phase,
  round(CASE WHEN k.range < n0 + n1 THEN 0.1::DOUBLE WHEN k.range = n0 + n1 + n2 - 1 THEN top - 0.1::DOUBLE ELSE 4.1::DOUBLE + 4.0::DOUBLE * (k.range - n0 - n1) END, 9) AS d0, round(CASE WHEN k.range < n0 - 1 THEN 0.2::DOUBLE + 4.0::DOUBLE * k.range ELSE top END, 9) AS d1 FROM r, range(200) k WHERE k.range < n0 + n1 + n2""")
def shell_schedules(spark, sf_dir):
    """All three phases of the shells of each column, by steps of 4."""
    v, _ = vox(spark, sf_dir)
    s = fields.shell_schedules(v.groupBy(F.col("c").alias("column_id")).agg(F.max("v").alias("most")), 4.0, 0.5)
    return s.select("column_id", "frame", F.col("phase").cast("int").alias("phase"), F.round("d0", 9).alias("d0"), F.round("d1", 9).alias("d1"))


_TICKS = "t AS (SELECT user_id % 50 AS subscriber, event_id * 0.004::DOUBLE AS t, event_id % 11 <> 0 AS enabled, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS rn FROM events)"


@query(f"""WITH RECURSIVE {_TICKS}, f(subscriber, rn, last_t, credit, run) AS (SELECT subscriber, rn, CASE WHEN enabled THEN t END, 0.0::DOUBLE, enabled FROM t WHERE rn = 1
UNION ALL SELECT subscriber, rn, CASE WHEN enabled THEN t END, CASE WHEN NOT enabled OR last_t IS NULL OR t - last_t > 1 THEN 0.0 WHEN credit + (t - last_t) + 1e-9 >= 0.3 THEN least(credit + (t - last_t) - 0.3, 0.3) ELSE credit + (t - last_t) END, enabled AND (last_t IS NULL OR t - last_t <= 1 AND credit + (t - last_t) + 1e-9 >= 0.3)
FROM (SELECT t.*, f.last_t, f.credit FROM f JOIN t ON t.subscriber = f.subscriber AND t.rn = f.rn + 1)) SELECT subscriber, t FROM f JOIN t USING (subscriber, rn) WHERE run""")
def scheduler_runs(spark, sf_dir):
    """When fifty subscribers run whose ticks come at odd times and who are switched off now and then."""
    import pandas as pd

    from lattiq.streaming.profiles import fired

    k = F.col("event_id")
    ticks = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("subscriber"), (k * F.lit(0.004)).alias("t"), F.lit(0.3).alias("period_s"), (k % 11 != 0).alias("enabled"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return fired(pdf.sort_values("t"), None, 0.0)[0][["subscriber", "t"]]

    return ticks.groupBy("subscriber").applyInPandas(one, "subscriber bigint, t double")


@query("WITH t AS (SELECT user_id % 50 AS ship, event_id, event_id * 0.004::DOUBLE AS t, (event_id % 5 - 2)::DOUBLE AS v FROM events), d AS (SELECT *, t - lag(t) OVER w AS dt, lag(v) OVER w AS before FROM t WINDOW w AS (PARTITION BY ship ORDER BY t)) SELECT ship, event_id, round(sum(CASE WHEN dt > 0 AND dt <= 1 THEN before * dt ELSE 0 END) OVER (PARTITION BY ship ORDER BY t ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS moved FROM d")
def inertial_ways(spark, sf_dir):
    """How far fifty ships have drifted."""
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("ship"), "event_id", (k * F.lit(0.004)).alias("t"), (k % 5 - 2).cast("double").alias("v"))
    return timelines.drifted(rows, ["ship"], "t", ["v"]).select("ship", "event_id", (F.round("moved_v", 6) + 0.0).alias("moved"))
