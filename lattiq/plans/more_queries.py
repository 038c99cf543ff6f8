"""Further queries: culls and slices, track statistics, colours, keyframes, compositions."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from lattiq.functions import shaping
from lattiq.operators import fields, paths, profiles, timelines, voxels
from lattiq.operators.tables import apart
from lattiq.plans import builds
from lattiq.plans.base import REC, VOX, query, table, vox
from lattiq.plans.track_queries import _PTS, _points
from lattiq.plans.volume_queries import _N26, _labels

ZYX = ["z", "y", "x"]


@query(VOX + " SELECT z, y, x, CASE WHEN (z - 4) * (z - 4) + (y - 4) * (y - 4) + (x - 4) * (x - 4) >= 100 THEN 0.0 ELSE v END AS alpha FROM vox")
def distance_cull(spark, sf_dir):
    d2 = sum(((F.col(a) - 4) * (F.col(a) - 4) for a in ZYX), F.lit(0))
    return vox(spark, sf_dir)[0].select(*ZYX, F.when(d2 >= 100, 0.0).otherwise(F.col("v")).alias("alpha"))


@query("SELECT event_id FROM events WHERE event_id >= round_even(1.7 * 25, 0) AND event_id < round_even(20.3 * 25, 0)")
def window_slice(spark, sf_dir):
    return table(spark, sf_dir, "events").filter((F.col("event_id") >= round(1.7 * 25)) & (F.col("event_id") < round(20.3 * 25))).select("event_id")


_CYL = ", cyl AS (SELECT *, least(z * 6 // n, 5) AS l, least(floor((atan2(y - n / 2.0, x - n / 2.0) + pi()) / (2 * pi()) * 8)::BIGINT, 7) AS t FROM vox, p), grid AS (SELECT l, t, avg(v) AS m FROM cyl GROUP BY l, t)"


@query(VOX + _CYL + " SELECT cyl.z * 10000 + cyl.y * 100 + cyl.x AS fid, round(m, 6) AS scalar FROM cyl JOIN grid USING (l, t) WHERE c >= 2")
def face_bin_lookup(spark, sf_dir):
    """Faces take the value of the (length, angle) bin of their centre."""
    v, n = vox(spark, sf_dir)
    c = profiles.cylindrical(v, n / 2.0, n / 2.0, 6, 8, n)
    grid = c.groupBy("l", "t").agg(F.avg("v").alias("m"))
    return c.filter("c >= 2").join(grid, ["l", "t"]).select((F.col("z") * 10000 + F.col("y") * 100 + F.col("x")).alias("fid"), F.round("m", 6).alias("scalar"))


@query(f"""WITH {_PTS}, s AS (SELECT path_id, i, sqrt((pz - lag(pz) OVER w) ** 2 + (py - lag(py) OVER w) ** 2) * 25 AS v FROM pts WINDOW w AS (PARTITION BY path_id ORDER BY i)), a AS (SELECT *, (v - lag(v) OVER (PARTITION BY path_id ORDER BY i)) * 25 AS acc FROM s)
SELECT path_id, round(avg(v), 4) AS v_mean, round(stddev_pop(v), 4) AS v_std, round(max(v), 4) AS v_max, round(sqrt(avg(acc * acc)), 3) AS a_rms, round(max(abs(acc)), 3) AS a_max FROM a GROUP BY path_id""")
def track_stats(spark, sf_dir):
    w = timelines.ordered(["path_id"], ["i"])
    d = lambda c: (F.col(c) - F.lag(c).over(w)) * (F.col(c) - F.lag(c).over(w))
    s = _points(spark, sf_dir).withColumn("v", F.sqrt(d("pz") + d("py")) * 25)
    a = s.withColumn("acc", (F.col("v") - F.lag("v").over(w)) * 25)
    return a.groupBy("path_id").agg(F.round(F.avg("v"), 4).alias("v_mean"), F.round(F.stddev_pop("v"), 4).alias("v_std"), F.round(F.max("v"), 4).alias("v_max"), F.round(F.sqrt(F.avg(F.col("acc") * F.col("acc"))), 3).alias("a_rms"), F.round(F.max(F.abs("acc")), 3).alias("a_max"))


@query(f"""WITH {_PTS}, s AS (SELECT path_id, i, pz - lag(pz) OVER w AS az, py - lag(py) OVER w AS ay, lead(pz) OVER w - pz AS bz, lead(py) OVER w - py AS by_ FROM pts WINDOW w AS (PARTITION BY path_id ORDER BY i)) SELECT path_id, i, round(sqrt((bz - az) ** 2 + (by_ - ay) ** 2), 6) AS curvature FROM s""")
def curvature(spark, sf_dir):
    w = timelines.ordered(["path_id"], ["i"])
    second = lambda c: F.lead(c).over(w) - 2 * F.col(c) + F.lag(c).over(w)
    return _points(spark, sf_dir).withColumn("a", second("pz")).withColumn("b", second("py")).select("path_id", "i", F.round(F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b")), 6).alias("curvature"))


@query("""WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM events)
SELECT user_id, event_type AS mode, min(event_id) AS start, max(event_id) AS stop, count(*) AS n FROM r GROUP BY user_id, event_type, g""")
def run_report(spark, sf_dir):
    """Runs of one mode: where they start and stop."""
    e = table(spark, sf_dir, "events")
    w = timelines.ordered(["user_id"], ["event_id"])
    runs = e.withColumn("_p", F.lag("event_type").over(w))
    runs = timelines.islands(runs, ["user_id"], ["event_id"], F.col("event_type") != F.col("_p"))
    return runs.groupBy("user_id", F.col("event_type").alias("mode"), "island").agg(F.min("event_id").alias("start"), F.max("event_id").alias("stop"), F.count("*").alias("n")).drop("island")


@query(f"WITH {_PTS} SELECT path_id, i, first_value(pz) OVER (PARTITION BY path_id ORDER BY i) AS locked FROM pts")
def orientation_lock(spark, sf_dir):
    return _points(spark, sf_dir).select("path_id", "i", F.first("pz").over(Window.partitionBy("path_id").orderBy("i")).alias("locked"))


@query(f"WITH {_PTS}, m AS (SELECT path_id, avg(pz) AS z, avg(py) AS y, avg(px) AS x FROM pts GROUP BY path_id) SELECT path_id, round(z / greatest(sqrt(z * z + y * y + x * x), 1e-9), 6) AS uz, round(y / greatest(sqrt(z * z + y * y + x * x), 1e-9), 6) AS uy FROM m")
def world_up(spark, sf_dir):
    m = _points(spark, sf_dir).groupBy("path_id").agg(*(F.avg(f"p{a}").alias(a) for a in ZYX))
    size = F.greatest(F.sqrt(sum((F.col(a) * F.col(a) for a in ZYX), F.lit(0.0))), F.lit(1e-9))
    return m.select("path_id", F.round(F.col("z") / size, 6).alias("uz"), F.round(F.col("y") / size, 6).alias("uy"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (json_extract(props, '$.k') IS NULL) AS legacy, min(CAST(json_extract(props, '$.k') AS BIGINT)) AS k_min, max(CAST(json_extract(props, '$.k') AS BIGINT)) AS k_max FROM events GROUP BY event_type")
def keyframe_summary(spark, sf_dir):
    k = F.variant_get(F.parse_json("props"), "$.k", "bigint")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(k.isNull()).alias("legacy"), F.min(k).alias("k_min"), F.max(k).alias("k_max"))


@query("""WITH c AS (SELECT event_id, (event_id % 11) / 10.0::DOUBLE AS r, (event_id % 7) / 6.0::DOUBLE AS g, (event_id % 5) / 4.0::DOUBLE AS b FROM events), d AS (SELECT *, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS d FROM c),
h AS (SELECT *, CASE WHEN d = 0 THEN 0 WHEN v = r THEN (g - b) / d WHEN v = g THEN 2 + (b - r) / d ELSE 4 + (r - g) / d END / 6 + 0.25 AS h0, CASE WHEN v = 0 THEN 0 ELSE d / v END AS s FROM d), q AS (SELECT *, (h0 - floor(h0)) * 6 AS h6 FROM h)
SELECT event_id, round(v - v * s * greatest(0, least((5 + h6) - 6 * floor((5 + h6) / 6), 4 - ((5 + h6) - 6 * floor((5 + h6) / 6)), 1)), 6)::DOUBLE AS r, round(v - v * s * greatest(0, least((3 + h6) - 6 * floor((3 + h6) / 6), 4 - ((3 + h6) - 6 * floor((3 + h6) / 6)), 1)), 6)::DOUBLE AS g FROM q""")
def hue_shift(spark, sf_dir):
    k = F.col("event_id")
    c = shaping.hue_shifted((k % 11) / 10.0, (k % 7) / 6.0, (k % 5) / 4.0, 0.25)
    return table(spark, sf_dir, "events").select("event_id", c.alias("c")).select("event_id", F.round("c.r", 6).alias("r"), F.round("c.g", 6).alias("g"))


@query("SELECT l_returnflag AS label, CASE l_returnflag WHEN 'A' THEN 'aqueous' WHEN 'N' THEN 'nitrogen' END AS name, count(*) AS n FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY 1, 2")
def label_configuration(spark, sf_dir):
    """Labels that the configuration does not know are skipped."""
    config = spark.createDataFrame([("A", "aqueous"), ("N", "nitrogen")], "label string, name string")
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("label")).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(config), "label")


@query(VOX + ", a AS (SELECT z, y, x, v FROM vox WHERE v >= 20), b AS (SELECT z, y, x, c::DOUBLE AS w FROM vox) SELECT z, y, x, v, w FROM a JOIN b USING (z, y, x)")
def aligned_volumes(spark, sf_dir):
    v, _ = vox(spark, sf_dir)
    return voxels.combined(v.filter("v >= 20").select(*ZYX, "v"), v.select(*ZYX, F.col("c").cast("double").alias("v")), "w", check=False)


@query("SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN value END, CASE WHEN event_id % 2 = 0 THEN 0.5 END, 0.0)::DOUBLE AS boost FROM events")
def cache_fallback(spark, sf_dir):
    from lattiq.sources.sinks import track_cache

    k = F.col("event_id")
    e = table(spark, sf_dir, "events").select("event_id", F.when(k % 3 == 0, F.col("value")).alias("boost"), F.when(k % 2 == 0, 0.5).alias("sat"))
    return track_cache(e).select("event_id", "boost")


@query("SELECT l_shipmode AS k, n FROM (SELECT l_linestatus AS l_shipmode, count(*) AS n FROM lineitem GROUP BY 1) WHERE l_shipmode NOT IN (SELECT o_orderstatus FROM orders WHERE o_orderstatus = 'F')")
def jobs_to_do(spark, sf_dir):
    """Jobs without a done row."""
    from lattiq.sources.sinks import to_do

    jobs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("k")).agg(F.count("*").alias("n"))
    return to_do(jobs, table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderstatus").alias("k")), ["k"])


@query(f"""WITH {_PTS}, r AS (SELECT path_id, row_number() OVER (PARTITION BY path_id ORDER BY i) - 1 AS j, px - avg(px) OVER (PARTITION BY path_id) AS d, count(*) OVER (PARTITION BY path_id) AS n FROM pts),
s AS (SELECT path_id, n, k.range AS f, sqrt(sum(d * cos(2 * pi() * k.range * j / n)) ** 2 + sum(d * sin(2 * pi() * k.range * j / n)) ** 2) AS amp FROM r JOIN range(1, (SELECT max(n) // 2 + 1 FROM r)) k ON k.range <= n // 2 GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY path_id ORDER BY round(amp, 6) DESC, f) - 1 AS k FROM s) SELECT path_id, k, round(f * 25.0::DOUBLE / n, 6) AS freq, round(amp, 5) + 0.0 AS amp FROM o WHERE k < 6""")
def spectrum_peaks(spark, sf_dir):
    """The strongest frequencies of each path's coordinate."""

    def many(pdf: pd.DataFrame, begins) -> pd.DataFrame:
        tracks = [t for _, t in pdf.groupby("path_id", sort=False)]
        return pd.DataFrame([(t["path_id"].iloc[0], k, f, a) for t in tracks for k, (f, a) in enumerate(paths.spectrum_peaks(t["px"].to_numpy(), 25.0))], columns=["path_id", "k", "freq", "amp"])

    return paths.by_track(_points(spark, sf_dir).select("path_id", "i", "px"), "path_id", ["i"], many, "path_id bigint, k bigint, freq double, amp double").select("path_id", "k", F.round("freq", 6).alias("freq"), (F.round("amp", 5) + 0.0).alias("amp"))


@query()
def smoothed_grid(spark, sf_dir):
    """The 6 by 8 density grid drawn four times larger and blurred round the angle: one small group."""
    v, n = vox(spark, sf_dir)
    c = profiles.ratio_grid(profiles.cylindrical(v, n / 2.0, n / 2.0, 6, 8, n), F.col("v") >= 40, 6, 8)

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        g = np.zeros((6, 8))
        g[pdf["l"], pdf["t"]] = pdf["ratio"]
        big = builds.periodic_zoom(g, 4, 1.0)
        r, k = np.indices(big.shape)
        return pd.DataFrame({"r": r.ravel(), "k": k.ravel(), "v": big.ravel()})

    return c.select("l", "t", "ratio", (F.col("l") * 0).alias("all")).groupBy("all").applyInPandas(draw, "r bigint, k bigint, v double")


def _of_label(v: int) -> str:
    """CTEs m, e, cc and lab of the 26-connected parts of one label, named by it."""
    text = _labels(_N26, f"v = {v}").removeprefix(REC).lstrip(", ")
    for name in ("m", "e", "cc", "lab"):
        text = re.sub(rf"\b{name}\b(?=(\(id, cid\))? (USING KEY \(id\) )?AS \()", f"{name}{v}", text)
        text = re.sub(rf"(?<=FROM |JOIN )(recurring\.)?{name}\b", rf"\g<1>{name}{v}", text)
        text = re.sub(rf"(FROM |JOIN )(recurring\.)?{name}{v}(?= (a|b|JOIN|ON|USING|r\b))", rf"\1\2{name}{v}", text)
    return re.sub(r"(?<![\w.])(cc|e|m)\.", rf"\g<1>{v}.", text)


@query(REC + ", " + _of_label(49) + ", " + _of_label(50) + """, st AS (SELECT cid, count(*) AS k, bool_or(least(z, y, x) = 0 OR greatest(z, y, x) = n - 1) AS edge FROM lab50, p GROUP BY cid)
SELECT 48::BIGINT AS label, 0::BIGINT AS cid, z, y, x FROM vox WHERE v = 48 UNION ALL SELECT 49, cid, z, y, x FROM lab49 WHERE cid IN (SELECT cid FROM lab49 GROUP BY cid HAVING count(*) >= 2) UNION ALL SELECT 50, cid, z, y, x FROM lab50 WHERE cid IN (SELECT cid FROM st WHERE NOT edge)""")
def label_strategies(spark, sf_dir):
    v, n = vox(spark, sf_dir)
    config = {48: {"processing": "full_mask"}, 49: {"processing": "all_cc", "min_voxels": 2}, 50: {"processing": "interior_cc"}}
    return builds.grouped(v, n, config)


@query()
def field_bundle(spark, sf_dir):
    """The potential through the voxels below 49 (absent ones too), from the first plane to the last."""
    v, n = vox(spark, sf_dir)
    area = fields.grid_of(spark, n).join(apart(v.filter("v >= 49").select(*ZYX)), ZYX, "left_anti")
    return builds.field_bundle(area, area.filter("z = 0"), area.filter(F.col("z") == n - 1), n)


@query()
def passage_times(spark, sf_dir):
    """The same with the passage times of its front."""
    v, n = vox(spark, sf_dir)
    area = fields.grid_of(spark, n).join(apart(v.filter("v >= 49").select(*ZYX)), ZYX, "left_anti")
    return builds.passage_bundle(area, area.filter("z = 0"), area.filter(F.col("z") == n - 1), n)


@query()
def membrane_build(spark, sf_dir):
    """The surfaces at every eighth value inside the voxels of 15 or more, in twelve columns, packed by step."""
    v, n = vox(spark, sf_dir)
    inner = v.filter("v >= 15")
    return builds.membranes(inner, inner, n, 12, 8.0, 20_000)[0]


@query("""WITH k AS (SELECT o_orderkey AS column_id, (o_orderkey * 7919 % 1009) / 1008.0::DOUBLE * 2 - 1 AS a, (o_orderkey * 104729 % 1013) / 1012.0::DOUBLE * 2 - 1 AS b FROM orders),
h AS (SELECT column_id, (4 + (140 / 255.0::DOUBLE - 195 / 255.0::DOUBLE) / (115 / 255.0::DOUBLE)) / 6 + a * 0.04 AS h0, least(greatest(1 + b * 0.05, 0), 1) AS v, 115 / 255.0::DOUBLE AS s FROM k), q AS (SELECT *, (h0 - floor(h0)) * 6 AS h FROM h)
SELECT column_id, """ + ", ".join(f"CASE WHEN column_id > 0 THEN round_even(round((v - v * s * greatest(0, least(({k} + h) - 6 * floor(({k} + h) / 6), 4 - (({k} + h) - 6 * floor(({k} + h) / 6)), 1))) * 255, 9), 0) ELSE 255 END::INTEGER AS {c}" for k, c in ((5, "r"), (3, "g"), (1, "b"))) + " FROM q")
def column_colours(spark, sf_dir):
    """The colour of a column for each order."""
    c = shaping.column_colour(F.col("o_orderkey"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("column_id"), c.alias("c")).select("column_id", "c.*")

