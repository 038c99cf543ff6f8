"""Queries on the pseudo-volume."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattiq.operators import graph, profiles, scene, voxels
from lattiq.plans.base import REC, VOX, query, table, vox

ZYX = ["z", "y", "x"]


@query(VOX + " SELECT count(*) AS n, min(v) AS v_min, max(v) AS v_max, round(avg(v), 6) AS v_mean, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.95) AS p95, count(*) FILTER (v > 0) AS n_pos, count(DISTINCT v) AS n_values FROM vox")
def vox_profile(spark, sf_dir):
    return voxels.profile(vox(spark, sf_dir)[0]).withColumn("v_mean", F.round("v_mean", 6))


@query(VOX + " SELECT z, y, x FROM vox WHERE c = 2")
def mask_eq(spark, sf_dir):
    return vox(spark, sf_dir)[0].filter("c = 2").select(*ZYX)


@query(VOX + " SELECT z, y, x, v FROM vox WHERE v >= 48")
def mask_threshold(spark, sf_dir):
    return vox(spark, sf_dir)[0].filter("v >= 48").select(*ZYX, "v")


@query(VOX + " SELECT z, y, x, least(greatest(v, 10.0), 40.0) AS v, CASE WHEN v BETWEEN 10 AND 40 THEN 1.0 ELSE 0.0 END::DOUBLE AS opacity FROM vox")
def mask_band(spark, sf_dir):
    return voxels.banded(vox(spark, sf_dir)[0].select(*ZYX, "v"), 10.0, 40.0)


@query(VOX + " SELECT z, y, x, CASE WHEN c >= 2 THEN -1.0 ELSE v END AS v FROM vox")
def mask_exclude(spark, sf_dir):
    v, _ = vox(spark, sf_dir)
    return voxels.excluded(v.select(*ZYX, "v"), v.filter("c >= 2"))


@query(VOX + " SELECT z, y, x, v FROM vox WHERE v >= 48 AND (c >= 3 OR NOT EXISTS (SELECT 1 FROM vox WHERE v >= 48 AND c >= 3))")
def mask_and_fallback(spark, sf_dir):
    v, _ = vox(spark, sf_dir)
    return voxels.within(v.filter("v >= 48").select(*ZYX, "v"), v.filter("c >= 3"))


@query(VOX + ", m AS (SELECT max(z) AS mz, max(y) AS my, max(x) AS mx FROM vox) SELECT z, y, x, CASE WHEN z IN (0, mz) OR y IN (0, my) OR x IN (0, mx) THEN 0.0 ELSE v END AS v FROM vox, m")
def seal_borders(spark, sf_dir):
    return voxels.sealed(vox(spark, sf_dir)[0].select(*ZYX, "v"), 0.0)


@query(VOX + """, m AS (SELECT max(z) AS mz, max(y) AS my, max(x) AS mx FROM vox), f AS (
SELECT 'zmin' AS face, v FROM vox WHERE z = 0 UNION ALL SELECT 'zmax', v FROM vox, m WHERE z = mz UNION ALL SELECT 'ymin', v FROM vox WHERE y = 0 UNION ALL SELECT 'ymax', v FROM vox, m WHERE y = my
UNION ALL SELECT 'xmin', v FROM vox WHERE x = 0 UNION ALL SELECT 'xmax', v FROM vox, m WHERE x = mx) SELECT face, count(DISTINCT v) AS n_values FROM f GROUP BY face""")
def face_labels(spark, sf_dir):
    return voxels.face_values(vox(spark, sf_dir)[0])


@query("SELECT event_id, CASE WHEN value IS NULL OR isnan(value) OR isinf(value) OR value < 0 OR value > 100 THEN 0.0 ELSE value END AS value FROM events")
def clean_values(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", voxels.cleaned(F.col("value"), 100.0).alias("value"))


@query("SELECT count(*) FILTER (value IS NULL OR isnan(value) OR isinf(value)) AS n_not_finite, count(*) FILTER (value < 0) AS n_negative, count(*) FILTER (value > 100 AND NOT isinf(value) AND NOT isnan(value)) AS n_too_large FROM events")
def clean_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(*voxels.cleaning_counts(F.col("value"), 100.0))


@query(VOX + ", w AS (SELECT z, y, x, CASE WHEN c >= 4 THEN v * 1000000 ELSE v END AS v FROM vox), t AS (SELECT quantile_cont(v, 0.5) AS q FROM w WHERE v > 0) SELECT z, y, x, CASE WHEN v > 100 * q THEN 0.0 ELSE v END AS v FROM w, t")
def sentinel_reject(spark, sf_dir):
    v, _ = vox(spark, sf_dir)
    return voxels.without_sentinels(v.select(*ZYX, F.when(F.col("c") >= 4, F.col("v") * 1000000).otherwise(F.col("v")).alias("v")), 100.0, 0.5)


@query(VOX + ", m AS (SELECT max(z) + 1 AS k FROM vox) SELECT z, y, x, v FROM vox, m WHERE z < round_even(0.4 * k, 0)")
def axis_crop(spark, sf_dir):
    return voxels.cropped(vox(spark, sf_dir)[0].select(*ZYX, "v"), 0.4)


@query(VOX + " SELECT z, y, x, v FROM vox WHERE z % 4 = 0 AND y % 2 = 0 AND x % 2 = 0")
def stride_subsample(spark, sf_dir):
    return voxels.strided(vox(spark, sf_dir)[0].select(*ZYX, "v"), {"z": 4, "y": 2, "x": 2})


@query(VOX + " SELECT z, y, x, (((z * n + y) * n + x + 1) * 7 - 1) // (n * n * n) AS chunk FROM vox, p")
def chunk_split(spark, sf_dir):
    v, n = vox(spark, sf_dir)
    return v.select(*ZYX, voxels.chunk_of(graph.linear(n), n**3, 7).alias("chunk"))


@query(VOX + ", q AS (SELECT quantile_cont(v, 0.005) AS a, quantile_cont(v, 0.995) AS b FROM vox) SELECT z, y, x, round(least(greatest((v - a) / greatest(b - a, 1e-9), 0), 1) * 255, 6) AS v FROM vox, q")
def contrast_stretch_pct(spark, sf_dir):
    return voxels.stretched(vox(spark, sf_dir)[0].select(*ZYX, "v")).withColumn("v", F.round("v", 6))


@query(VOX + ", q AS (SELECT min(v) AS a, max(v) AS b FROM vox) SELECT z, y, x, round((v - a) / greatest(b - a, 1e-9) * 255, 6) AS v FROM vox, q")
def contrast_stretch_minmax(spark, sf_dir):
    return voxels.rescaled(vox(spark, sf_dir)[0].select(*ZYX, "v")).withColumn("v", F.round("v", 6))


def _labels(offsets: str, where: str = "v >= 48", extra: str = "") -> str:
    """Least member by repeated lowering; offsets: rows (dz, dy, dx) of a condition on the difference."""
    return REC + f""", m AS (SELECT z, y, x, (z * n + y) * n + x AS id {extra} FROM vox, p WHERE {where}),
e AS (SELECT a.id AS a, b.id AS b FROM m a JOIN m b ON {offsets}),
cc(id, cid) USING KEY (id) AS (SELECT id, id FROM m UNION SELECT e.b, min(cc.cid) FROM cc JOIN e ON e.a = cc.id JOIN recurring.cc r ON r.id = e.b WHERE cc.cid < r.cid GROUP BY e.b),
lab AS (SELECT m.*, cid FROM m JOIN cc USING (id))"""


_N6 = "(b.y = a.y AND b.x = a.x AND b.z IN (a.z - 1, a.z + 1)) OR (b.z = a.z AND b.x = a.x AND b.y IN (a.y - 1, a.y + 1)) OR (b.z = a.z AND b.y = a.y AND b.x IN (a.x - 1, a.x + 1))"
_SIDES = "((b.y = a.y AND b.x = a.x AND abs(b.z - a.z) = 1) OR (b.z = a.z AND b.x = a.x AND abs(b.y - a.y) = 1) OR (b.z = a.z AND b.y = a.y AND abs(b.x - a.x) = 1))"
_N26 = "b.z BETWEEN a.z - 1 AND a.z + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 AND a.id <> b.id"
_STATS = ", st AS (SELECT cid, count(*) AS n_vox, min(z) AS z0, max(z) AS z1, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1, bool_or(least(z, y, x) = 0 OR greatest(z, y, x) = n - 1) AS on_border FROM lab, p GROUP BY cid)"


def _mask(spark, sf_dir, connectivity=6):
    v, n = vox(spark, sf_dir)
    return graph.labelled(v.filter("v >= 48"), n, connectivity), n


@query(_labels(_SIDES) + " SELECT z, y, x, cid FROM lab")
def components_6(spark, sf_dir):
    return _mask(spark, sf_dir)[0].select(*ZYX, "cid")


@query(_labels(_N26, "v >= 50") + " SELECT z, y, x, cid FROM lab")
def components_26(spark, sf_dir):
    v, n = vox(spark, sf_dir)
    return graph.labelled(v.filter("v >= 50"), n, 26).select(*ZYX, "cid")


@query(_labels(_SIDES) + _STATS + " SELECT * FROM st")
def components_stats(spark, sf_dir):
    return graph.component_stats(*_mask(spark, sf_dir))


@query(_labels(_SIDES) + _STATS + " SELECT row_number() OVER (ORDER BY n_vox DESC, cid DESC) - 1 AS rank, cid, n_vox FROM st ORDER BY n_vox DESC, cid DESC LIMIT 20")
def components_topn(spark, sf_dir):
    top = graph.component_stats(*_mask(spark, sf_dir)).orderBy(F.desc("n_vox"), F.desc("cid")).limit(20)
    from pyspark.sql import Window

    return top.withColumn("rank", (F.row_number().over(Window.orderBy(F.desc("n_vox"), F.desc("cid"))) - 1).cast("bigint")).select("rank", "cid", "n_vox")


@query(_labels(_SIDES) + _STATS + " SELECT z, y, x, cid FROM lab WHERE cid IN (SELECT cid FROM st WHERE NOT on_border AND n_vox >= 3)")
def components_interior(spark, sf_dir):
    labels, n = _mask(spark, sf_dir)
    stats = graph.component_stats(labels, n).filter("not on_border and n_vox >= 3")
    return labels.join(stats, "cid", "left_semi").select(*ZYX, "cid")


@query(_labels(_SIDES) + " SELECT z, y, x, cid FROM lab WHERE cid IN (SELECT cid FROM lab WHERE z % 6 = 0) AND cid IN (SELECT cid FROM lab WHERE z % 6 = 2)")
def components_traversing(spark, sf_dir):
    labels, n = _mask(spark, sf_dir)
    return graph.traversing(labels, labels.filter("z % 6 = 0"), labels.filter("z % 6 = 2")).select(*ZYX, "cid")


@query(_labels(_SIDES) + _STATS + " SELECT cid, greatest(0, z0 - 2) AS pz0, least(n, z1 + 3) AS pz1, greatest(0, y0 - 2) AS py0, least(n, y1 + 3) AS py1, greatest(0, x0 - 2) AS px0, least(n, x1 + 3) AS px1 FROM st, p")
def bbox_padded(spark, sf_dir):
    labels, n = _mask(spark, sf_dir)
    stats = graph.component_stats(labels, n)
    return stats.select("cid", *(e.cast("bigint").alias(f"p{a}{i}") for a in ZYX for i, e in enumerate(profiles.padded_box(F.col(f"{a}0"), F.col(f"{a}1"), 2, n))))


@query(VOX + """, o(dz, dy, dx) AS (VALUES (0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))
SELECT DISTINCT z + dz AS z, y + dy AS y, x + dx AS x FROM vox, o, p WHERE v >= 48 AND z + dz BETWEEN 0 AND n - 1 AND y + dy BETWEEN 0 AND n - 1 AND x + dx BETWEEN 0 AND n - 1""")
def dilate_1(spark, sf_dir):
    v, n = vox(spark, sf_dir)
    return voxels.dilated(v.filter("v >= 48"), (n, n, n))


@query(VOX + """, m AS (SELECT z, y, x FROM vox WHERE v >= 48), o(dz, dy, dx) AS (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))
SELECT z, count(*) AS n_faces FROM m, o WHERE NOT EXISTS (SELECT 1 FROM m q WHERE q.z = m.z + dz AND q.y = m.y + dy AND q.x = m.x + dx) GROUP BY z""")
def exposed_faces(spark, sf_dir):
    return voxels.exposed_faces(vox(spark, sf_dir)[0].filter("v >= 48")).groupBy("z").agg(F.count("*").alias("n_faces"))


@query(_labels("b.z = a.z AND ((b.y = a.y AND abs(b.x - a.x) = 1) OR (b.x = a.x AND abs(b.y - a.y) = 1))", "v >= 40") + ", s AS (SELECT z, cid, count(*) AS n_vox FROM lab GROUP BY z, cid) SELECT z, cid, n_vox FROM s QUALIFY row_number() OVER (PARTITION BY z ORDER BY n_vox DESC, cid) = 1")
def slice_largest_component(spark, sf_dir):
    from pyspark.sql import Window

    v, n = vox(spark, sf_dir)
    m = v.filter("v >= 40").select(*ZYX).withColumn("id", graph.linear(n))
    near = voxels.moved(m, [(0, 1, 0), (0, 0, 1)], ["id"]).withColumnRenamed("id", "u")
    root = graph.smallest_member(near.join(m.withColumnRenamed("id", "v"), ZYX).select("u", "v"))
    lab = m.join(root.select(F.col("u").alias("id"), F.col("v").alias("cid")), "id", "left").withColumn("cid", F.coalesce("cid", "id"))
    sizes = lab.groupBy("z", "cid").agg(F.count("*").alias("n_vox"))
    return sizes.withColumn("rn", F.row_number().over(Window.partitionBy("z").orderBy(F.desc("n_vox"), "cid"))).filter("rn = 1").drop("rn")


@query("SELECT l_returnflag AS label, count(*) AS n, CASE WHEN l_returnflag = 'A' THEN 500 ELSE round_even(count(*) / sum(count(*)) OVER () * 10000, 0)::BIGINT END AS budget FROM lineitem GROUP BY l_returnflag")
def budget_labels(spark, sf_dir):
    return profiles.label_budgets(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("label")), "label", 10000, {"A": 500})


@query(_labels(_SIDES) + _STATS + " SELECT cid, n_vox, greatest(1, round_even(pow(n_vox, 2.0 / 3) / sum(pow(n_vox, 2.0 / 3)) OVER () * 100000, 0))::BIGINT AS budget FROM st")
def budget_components(spark, sf_dir):
    return profiles.component_budgets(graph.component_stats(*_mask(spark, sf_dir)), 100000).select("cid", "n_vox", "budget")


@query(VOX + """, h AS (SELECT b.bin, count(v) AS n FROM range(10) b(bin) LEFT JOIN vox ON (CASE WHEN v = 50 THEN 9 WHEN v >= 0 AND v < 50 THEN floor(v / 5.0)::BIGINT END) = b.bin GROUP BY b.bin),
f AS (SELECT avg(n) AS m FROM (SELECT n FROM h WHERE n > 0 ORDER BY bin LIMIT 5)) SELECT bin, n, round(CASE WHEN n > 0 THEN least(greatest(n / m, 0.5), 3.0) ELSE 1.0 END, 6)::DOUBLE AS alpha FROM h, f""")
def level_histogram_alpha(spark, sf_dir):
    return profiles.thickening(profiles.level_histogram(vox(spark, sf_dir)[0], 0.0, 50.0, 10)).withColumn("alpha", F.round("alpha", 6))


_CYL = ", cyl AS (SELECT *, least(z * 6 // n, 5) AS l, least(floor((atan2(y - n / 2.0, x - n / 2.0) + pi()) / (2 * pi()) * 8)::BIGINT, 7) AS t, sqrt((y - n / 2.0) * (y - n / 2.0) + (x - n / 2.0) * (x - n / 2.0)) AS radius, v >= 40 AS hit FROM vox, p)"
_HIST = _CYL + ", sec AS (SELECT l, t, min(radius) AS r0, max(radius) AS r1 FROM cyl GROUP BY l, t), h AS (SELECT l, t, least(floor((radius - r0) / greatest(r1 - r0, 1e-9) * 5)::BIGINT, 4) AS k, count(*) AS total, count(*) FILTER (hit) AS hits FROM cyl JOIN sec USING (l, t) GROUP BY ALL)"


def _cyl(spark, sf_dir):
    v, n = vox(spark, sf_dir)
    return profiles.cylindrical(v, n / 2.0, n / 2.0, 6, 8, n).withColumn("hit", F.col("v") >= 40)


@query(VOX + _CYL + ", g AS (SELECT a.range AS l, b.range AS t FROM range(6) a, range(8) b) SELECT l, t, count(v) AS total, count(*) FILTER (hit) AS hits, round(CASE WHEN count(v) > 0 THEN count(*) FILTER (hit) / count(v) ELSE 0 END, 6)::DOUBLE AS ratio FROM g LEFT JOIN cyl USING (l, t) GROUP BY l, t")
def density_grid_ratio(spark, sf_dir):
    return profiles.ratio_grid(_cyl(spark, sf_dir), F.col("hit"), 6, 8).withColumn("ratio", F.round("ratio", 6))


@query(VOX + _HIST + " SELECT l, t, k, total, hits FROM h")
def radial_hist3d(spark, sf_dir):
    return profiles.radial_histogram(_cyl(spark, sf_dir), 5)


@query(VOX + _HIST + ", full_h AS (SELECT s.l, s.t, k.range AS k, coalesce(hits / total, 0) AS d FROM sec s CROSS JOIN range(5) k LEFT JOIN h ON h.l = s.l AND h.t = s.t AND h.k = k.range), m AS (SELECT l, t, avg(d) AS m FROM full_h GROUP BY l, t) SELECT l, t, round(regr_slope(d / m, (k + 0.5) / 5), 6) AS slope FROM full_h JOIN m USING (l, t) WHERE m > 0 GROUP BY l, t")
def radial_slope(spark, sf_dir):
    return profiles.radial_slope(profiles.radial_histogram(_cyl(spark, sf_dir), 5), 5).withColumn("slope", F.round("slope", 6))


_TRI = "SELECT l_orderkey AS fid, l_orderkey % 5 AS a, (l_orderkey // 2) % 5 AS b, (l_orderkey // 3) % 5 AS c FROM lineitem GROUP BY l_orderkey"


@query(f"WITH t AS ({_TRI}) SELECT fid, CASE WHEN a = b OR a = c THEN a WHEN b = c THEN b ELSE least(a, b, c) END AS label FROM t")
def triangle_vote(spark, sf_dir):
    k = F.col("l_orderkey")
    t = table(spark, sf_dir, "lineitem").select(k).distinct().select(k.alias("fid"), (k % 5).alias("a"), (F.floor(k / 2) % 5).alias("b"), (F.floor(k / 3) % 5).alias("c"))
    return t.select("fid", profiles.majority(F.col("a"), F.col("b"), F.col("c")).alias("label"))


@query(VOX + """, f AS (SELECT z * 10000 + y * 100 + x AS fid, z, y, x FROM vox WHERE c >= 2), g AS (
SELECT f.fid, count(w.v) AS n, min(w.v) AS least_v FROM f, (VALUES (0, 0, 0), (0, 0, 1), (0, 1, 0)) o(dz, dy, dx) LEFT JOIN vox w ON w.z = f.z + dz AND w.y = f.y + dy AND w.x = f.x + dx GROUP BY f.fid)
SELECT fid, least_v FROM g WHERE n = 3 AND least_v >= 20""")
def triangle_filter(spark, sf_dir):
    """Triangles whose three vertices are all labelled and at least 20."""
    v, _ = vox(spark, sf_dir)
    f = v.filter("c >= 2").select((F.col("z") * 10000 + F.col("y") * 100 + F.col("x")).alias("fid"), *ZYX)
    corners = voxels.moved(f, [(0, 0, 0), (0, 0, 1), (0, 1, 0)], ["fid"]).join(v.select(*ZYX, "v"), ZYX)
    return corners.groupBy("fid").agg(F.count("*").alias("n"), F.min("v").alias("least_v")).filter("n = 3 and least_v >= 20").drop("n")


@query(VOX + """, d AS (SELECT a.range AS z, b.range AS y, c.range AS x, coalesce(v, 0) AS v FROM range((SELECT n FROM p)) a, range((SELECT n FROM p)) b, range((SELECT n FROM p)) c LEFT JOIN vox ON vox.z = a.range AND vox.y = b.range AND vox.x = c.range)
SELECT z, y, x, CASE WHEN z = 0 THEN lead(v) OVER a - v WHEN z = n - 1 THEN v - lag(v) OVER a ELSE (lead(v) OVER a - lag(v) OVER a) / 2 END AS gz, CASE WHEN y = 0 THEN lead(v) OVER b - v WHEN y = n - 1 THEN v - lag(v) OVER b ELSE (lead(v) OVER b - lag(v) OVER b) / 2 END AS gy, CASE WHEN x = 0 THEN lead(v) OVER c - v WHEN x = n - 1 THEN v - lag(v) OVER c ELSE (lead(v) OVER c - lag(v) OVER c) / 2 END AS gx
FROM d, p WINDOW a AS (PARTITION BY y, x ORDER BY z), b AS (PARTITION BY z, x ORDER BY y), c AS (PARTITION BY z, y ORDER BY x)""")
def gradient_field(spark, sf_dir):
    v, n = vox(spark, sf_dir)
    return voxels.gradient(voxels.dense(v, n), n).select(*ZYX, "gz", "gy", "gx")


@query(VOX + """, d AS (SELECT a.range AS z, b.range AS y, c.range AS x, coalesce(v, 0) AS v, coalesce(c.range % 3, 0)::DOUBLE AS w FROM range((SELECT n FROM p)) a, range((SELECT n FROM p)) b, range((SELECT n FROM p)) c LEFT JOIN vox ON vox.z = a.range AND vox.y = b.range AND vox.x = c.range)
SELECT z, y, x, CASE WHEN z = 0 THEN lead(v) OVER a - v WHEN z = n - 1 THEN v - lag(v) OVER a ELSE (lead(v) OVER a - lag(v) OVER a) / 2 END + CASE WHEN y = 0 THEN lead(v) OVER b - v WHEN y = n - 1 THEN v - lag(v) OVER b ELSE (lead(v) OVER b - lag(v) OVER b) / 2 END + CASE WHEN x = 0 THEN lead(w) OVER c - w WHEN x = n - 1 THEN w - lag(w) OVER c ELSE (lead(w) OVER c - lag(w) OVER c) / 2 END AS div
FROM d, p WINDOW a AS (PARTITION BY y, x ORDER BY z), b AS (PARTITION BY z, x ORDER BY y), c AS (PARTITION BY z, y ORDER BY x)""")
def divergence_field(spark, sf_dir):
    v, n = vox(spark, sf_dir)
    d = voxels.dense(v, n).withColumn("w", (F.col("x") % 3).cast("double"))
    return voxels.divergence(d, n, ("v", "v", "w")).select(*ZYX, "div")


@query(VOX + ", pts AS (SELECT event_id AS pid, (event_id % 23) + 0.25 AS pz, (event_id % 19) + 0.5 AS py, (event_id % 17) + 0.75 AS px FROM events), k AS (SELECT pid, (CASE WHEN a = 1 THEN pz - floor(pz) ELSE 1 - (pz - floor(pz)) END) * (CASE WHEN b = 1 THEN py - floor(py) ELSE 1 - (py - floor(py)) END) * (CASE WHEN c = 1 THEN px - floor(px) ELSE 1 - (px - floor(px)) END) AS w, floor(pz) + a AS z, floor(py) + b AS y, floor(px) + c AS x FROM pts, (VALUES (0), (1)) aa(a), (VALUES (0), (1)) bb(b), (VALUES (0), (1)) cc(c)) SELECT pid, round(sum(w * coalesce(v, 0)), 6)::DOUBLE AS v FROM k LEFT JOIN vox USING (z, y, x) GROUP BY pid")
def trilinear_sample(spark, sf_dir):
    v, _ = vox(spark, sf_dir)
    e = F.col("event_id")
    pts = table(spark, sf_dir, "events").select(e.alias("pid"), (e % 23 + 0.25).alias("pz"), (e % 19 + 0.5).alias("py"), (e % 17 + 0.75).alias("px"))
    return voxels.trilinear(pts, v).withColumn("v", F.round("v", 6))


@query(VOX + " SELECT y, x, v FROM vox WHERE z = 5")
def ortho_slice(spark, sf_dir):
    return voxels.slice_at(vox(spark, sf_dir)[0].select(*ZYX, "v"), "z", 5)


@query(VOX + ", s AS (SELECT y AS r, x AS c, v FROM vox WHERE z = 5) SELECT a.range AS i, b.range AS j, coalesce(v, 0) AS v FROM p, range(40) a, range(40) b LEFT JOIN s ON s.r = a.range * (SELECT n FROM p) // 40 AND s.c = b.range * (SELECT n FROM p) // 40")
def nn_resize(spark, sf_dir):
    v, n = vox(spark, sf_dir)
    return voxels.resized(v.filter("z = 5").select(F.col("y").alias("r"), F.col("x").alias("c"), "v"), 40, n)


_STEP = VOX + ", cells AS (SELECT (z * n + y) * n + x AS fid, c AS column_id, v::BIGINT AS time_id, (c * 3 + v::BIGINT) % 20 AS step_id FROM vox, p WHERE v >= 1)"


def _cells(spark, sf_dir):
    v, n = vox(spark, sf_dir)
    return v.filter("v >= 1").select(graph.linear(n).alias("fid"), F.col("c").alias("column_id"), F.col("v").cast("bigint").alias("time_id"), F.pmod(F.col("c") * 3 + F.col("v").cast("bigint"), F.lit(20)).alias("step_id"), *ZYX)


@query(_STEP + " SELECT fid, step_id, column_id, time_id FROM cells")
def pack_steps(spark, sf_dir):
    """Cells sorted by step: ranged over the partitions, then sorted within each."""
    return _cells(spark, sf_dir).select("fid", "step_id", "column_id", "time_id").repartitionByRange("step_id", "fid").sortWithinPartitions("step_id", "fid")


@query(_STEP + ", r AS (SELECT step_id, count(*) AS k FROM cells GROUP BY step_id) SELECT step_id, coalesce(sum(k) OVER (ORDER BY step_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_row, (sum(k) OVER (ORDER BY step_id))::BIGINT AS end_row FROM r")
def step_ranges(spark, sf_dir):
    """Where each step's rows stand in the sorted cells: sums over the steps, not over the rows."""
    from pyspark.sql import Window

    k = _cells(spark, sf_dir).groupBy("step_id").agg(F.count("*").alias("k"))
    end = F.sum("k").over(Window.orderBy("step_id"))
    return k.select("step_id", (end - F.col("k")).alias("first_row"), end.alias("end_row"))


@query(_STEP + " SELECT column_id, min(time_id) AS first_level, max(time_id) AS last_level, count(DISTINCT step_id) AS n_steps FROM cells GROUP BY column_id")
def phase_bins(spark, sf_dir):
    return _cells(spark, sf_dir).groupBy("column_id").agg(F.min("time_id").alias("first_level"), F.max("time_id").alias("last_level"), F.countDistinct("step_id").alias("n_steps"))


_BOX = VOX + ", cells AS (SELECT z, y, x, c AS column_id, v::BIGINT AS time_id FROM vox)"


@query(_BOX + " SELECT column_id, min(z) AS z0, max(z) AS z1, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM cells GROUP BY column_id")
def column_bounds(spark, sf_dir):
    v, _ = vox(spark, sf_dir)
    return v.groupBy(F.col("c").alias("column_id")).agg(*(f(a).alias(f"{a}{i}") for a in ZYX for i, f in ((0, F.min), (1, F.max))))


@query(_BOX + ", mid AS (SELECT column_id, (min(time_id) + max(time_id)) // 2 AS m FROM cells GROUP BY column_id) SELECT column_id, min(z) AS z0, max(z) AS z1, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM cells JOIN mid USING (column_id) WHERE time_id = m GROUP BY column_id")
def column_midstep_bounds(spark, sf_dir):
    v, _ = vox(spark, sf_dir)
    cells = v.select(*ZYX, F.col("c").alias("column_id"), F.col("v").cast("bigint").alias("time_id"))
    mid = cells.groupBy("column_id").agg(F.expr("(min(time_id) + max(time_id)) div 2").alias("time_id"))
    return cells.join(mid, ["column_id", "time_id"]).groupBy("column_id").agg(*(f(a).alias(f"{a}{i}") for a in ZYX for i, f in ((0, F.min), (1, F.max))))


@query(_BOX + ", b AS (SELECT column_id, min(z) AS z0, max(z) AS z1, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM cells WHERE time_id >= 45 GROUP BY column_id), cam AS (SELECT event_id AS t, event_id % 41 - 8 AS z, event_id % 37 - 6 AS y, event_id % 31 - 4 AS x FROM events) SELECT column_id, min(t) AS caught_at FROM b JOIN cam ON cam.z BETWEEN z0 - 1 AND z1 + 1 AND cam.y BETWEEN y0 - 1 AND y1 + 1 AND cam.x BETWEEN x0 - 1 AND x1 + 1 GROUP BY column_id")
def box_catch(spark, sf_dir):
    """When the camera is first inside each column's box widened by 1."""
    return _caught(spark, sf_dir)


def _caught(spark, sf_dir):
    v, _ = vox(spark, sf_dir)
    box = v.filter("v >= 45").groupBy(F.col("c").alias("column_id")).agg(*(f(a).alias(f"{a}{i}") for a in ZYX for i, f in ((0, F.min), (1, F.max))))
    e = F.col("event_id")
    cam = table(spark, sf_dir, "events").select(e.alias("t"), (e % 41 - 8).alias("z"), (e % 37 - 6).alias("y"), (e % 31 - 4).alias("x"))
    return scene.caught(cam, box, 1).groupBy("column_id").agg(F.min("t").alias("caught_at"))


@query(_BOX + ", b AS (SELECT column_id, min(z) AS z0, max(z) AS z1, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM cells WHERE time_id >= 45 GROUP BY column_id), cam AS (SELECT event_id AS t, event_id % 41 - 8 AS z, event_id % 37 - 6 AS y, event_id % 31 - 4 AS x FROM events), k AS (SELECT DISTINCT column_id FROM b JOIN cam ON cam.z BETWEEN z0 - 1 AND z1 + 1 AND cam.y BETWEEN y0 - 1 AND y1 + 1 AND cam.x BETWEEN x0 - 1 AND x1 + 1) SELECT column_id, count(*) AS n FROM cells WHERE column_id NOT IN (SELECT column_id FROM k) GROUP BY column_id")
def catch_columns_remaining(spark, sf_dir):
    v, _ = vox(spark, sf_dir)
    return v.withColumnRenamed("c", "column_id").join(_caught(spark, sf_dir), "column_id", "left_anti").groupBy("column_id").agg(F.count("*").alias("n"))
