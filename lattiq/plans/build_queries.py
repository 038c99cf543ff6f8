"""Queries of the compositions: arrows, crown tracks, shells, camera tracks."""

from __future__ import annotations

import math
import uuid

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from lattiq.functions import rotations
from lattiq.operators import geometry, graph, meshes, paths
from lattiq.operators.tables import Workspace, shared_root
from lattiq.plans import builds
from lattiq.plans.base import REC, VOX, query, table, vox
from lattiq.sources import sinks

ZYX = ["z", "y", "x"]


def _slope(c: str, by: str) -> str:
    w = f"OVER (PARTITION BY {', '.join(a for a in ZYX if a != by)} ORDER BY {by})"
    return f"CASE WHEN {by} = 0 THEN lead({c}) {w} - {c} WHEN {by} = m - 1 THEN {c} - lag({c}) {w} ELSE (lead({c}) {w} - lag({c}) {w}) / 2 END"


@query(VOX + f""", q AS (SELECT (n + 1) // 2 AS m FROM p), d AS (SELECT a.range AS z, b.range AS y, c.range AS x, coalesce(v, 0)::DOUBLE AS v FROM range((SELECT m FROM q)) a, range((SELECT m FROM q)) b, range((SELECT m FROM q)) c LEFT JOIN vox ON vox.z = a.range * 2 AND vox.y = b.range * 2 AND vox.x = c.range * 2),
g AS (SELECT z, y, x, v, m, {", ".join(f"({_slope('v', a)}) / 2 AS g{a}" for a in ZYX)} FROM d, q), u AS (SELECT *, sqrt(gz * gz + gy * gy + gx * gx) AS s FROM g), un AS (SELECT z, y, x, v, m, {", ".join(f"CASE WHEN s > 1e-9 THEN g{a} / s ELSE 0 END AS v{a}" for a in ZYX)} FROM u),
dv AS (SELECT *, -({" + ".join(f"({_slope(f'v{a}', a)})" for a in ZYX)}) / 2 AS conv FROM un), k AS (SELECT z * 2.0::DOUBLE AS z, y * 2.0::DOUBLE AS y, x * 2.0::DOUBLE AS x, vz, vy, vx, conv, (m - 1)::DOUBLE - y * 2 AS ty, (m - 1)::DOUBLE - x * 2 AS tx FROM dv WHERE z % 2 = 0 AND v > 1e-3 AND vz * vz + vy * vy + vx * vx > 1e-12),
s AS (SELECT *, (vy * ty + vx * tx) / sqrt(ty * ty + tx * tx) AS dot FROM k WHERE ty * ty + tx * tx > 1e-18), r AS (SELECT *, ln(1 + greatest(conv, 0)) AS lc FROM s WHERE dot >= 0), l AS (SELECT quantile_cont(lc, 0.7) AS a, quantile_cont(lc, 0.99) AS b FROM r)
SELECT z, y, x, round(vz, 6) + 0.0 AS vz, round(acos(least(greatest(dot, 0), 1)) / (pi() / 2), 6) AS score, round(least(greatest((lc - a) / greatest(b - a, 1e-6), 0), 1), 6) AS boost FROM r, l""")
def arrow_field(spark, sf_dir):
    """Arrows up the values of the volume, every second voxel (every fourth along z)."""
    v, n = vox(spark, sf_dir)
    out = builds.arrow_field(v.select(*ZYX, "v"), n)
    return out.select(*ZYX, (F.round("vz", 6) + 0.0).alias("vz"), F.round("score", 6).alias("score"), F.round("boost", 6).alias("boost"))


#: Voxels of 20 or more, what a step between two of 26 neighbours costs, the least cost from the first two planes, and the way on: the
#: least of the neighbours whose cost and step give it.
_CROWN = REC + """, dom AS (SELECT z, y, x, (z * n + y) * n + x AS id FROM vox, p WHERE v >= 20), g AS (SELECT a.range AS z, b.range AS y, c.range AS x FROM range((SELECT n FROM p)) a, range((SELECT n FROM p)) b, range((SELECT n FROM p)) c), bg AS (SELECT * FROM g ANTI JOIN dom USING (z, y, x)),
dd AS MATERIALIZED (SELECT d.id, d.z, d.y, d.x, sqrt(min((d.z - b.z) ** 2 + (d.y - b.y) ** 2 + (d.x - b.x) ** 2)) AS d FROM dom d JOIN bg b ON abs(d.z - b.z) <= 6 AND abs(d.y - b.y) <= 6 AND abs(d.x - b.x) <= 6 GROUP BY ALL), cc AS MATERIALIZED (SELECT id, z, y, x, 1 - 0.05 * d / (SELECT max(d) FROM dd) AS c FROM dd),
e AS MATERIALIZED (SELECT a.id AS u, b.id AS w, (a.c + b.c) / 2 * sqrt((a.z - b.z) ** 2 + (a.y - b.y) ** 2 + (a.x - b.x) ** 2) AS k FROM cc a, (SELECT x.range AS dz, y.range AS dy, z.range AS dx FROM range(-1, 2) x, range(-1, 2) y, range(-1, 2) z) o JOIN cc b ON b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx WHERE a.id <> b.id),
b(node, cost) USING KEY (node) AS (SELECT id, 0::DOUBLE FROM cc WHERE z < 2 UNION SELECT e.w, min(b.cost + e.k) FROM b JOIN e ON e.u = b.node LEFT JOIN recurring.b r ON r.node = e.w WHERE r.cost IS NULL OR b.cost + e.k < r.cost GROUP BY e.w),
via AS MATERIALIZED (SELECT e.w AS node, min(e.u) AS via FROM b a JOIN e ON e.u = a.node JOIN b c ON c.node = e.w WHERE a.cost + e.k = c.cost AND a.cost < c.cost GROUP BY e.w)"""


def _crown(spark, sf_dir):
    v, n = vox(spark, sf_dir)
    domain = v.filter("v >= 20").select(*ZYX)
    return builds.crown_tracks(domain, domain.filter(F.col("z") >= n - 4), domain.filter("z < 2"), n)


@query(_CROWN + " SELECT node AS path_id, round(cost, 6) AS cost FROM b JOIN cc ON cc.id = b.node, p WHERE cc.z >= n - 4 AND cost > 0")
def crown_tracks(spark, sf_dir):
    """What the way of each source voxel (last four planes) to the first two planes costs."""
    return _crown(spark, sf_dir).filter("step = 0").select("path_id", F.round("cost", 6).alias("cost"))


@query(_CROWN + """, way(path_id, step, node) AS (SELECT node, 0::BIGINT, node FROM b JOIN cc ON cc.id = b.node, p WHERE cc.z >= n - 4 AND cost > 0 UNION ALL SELECT path_id, step + 1, via FROM way JOIN via USING (node)),
pl AS (SELECT path_id, step, z, y, x, b.cost, lead(z) OVER w - z AS dz, lead(y) OVER w - y AS dy, lead(x) OVER w - x AS dx FROM way JOIN cc ON cc.id = way.node JOIN b ON b.node = way.node WINDOW w AS (PARTITION BY path_id ORDER BY step)),
st AS (SELECT *, sqrt(dz * dz + dy * dy + dx * dx) AS long, n / 2.0::DOUBLE - (y + dy / 2.0::DOUBLE) AS ty, n / 2.0::DOUBLE - (x + dx / 2.0::DOUBLE) AS tx FROM pl, p)
SELECT path_id, step, z::DOUBLE AS z, y::DOUBLE AS y, x::DOUBLE AS x, round(cost, 6) AS cost, round(CASE WHEN dz IS NOT NULL THEN acos(CASE WHEN sqrt(ty * ty + tx * tx) > 1e-9 THEN least(greatest((dy / long * ty + dx / long * tx) / sqrt(ty * ty + tx * tx), 0), 1) ELSE 0 END) / (pi() / 2) END, 5) + 0.0 AS score FROM st""")
def crown_segments(spark, sf_dir):
    """The ways themselves, with the scores of their steps."""
    return _crown(spark, sf_dir).select("path_id", "step", *ZYX, F.round("cost", 6).alias("cost"), (F.round("score", 5) + 0.0).alias("score"))


@query()
def lame_build(spark, sf_dir):
    """Thick shells through twelve columns, each of 2,000 faces at most, packed by step."""
    v, n = vox(spark, sf_dir)
    inner = v.filter("v >= 15")
    return builds.lames(inner, inner, n, 12, 6, 1.0, 24, target=2000)[0]


@query()
def phased_lame_build(spark, sf_dir):
    """Columns that fill, rest and empty, packed by step."""
    v, n = vox(spark, sf_dir)
    inner = v.filter("v >= 15")
    return builds.phased_lames(inner, inner, n, 12, 4.0, 0.5, 48)


def _keyframes(spark, sf_dir):
    k = F.col("o_orderkey")
    d = lambda c: c.cast("double")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("track"), k.alias("i"), d(k % 97).alias("pz"), d(k * 3 % 89).alias("py"), d(k * 7 % 83).alias("px"), d(k % 7).alias("fz"), d(k % 11).alias("fy"), d(k % 13 + 100).alias("fx"),
        F.lit(0.0).alias("uz"), F.lit(1.0).alias("uy"), F.lit(0.0).alias("ux"), F.when(k % 3 != 0, d(k % 10)).alias("hue"), F.when(k % 2 == 0, F.col("o_orderpriority")).alias("mode"),
    )


@query()
def camera_track(spark, sf_dir):
    return builds.camera_track(_keyframes(spark, sf_dir))


@query("""WITH k AS (SELECT o_custkey AS track, o_orderkey AS i, CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 10)::DOUBLE END AS hue, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS mode FROM orders),
c AS (SELECT track, row_number() OVER w - 1 AS a, last_value(hue IGNORE NULLS) OVER w AS hue, last_value(mode IGNORE NULLS) OVER w AS mode FROM k WINDOW w AS (PARTITION BY track ORDER BY i ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, lead(hue) OVER (PARTITION BY track ORDER BY a) AS h1, lead(mode) OVER (PARTITION BY track ORDER BY a) AS m1 FROM c), f AS (SELECT b.*, a * 4 + r.range AS frame, r.range / 4.0::DOUBLE AS t FROM b, range(4) r)
SELECT track, frame, round(CASE WHEN h1 IS NULL THEN hue ELSE hue + t * t * t * (t * (t * 6 - 15) + 10) * (h1 - hue) END, 6) AS hue, CASE WHEN t >= 0.5 AND m1 IS NOT NULL THEN m1 ELSE mode END AS mode FROM f""")
def ui_replay(spark, sf_dir):
    """Settings along tracks of four frames a keyframe: hue blended, mode switched in the middle."""
    k = _keyframes(spark, sf_dir)
    at = F.row_number().over(Window.partitionBy("track").orderBy("i")) - 1
    frames = k.select("track", at.alias("a")).select("track", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("r"), "a").select("track", (F.col("a") * 4 + F.col("r")).cast("bigint").alias("frame"), (F.col("a") + F.col("r") / 4).alias("keyframe"))
    return builds.ui_track(frames, k, ["hue"], ["mode"]).select("track", "frame", F.round("hue", 6).alias("hue"), "mode")


_PARTS = """, m AS MATERIALIZED (SELECT z, y, x, (z * n + y) * n + x AS id FROM vox, p WHERE v >= 46), e AS MATERIALIZED (SELECT a.id AS u, b.id AS w FROM m a, (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) o(dz, dy, dx) JOIN m b ON b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx),
cc(id, cid) USING KEY (id) AS (SELECT id, id FROM m UNION SELECT e.w, min(cc.cid) FROM cc JOIN e ON e.u = cc.id JOIN recurring.cc r ON r.id = e.w WHERE cc.cid < r.cid GROUP BY e.w)"""


@query(REC + _PARTS + """, k AS (SELECT cid, z - dz AS cz, y - dy AS cy, x - dx AS cx, count(*) AS n FROM cc JOIN m USING (id), (VALUES (0), (1)) a(dz), (VALUES (0), (1)) b(dy), (VALUES (0), (1)) c(dx) GROUP BY ALL)
SELECT cid AS mesh_id, count(*) AS n_cells FROM k WHERE n < 8 GROUP BY cid""")
def component_cells(spark, sf_dir):
    """How many cells the surface of each component of the voxels of 46 or more crosses."""
    v, n = vox(spark, sf_dir)
    own = graph.labelled(v.filter("v >= 46"), n, 6).select(F.col("cid").alias("mesh_id"), *ZYX, F.lit(1.0).alias("v"))
    return geometry.sparse_iso_triangles(own, ["mesh_id"], n).select("mesh_id", "cell").distinct().groupBy("mesh_id").agg(F.count("*").alias("n_cells"))


@query()
def component_surfaces(spark, sf_dir):
    """The surfaces of the components of three voxels and more of those of 46 or more, smoothed and reduced to their budgets."""
    v, n = vox(spark, sf_dir)
    stats, _, faces = builds.component_surfaces(v, n, 46.0, 20_000, 3, 0.0, 5)
    return stats.join(meshes.euler_numbers(faces), "mesh_id")


#: Heights over (y, x): the greatest value of each column of the volume, two faces between four neighbours.
_RELIEF = """, g AS MATERIALIZED (SELECT a.range AS y, b.range AS x, coalesce(max(v), 0)::DOUBLE AS z FROM range((SELECT n FROM p)) a, range((SELECT n FROM p)) b LEFT JOIN vox ON vox.y = a.range AND vox.x = b.range GROUP BY ALL), v AS MATERIALIZED (SELECT y * n + x AS vid, z, y::DOUBLE AS y, x::DOUBLE AS x FROM g, p),
f AS MATERIALIZED (SELECT (y * n + x) * 2 + k AS fid, y * n + x + CASE k WHEN 0 THEN 0 ELSE 1 END AS a, y * n + x + n AS b, y * n + x + CASE k WHEN 0 THEN 1 ELSE n + 1 END AS c FROM g, p, (VALUES (0), (1)) o(k) WHERE y < n - 1 AND x < n - 1)"""


def _relief(spark, sf_dir):
    v, n = vox(spark, sf_dir)
    top = v.groupBy("y", "x").agg(F.max("v").alias("h"))
    grid = spark.range(n * n).select(F.col("id").alias("vid"), (F.col("id") / n).cast("bigint").alias("y"), (F.col("id") % n).alias("x"))
    verts = grid.join(top, ["y", "x"], "left").select(F.lit(0).cast("bigint").alias("mesh_id"), "vid", F.coalesce("h", F.lit(0)).cast("double").alias("z"), F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"))
    cell = grid.filter((F.col("y") < n - 1) & (F.col("x") < n - 1)).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    faces = cell.select(F.lit(0).cast("bigint").alias("mesh_id"), (F.col("vid") * 2 + F.col("k")).alias("fid"), (F.col("vid") + F.col("k")).alias("a"), (F.col("vid") + n).alias("b"), (F.col("vid") + F.when(F.col("k") == 0, 1).otherwise(n + 1)).alias("c"))
    return verts, faces


@query()
def reduced_relief(spark, sf_dir):
    """The relief with three tenths of its faces, its rim kept: what is left of it, and the greatest height."""
    verts, faces = _relief(spark, sf_dir)
    targets = faces.groupBy("mesh_id").agg((F.count("*") * 3 / 10).cast("bigint").alias("target"))
    new, left = meshes.reduced(verts, faces, targets)
    return meshes.euler_numbers(left).join(new.groupBy("mesh_id").agg(F.round(F.max("z"), 6).alias("top")), "mesh_id")


@query(REC + _RELIEF + """, q AS (SELECT f.*, q.z - p.z AS uz, q.y - p.y AS uy, q.x - p.x AS ux, r.z - p.z AS wz, r.y - p.y AS wy, r.x - p.x AS wx FROM f JOIN v p ON p.vid = a JOIN v q ON q.vid = b JOIN v r ON r.vid = c),
nn AS MATERIALIZED (SELECT fid, a, b, c, uy * wx - ux * wy AS nz, ux * wz - uz * wx AS ny, uz * wy - uy * wz AS nx FROM q), s AS MATERIALIZED (SELECT *, sqrt(nz * nz + ny * ny + nx * nx) AS s FROM nn),
sd AS (SELECT fid, least(t[1], t[2]) AS u, greatest(t[1], t[2]) AS w FROM (SELECT fid, unnest([[a, b], [b, c], [c, a]]) AS t FROM f)), pr AS (SELECT u, w, min(fid) AS f0, max(fid) AS f1 FROM sd GROUP BY u, w HAVING count(*) = 2),
so AS MATERIALIZED (SELECT u, w, f0, f1 FROM pr JOIN s i ON i.fid = f0 JOIN s j ON j.fid = f1 WHERE i.nz * j.nz + i.ny * j.ny + i.nx * j.nx >= """ + repr(math.cos(math.radians(60.0))) + """ * i.s * j.s),
k AS MATERIALIZED (SELECT unnest([f0, f1]) AS f, unnest([f1, f0]) AS g, vid FROM (SELECT f0, f1, unnest([u, w]) AS vid FROM so)), co AS MATERIALIZED (SELECT fid, unnest([a, b, c]) AS vid FROM f),
cc(fid, vid, part) USING KEY (fid, vid) AS (SELECT fid, vid, fid FROM co UNION SELECT k.g, k.vid, min(cc.part) FROM cc JOIN k ON k.f = cc.fid AND k.vid = cc.vid JOIN recurring.cc r ON r.fid = k.g AND r.vid = k.vid WHERE cc.part < r.part GROUP BY k.g, k.vid),
n3 AS (SELECT vid, part, sum(nz) AS nz, sum(ny) AS ny, sum(nx) AS nx FROM cc JOIN nn USING (fid) GROUP BY vid, part)
SELECT vid, part, round(nz / sqrt(nz * nz + ny * ny + nx * nx), 5) + 0.0 AS nz, round(ny / sqrt(nz * nz + ny * ny + nx * nx), 5) + 0.0 AS ny, round(nx / sqrt(nz * nz + ny * ny + nx * nx), 5) + 0.0 AS nx FROM n3""")
def split_normals(spark, sf_dir):
    """Normals of the relief, its vertices split where faces meet at more than 60 degrees."""
    points, _ = meshes.split_normals(*_relief(spark, sf_dir))
    return points.select("vid", "part", *((F.round(c, 5) + 0.0).alias(c) for c in ("nz", "ny", "nx")))


@query(REC + _PARTS + ", k AS (SELECT cid, count(*) AS n FROM cc GROUP BY cid) SELECT cid, CASE WHEN n % 5 = 3 THEN 'failed' ELSE 'done' END AS status, CASE WHEN n % 5 = 3 THEN NULL ELSE n END AS n_vox FROM k")
def component_jobs(spark, sf_dir):
    """A job for each component of the voxels of 46 or more, which refuses sizes of 3, 8, 13 ...: half of the batches in one run, the rest, and
    what failed, in the next."""
    v, n = vox(spark, sf_dir)
    planes = Workspace(spark, "jobs").keep(graph.labelled(v.filter("v >= 46"), n, 6).groupBy("cid", "z").agg(F.count("*").alias("n")))  # each batch reads it

    def work(key, pdf):
        size = pdf["n"].sum()
        if size % 5 == 3:
            raise ValueError("a size that this job refuses")
        return pd.DataFrame({"n_vox": [size]})

    path = f"{shared_root(spark)}/jobs-{uuid.uuid4().hex}"
    for most in (2, None):
        found, state = sinks.resumed(planes, ["cid"], work, "n_vox bigint", path, 4, most)
    return state.select("cid", "status").join(found, "cid", "left")


def _half(x: str) -> str:
    power = f"greatest(floor(log2(greatest(abs({x}), 1e-30))), -14)"
    return f"(CASE WHEN {x} < 0 THEN -1 ELSE 1 END * round_even(abs({x}) * pow(2, 10 - {power}), 0) / pow(2, 10 - {power}))"


@query(VOX + f" SELECT z, y, x, v AS u, {_half('(v / 7)')} + 0.0 AS vz, {_half('(-v * v / 30)')} + 0.0 AS vy, {_half('(v * 1e-6)')} + 0.0 AS vx, CAST(v / 3 AS FLOAT)::DOUBLE AS speed, CASE WHEN c % 2 = 0 THEN v END AS t_eikonal, n AS side FROM vox, p")
def half_bundle(spark, sf_dir):
    """A field bundle written with its vector in half precision and its speed in single precision, and read back with its parameters."""
    v, n = vox(spark, sf_dir)
    x = F.col("v").cast("double")
    bundle = v.select(*ZYX, x.alias("u"), (x / 7).alias("vz"), (-x * x / 30).alias("vy"), (x * 1e-6).alias("vx"), (x / 3).alias("speed"), F.when(F.col("c") % 2 == 0, x).alias("t_eikonal"), F.floor(F.col("z") / 8).alias("slab"))
    path = f"{shared_root(spark)}/bundle-{uuid.uuid4().hex}"
    sinks.written_bundle(bundle, path, {"side": n}, ["vz", "vy", "vx"], ["speed"], ["slab"])
    back, parameters = sinks.read_bundle(spark, path)
    return back.select(*ZYX, "u", *((F.col(c) + F.lit(0.0)).alias(c) for c in ("vz", "vy", "vx")), F.col("speed").cast("double").alias("speed"), "t_eikonal", F.lit(parameters["side"]).cast("bigint").alias("side"))


_SPECIES = "CASE WHEN o_custkey % 2 = 0 THEN 'o2' ELSE 'ch4' END"


@query(f"WITH t AS (SELECT {_SPECIES} AS species, o_custkey AS template_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS frame, CAST(o_orderkey % 97 / 7.0::DOUBLE AS FLOAT)::DOUBLE AS z, o_orderkey % 5 > 0 AS alive FROM orders) SELECT species, template_id, frame, z, alive, CASE species WHEN 'o2' THEN 1.0 ELSE -1.0 END::DOUBLE AS direction_sign, (SELECT count(DISTINCT template_id) FROM t s WHERE s.species = t.species) AS n_templates FROM t")
def particle_templates(spark, sf_dir):
    """Templates of both species written a folder a species with their parameters, and read back."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.when(F.col("o_custkey") % 2 == 0, "o2").otherwise("ch4").alias("species"), F.col("o_custkey").alias("template_id"), k, (k % 97 / 7).alias("z"), (k % 5 > 0).alias("alive"))
    w = Window.partitionBy("template_id").orderBy("o_orderkey")
    rows = rows.withColumn("frame", (F.row_number().over(w) - 1).cast("bigint")).drop("o_orderkey")
    many = {r.species: r.n for r in rows.groupBy("species").agg(F.countDistinct("template_id").alias("n")).collect()}
    path = f"{shared_root(spark)}/templates-{uuid.uuid4().hex}"
    sinks.written_bundle(rows, path, {s: {"n_templates": n, "direction_sign": 1.0 if s == "o2" else -1.0} for s, n in many.items()}, [], ["z"], ["species"])
    back, parameters = sinks.read_bundle(spark, path)
    about = spark.createDataFrame([(s, p["direction_sign"], p["n_templates"]) for s, p in parameters.items()], "species string, direction_sign double, n_templates bigint")
    return back.join(F.broadcast(about), "species").select("species", "template_id", "frame", F.col("z").cast("double").alias("z"), "alive", "direction_sign", "n_templates")


_FRAMES = """k AS (SELECT o_custkey AS track, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS a, radians(o_orderkey % 180)::DOUBLE / 2 AS ax, radians(o_orderkey * 7 % 160 - 80)::DOUBLE / 2 AS ay, radians(o_orderkey * 3 % 360)::DOUBLE / 2 AS az FROM orders),
q0 AS (SELECT track, a, cos(ax) * cos(ay) * cos(az) + sin(ax) * sin(ay) * sin(az) AS w, sin(ax) * cos(ay) * cos(az) - cos(ax) * sin(ay) * sin(az) AS x, cos(ax) * sin(ay) * cos(az) + sin(ax) * cos(ay) * sin(az) AS y, cos(ax) * cos(ay) * sin(az) - sin(ax) * sin(ay) * cos(az) AS z FROM k)"""
_BLEND = ", ".join(f"CASE WHEN w1 IS NULL THEN {c} WHEN d > 0.9995 THEN {c} + t * (s * {c}1 - {c}) ELSE (sin((1 - t) * acos(d)) * {c} + sin(t * acos(d)) * s * {c}1) / sin(acos(d)) END AS {c}" for c in "wxyz")


@query(f"WITH {_FRAMES}, q1 AS (SELECT *, {', '.join(f'lead({c}) OVER o AS {c}1' for c in 'wxyz')} FROM q0 WINDOW o AS (PARTITION BY track ORDER BY a)), q2 AS (SELECT q1.*, r.range AS r, r.range / 4.0::DOUBLE AS t, CASE WHEN w * w1 + x * x1 + y * y1 + z * z1 < 0 THEN -1 ELSE 1 END AS s, least(abs(w * w1 + x * x1 + y * y1 + z * z1), 1.0) AS d FROM q1, range(4) r), q3 AS (SELECT track, a * 4 + r AS frame, {_BLEND} FROM q2), n AS (SELECT *, sqrt(w * w + x * x + y * y + z * z) AS g FROM q3) SELECT track, frame, round(1 - 2 * (y * y + z * z) / (g * g), 6) + 0.0 AS lx, round(2 * (x * y + w * z) / (g * g), 6) + 0.0 AS ly, round(2 * (x * z - w * y) / (g * g), 6) + 0.0 AS lz FROM n")
def orientation_slerp(spark, sf_dir):
    """Where the x axis of an object points in each frame of its track, its orientation blended on the shorter arc."""
    k = F.col("o_orderkey")
    q = rotations.of_angles([k % 180, k * 7 % 160 - 80, k * 3 % 360])
    keys = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("track"), k.alias("i"), q.alias("q"))
    a = F.row_number().over(Window.partitionBy("track").orderBy("i")) - 1
    frames = keys.select("track", a.alias("a")).select("track", "a", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("r")).select("track", (F.col("a") * 4 + F.col("r")).cast("bigint").alias("frame"), (F.col("a") + F.col("r") / 4).alias("keyframe"))
    look = rotations.turned(F.col("q"), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)))
    out = rotations.oriented(frames, keys).select("track", "frame", look.alias("l"))
    return out.select("track", "frame", *((F.round(F.get("l", F.lit(i)), 6) + 0.0).alias(c) for i, c in enumerate(("lx", "ly", "lz"))))


@query("""WITH k AS (SELECT o_custkey AS track, o_orderkey AS i, [o_orderkey % 97, o_orderkey * 3 % 89, o_orderkey * 7 % 83]::DOUBLE[] AS p, [o_orderkey % 7, o_orderkey % 11, o_orderkey % 13 + 100]::DOUBLE[] AS f, [o_orderkey % 3, 1, o_orderkey % 2]::DOUBLE[] AS u FROM orders),
b AS (SELECT track, i, p, first_value(p) OVER w AS p0, first_value(f) OVER w AS f0, first_value(u) OVER w AS u0 FROM k WINDOW w AS (PARTITION BY track ORDER BY i)), d AS (SELECT *, [f0[1] - p0[1], f0[2] - p0[2], f0[3] - p0[3]] AS d FROM b),
l AS (SELECT *, sqrt(d[1] * d[1] + d[2] * d[2] + d[3] * d[3]) AS g FROM d), e AS (SELECT *, (u0[1] * d[1] + u0[2] * d[2] + u0[3] * d[3]) / g AS h FROM l), s AS (SELECT *, [u0[1] - h * d[1] / g, u0[2] - h * d[2] / g, u0[3] - h * d[3] / g] AS v FROM e), n AS (SELECT *, sqrt(v[1] * v[1] + v[2] * v[2] + v[3] * v[3]) AS m FROM s)
SELECT track, i, p[1] + d[1] AS fz, p[2] + d[2] AS fy, p[3] + d[3] AS fx, round(v[1] / m, 6) + 0.0 AS uz, round(v[2] / m, 6) + 0.0 AS uy, round(v[3] / m, 6) + 0.0 AS ux FROM n""")
def rigid_lock(spark, sf_dir):
    """Tracks that keep the look and the view-up of their first frame while their place moves."""
    k = F.col("o_orderkey")
    d = lambda *c: F.array(*(x.cast("double") for x in c))
    track = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("track"), k.alias("i"), d(k % 97, k * 3 % 89, k * 7 % 83).alias("place"), d(k % 7, k % 11, k % 13 + 100).alias("focus"), d(k % 3, F.lit(1), k % 2).alias("up"))
    out = rotations.locked(track, "track", "i")
    return out.select("track", "i", *(F.get("focus", F.lit(i)).alias(f"f{a}") for i, a in enumerate("zyx")), *((F.round(F.get("up", F.lit(i)), 6) + 0.0).alias(f"u{a}") for i, a in enumerate("zyx")))


@query("""WITH k AS (SELECT o_custkey AS path_id, o_orderkey AS i, (o_orderkey % 97)::DOUBLE AS z, (o_orderkey * 3 % 89)::DOUBLE AS y, (o_orderkey * 7 % 83)::DOUBLE AS x, CASE WHEN o_orderkey % 4 > 0 THEN (o_orderkey % 10)::DOUBLE END AS score, (o_orderkey % 7)::DOUBLE AS boost FROM orders),
s AS (SELECT *, coalesce(sqrt((z - lag(z) OVER w) ** 2 + (y - lag(y) OVER w) ** 2 + (x - lag(x) OVER w) ** 2), 0) AS seg FROM k WINDOW w AS (PARTITION BY path_id ORDER BY i)), a AS (SELECT path_id, count(*) AS n, sum(seg) AS length, avg(score) AS score, avg(boost) AS boost FROM s GROUP BY path_id)
SELECT path_id, n, round(length, 6) AS length, round(score, 6) AS score, round(boost, 6) AS boost, (SELECT count(*) FROM k WHERE k.path_id = a.path_id) AS n_points FROM a""")
def track_attributes(spark, sf_dir):
    """A track table with the length and the mean score and boost of each path, written and read back."""
    k = F.col("o_orderkey")
    d = lambda c: c.cast("double")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path_id"), k.alias("i"), d(k % 97).alias("z"), d(k * 3 % 89).alias("y"), d(k * 7 % 83).alias("x"), F.when(k % 4 > 0, d(k % 10)).alias("score"), d(k % 7).alias("boost"))
    path = f"{shared_root(spark)}/tracks-{uuid.uuid4().hex}"
    sinks.written_tracks(rows, paths.attributes(rows, "path_id", "i", ZYX, ["score", "boost"]), path)
    points, about = sinks.read_tracks(spark, path, "path_id")
    return about.join(points.groupBy("path_id").agg(F.count("*").alias("n_points")), "path_id").select("path_id", "n", *(F.round(c, 6).alias(c) for c in ("length", "score", "boost")), "n_points")
