"""Queries on fields, graphs of voxels and meshes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattiq.operators import fields, geometry, graph, potential, profiles, relaxation, tables, voxels
from lattiq.plans import builds
from lattiq.plans.base import REC, VOX, query, table, vox

ZYX = ["z", "y", "x"]
_IDS = ", m AS (SELECT z, y, x, v, (z * n + y) * n + x AS id FROM vox, p WHERE v >= 40), e AS (SELECT a.id AS u, b.id AS w FROM m a JOIN m b ON (b.y = a.y AND b.x = a.x AND abs(b.z - a.z) = 1) OR (b.z = a.z AND b.x = a.x AND abs(b.y - a.y) = 1) OR (b.z = a.z AND b.y = a.y AND abs(b.x - a.x) = 1))"


def _edges(spark, sf_dir, level=40):
    v, n = vox(spark, sf_dir)
    area = v.filter(F.col("v") >= level).select(*ZYX, "v")
    return area, fields.neighbour_edges(area, n), n


@query(VOX + ", g AS (SELECT a.range AS z, b.range AS y, c.range AS x FROM range((SELECT n FROM p)) a, range((SELECT n FROM p)) b, range((SELECT n FROM p)) c), bg AS (SELECT z, y, x FROM vox WHERE v >= 45) SELECT g.z, g.y, g.x, min((g.z - bg.z) * (g.z - bg.z) + (g.y - bg.y) * (g.y - bg.y) + (g.x - bg.x) * (g.x - bg.x))::DOUBLE AS d2 FROM g, bg GROUP BY g.z, g.y, g.x")
def edt_volume(spark, sf_dir):
    """The squared distance of every voxel of the grid to the nearest one of 45 or more."""
    v, n = vox(spark, sf_dir)
    return fields.squared_distance(v.filter("v >= 45"), n)


@query(VOX + ", a AS (SELECT z, y, x FROM vox WHERE v >= 48), b AS (SELECT z, y, x FROM vox WHERE v < 3) SELECT z, y, x FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE (a.z - b.z) * (a.z - b.z) + (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) <= 4)")
def dual_separation(spark, sf_dir):
    v, _ = vox(spark, sf_dir)
    return fields.separated(v.filter("v >= 48").select(*ZYX), v.filter("v < 3"), 2.0)


_J = ", ".join(f"j{k} AS (SELECT j.id, coalesce(CASE WHEN m.z = 0 THEN 0.0 WHEN m.z >= n - 2 THEN 1.0 END, (SELECT avg(q.u) FROM e JOIN j{k - 1} q ON q.id = e.w WHERE e.u = j.id), j.u) AS u FROM j{k - 1} j JOIN m USING (id), p)" for k in (1, 2, 3))


@query(VOX + _IDS + ", j0 AS (SELECT id, CASE WHEN z = 0 THEN 0.0 WHEN z >= n - 2 THEN 1.0 ELSE 0.5 END::DOUBLE AS u FROM m, p WHERE id IN (SELECT u FROM e) OR z = 0 OR z >= n - 2), " + _J + " SELECT id AS node, round(u, 9) AS u FROM j3")
def laplace_jacobi(spark, sf_dir):
    """Three Jacobi steps of Laplace's equation: 0 on the first plane, 1 on the last two.

    The values are fractions of at most seven decimals or none that end, so nine digits have no half to round."""
    area, edges, n = _edges(spark, sf_dir)
    node = graph.linear(n)
    fixed = area.filter((F.col("z") == 0) | (F.col("z") >= n - 2)).select(node.alias("node"), F.when(F.col("z") == 0, 0.0).otherwise(1.0).alias("u"))
    return fields.jacobi(edges, fixed, 3).withColumn("u", F.round("u", 9))


def _solved(spark, sf_dir, tolerance):
    """The voxels of 30 or more with f (0 on the first two planes, 1 on the last two) and the potential u between them."""
    v, n = vox(spark, sf_dir)
    f = F.when(F.col("z") < 2, 0.0).when(F.col("z") >= n - 2, 1.0)
    area = fields.Workspace(spark, "area").keep(v.filter("v >= 30").select(*ZYX, f.alias("f"), F.lit(None).cast("double").alias("start")))
    return area.join(tables.apart(potential.potential(area, tolerance)), ZYX), n


@query()
def harmonic_potential(spark, sf_dir):
    """The potential between the first and the last planes, with its passage time."""
    u, n = _solved(spark, sf_dir, 1e-3)
    return u.select(graph.linear(n).alias("node"), F.round("u", 3).alias("u"), F.round(fields.passage_time(F.col("u")), 3).alias("t_simple"))


@query(VOX + " SELECT count(*) FILTER (z BETWEEN 2 AND n - 3) AS n_free, count(*) FILTER (z < 2 OR z >= n - 2) AS n_fixed, 0::BIGINT AS n_off, 0::BIGINT AS n_outside FROM vox, p WHERE v >= 30")
def potential_residual(spark, sf_dir):
    """How many values of the potential are not the mean of their neighbours' (to 1e-4), or not between those of the ends: none."""
    u, _ = _solved(spark, sf_dir, 1e-6)
    u = fields.Workspace(spark, "residual").keep(u)
    near = voxels.moved(u, voxels.SIX, ["u"]).groupBy(*ZYX).agg(F.sum("u").alias("s"), F.count("*").alias("k"))
    off = F.abs(F.col("k") * F.col("u") - F.col("s")) > 1e-4
    rows = u.join(tables.apart(near), ZYX, "left")
    return rows.agg(F.count_if(F.col("f").isNull()).alias("n_free"), F.count("f").alias("n_fixed"), F.count_if(F.col("f").isNull() & F.coalesce(off, F.lit(False))).alias("n_off"), F.count_if((F.col("u") < -1e-6) | (F.col("u") > 1 + 1e-6)).alias("n_outside"))


_COST = REC + _IDS + ", c AS (SELECT e.u, e.w, (60 - m.v)::BIGINT AS k FROM e JOIN m ON m.id = e.w), b(node, cost) USING KEY (node) AS (SELECT id, 0::BIGINT FROM m WHERE z = 0 UNION SELECT c.w, min(b.cost + c.k) FROM b JOIN c ON c.u = b.node LEFT JOIN recurring.b r ON r.node = c.w WHERE r.cost IS NULL OR b.cost + c.k < r.cost GROUP BY c.w)"


def _paths(spark, sf_dir):
    area, edges, n = _edges(spark, sf_dir)
    cost = area.select(graph.linear(n).alias("v"), (F.lit(60) - F.col("v")).cast("bigint").alias("w"))
    start = area.filter("z = 0").select(graph.linear(n).alias("node"), F.lit(0).cast("bigint").alias("cost"))
    return graph.cheapest(edges.join(cost, "v").select("u", "v", "w"), start, block=lambda c: graph.blocked(c, n)), n


@query(_COST + " SELECT node, cost FROM b")
def bellman_ford_cost(spark, sf_dir):
    """Least cost from the first plane, entering a voxel costing 60 - v."""
    return _paths(spark, sf_dir)[0].select("node", "cost")


@query(_COST + ", via AS (SELECT c.w AS node, min(c.u) AS via FROM c JOIN b p1 ON p1.node = c.u JOIN b p2 ON p2.node = c.w WHERE p1.cost + c.k = p2.cost AND p1.cost < p2.cost GROUP BY c.w), t(path_id, step, node) AS (SELECT node, 0::BIGINT, node FROM b WHERE cost > 0 UNION ALL SELECT t.path_id, t.step + 1, via.via FROM t JOIN via USING (node)) SELECT path_id, step, node FROM t")
def path_traceback(spark, sf_dir):
    """The way of every reached voxel back to the first plane."""
    paths, n = _paths(spark, sf_dir)
    ends = paths.filter("cost > 0").select(F.col("node").alias("path_id"), "node")
    return graph.traced(paths, ends)


@query(VOX + ", m AS (SELECT z, y, x, v FROM vox WHERE v >= 30), k AS (SELECT r.range - 2 AS d, exp(-0.5 * ((r.range - 2) / 0.5) ** 2) AS w FROM range(5) r), a AS (SELECT z + d AS z, y, x, sum(v * w) AS num, sum(w) AS den FROM m, k GROUP BY ALL), b AS (SELECT z, y + d AS y, x, sum(num * w) AS num, sum(den * w) AS den FROM a, k GROUP BY ALL), c AS (SELECT z, y, x + d AS x, sum(num * w) AS num, sum(den * w) AS den FROM b, k GROUP BY ALL) SELECT c.z, c.y, c.x, round(num / den, 5) AS v FROM c JOIN m USING (z, y, x)")
def masked_gaussian(spark, sf_dir):
    v, _ = vox(spark, sf_dir)
    m = v.filter("v >= 30").select(*ZYX, "v")
    return fields.masked_gaussian(m, m, 0.5).withColumn("v", F.round("v", 5))


@query(VOX + """, c(i, cz, cy, cx) AS (VALUES (0, 3.0, 3.0, 3.0), (1, 12.0, 12.0, 12.0), (2, 20.0, 5.0, 15.0)), d AS (SELECT z, y, x, i, ((z - cz) * (z - cz) + (y - cy) * (y - cy) + (x - cx) * (x - cx))::DOUBLE AS d2 FROM vox, c WHERE v >= 45)
SELECT z, y, x, i::BIGINT AS centre, d2 FROM d QUALIFY row_number() OVER (PARTITION BY z, y, x ORDER BY d2, i) = 1""")
def nearest_centroid(spark, sf_dir):
    v, _ = vox(spark, sf_dir)
    return profiles.nearest_centre(v.filter("v >= 45").select(*ZYX), [(3, 3, 3), (12, 12, 12), (20, 5, 15)], ZYX)


def _d2(p: str, c: str) -> str:
    return " + ".join(f"({p}.{a} - {c}.{a}) * ({p}.{a} - {c}.{a})" for a in ZYX)


def _seeds(k: int) -> str:
    """CTEs s0 ... of one row each: the first is given, each other is the point of m farthest from those before."""
    out = "s0 AS (SELECT 0.0::DOUBLE AS z, 0.0::DOUBLE AS y, 0.0::DOUBLE AS x)"
    for j in range(1, k):
        near = ", ".join(_d2("m", f"s{i}") for i in range(j))
        out += f", s{j} AS MATERIALIZED (SELECT m.z::DOUBLE AS z, m.y::DOUBLE AS y, m.x::DOUBLE AS x FROM m, {', '.join(f's{i}' for i in range(j))} ORDER BY least({near}, 1e300) DESC, m.z, m.y, m.x LIMIT 1)"
    return out


_M45 = ", m AS MATERIALIZED (SELECT z, y, x FROM vox WHERE v >= 45), "


@query(VOX + _M45 + _seeds(5) + " " + " UNION ALL ".join(f"SELECT {i}::INTEGER AS seed, z, y, x FROM s{i}" for i in range(5)))
def farthest_point_seeds(spark, sf_dir):
    v, _ = vox(spark, sf_dir)
    seeds = profiles.farthest_seeds(v.filter("v >= 45"), 5, ZYX, (0, 0, 0))
    return spark.createDataFrame([(i, *s) for i, s in enumerate(seeds)], "seed int, z double, y double, x double")


def _rounds(k: int, rounds: int) -> str:
    """CTEs c0 ... of k centres each: means of the nearest points (the first centre on ties), moved to the nearest point.

    Once no centre moves, further rounds change nothing; no cluster of these data is ever empty."""
    out = "c0 AS (" + " UNION ALL ".join(f"SELECT {i}::BIGINT AS i, z, y, x FROM s{i}" for i in range(k)) + ")"
    for r in range(1, rounds + 1):
        out += f""", a{r} AS MATERIALIZED (SELECT m.z, m.y, m.x, c.i FROM m, c{r - 1} c QUALIFY row_number() OVER (PARTITION BY m.z, m.y, m.x ORDER BY {_d2("m", "c")}, c.i) = 1),
g{r} AS (SELECT i, avg(z) AS z, avg(y) AS y, avg(x) AS x FROM a{r} GROUP BY i),
c{r} AS MATERIALIZED (SELECT g.i, m.z::DOUBLE AS z, m.y::DOUBLE AS y, m.x::DOUBLE AS x FROM g{r} g, m QUALIFY row_number() OVER (PARTITION BY g.i ORDER BY {_d2("m", "g")}, m.z, m.y, m.x) = 1)"""
    return out


@query(VOX + _M45 + _seeds(3) + ", " + _rounds(3, 50) + " SELECT i::INTEGER AS centre, z, y, x FROM c50")
def kmedoids(spark, sf_dir):
    v, _ = vox(spark, sf_dir)
    m = fields.Workspace(spark, "crown").keep(v.filter("v >= 45").select(*ZYX))
    centres = profiles.medoids(m, 3, ZYX, (0, 0, 0))
    return spark.createDataFrame([(i, *s) for i, s in enumerate(centres)], "centre int, z double, y double, x double")


#: Ways of a step between voxels of m (id, z, y, x, ...), six neighbours; axis of the step.
_SIX = "e AS MATERIALIZED (SELECT a.id AS u, b.id AS w, axis FROM m a, (VALUES (1, 0, 0, 0), (-1, 0, 0, 0), (0, 1, 0, 1), (0, -1, 0, 1), (0, 0, 1, 2), (0, 0, -1, 2)) o(dz, dy, dx, axis) JOIN m b ON b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx)"


@query(REC + """, m AS MATERIALIZED (SELECT z, y, x, (z * n + y) * n + x AS id, -v AS p FROM vox, p WHERE v >= 46), """ + _SIX + """,
cc(id, cid) USING KEY (id) AS (SELECT id, id FROM m UNION SELECT e.w, min(cc.cid) FROM cc JOIN e ON e.u = cc.id JOIN recurring.cc r ON r.id = e.w WHERE cc.cid < r.cid GROUP BY e.w),
s AS MATERIALIZED (SELECT cid, min(id) AS a, max(id) AS b FROM cc GROUP BY cid), seed AS MATERIALIZED (SELECT a AS id, 1 AS label FROM s UNION ALL SELECT b, 2 FROM s WHERE b > a),
lv(id, level) USING KEY (id) AS (SELECT seed.id, m.p FROM seed JOIN m USING (id) UNION SELECT e.w, min(greatest(lv.level, m.p)) FROM lv JOIN e ON e.u = lv.id JOIN m ON m.id = e.w LEFT JOIN recurring.lv r ON r.id = e.w WHERE r.level IS NULL OR greatest(lv.level, m.p) < r.level GROUP BY e.w),
k AS MATERIALIZED (SELECT e.u, e.w FROM e JOIN lv a ON a.id = e.u JOIN lv b ON b.id = e.w JOIN m ON m.id = e.w WHERE greatest(a.level, m.p) = b.level),
rk(id, rank) USING KEY (id) AS (SELECT id, label FROM seed UNION SELECT k.w, min(rk.rank + 3) FROM rk JOIN k ON k.u = rk.id LEFT JOIN recurring.rk r ON r.id = k.w WHERE r.rank IS NULL OR rk.rank + 3 < r.rank GROUP BY k.w)
SELECT cid, z, y, x, CAST(rank % 3 AS BIGINT) AS basin FROM rk JOIN cc USING (id) JOIN m USING (id)""")
def crown_watershed(spark, sf_dir):
    """Each component of the mask flooded from its first and last voxel, on its own, in the order of descending value."""
    v, n = vox(spark, sf_dir)
    labels = fields.Workspace(spark, "crown").keep(graph.labelled(v.filter("v >= 46"), n, 6, ["v"]).withColumn("id", graph.linear(n)))
    ends = labels.groupBy("cid").agg(F.min("id").alias("a"), F.max("id").alias("b"))
    marks = ends.select(F.col("a").alias("id"), F.lit(1).alias("label")).unionByName(ends.filter("b > a").select(F.col("b").alias("id"), F.lit(2).alias("label")))
    basin = relaxation.flooded(labels.join(marks, "id", "left").select(*ZYX, (-F.col("v")).alias("priority"), "label"))
    return labels.join(basin, ZYX).select("cid", *ZYX, F.col("label").alias("basin"))


@query(REC + """, m AS MATERIALIZED (SELECT z, y, x, (z * n + y) * n + x AS id, 50 / v AS cost FROM vox, p WHERE v >= 15), """ + _SIX + """,
b(id, t) USING KEY (id) AS (SELECT id, 0::DOUBLE FROM m WHERE z < 2 UNION SELECT id, t FROM (
  SELECT id, CASE WHEN NOT cost > l2 - l1 THEN l1 + cost WHEN NOT (l2 - l1 + sqrt(greatest(2 * cost * cost - (l2 - l1) ** 2, 0))) / 2 > l3 - l1 THEN l1 + (l2 - l1 + sqrt(greatest(2 * cost * cost - (l2 - l1) ** 2, 0))) / 2
    ELSE l1 + (l2 - l1 + l3 - l1 + sqrt(greatest((l2 - l1 + l3 - l1) ** 2 - 3 * ((l2 - l1) ** 2 + (l3 - l1) ** 2 - cost * cost), 0))) / 3 END AS t FROM (
      SELECT id, list_sort(list_concat(list(t), [1e200, 1e200])) AS l, l[1] AS l1, l[2] AS l2, l[3] AS l3 FROM (SELECT c.w AS id, e.axis, min(r.t) AS t FROM (SELECT DISTINCT e.w FROM b JOIN e ON e.u = b.id) c JOIN e ON e.w = c.w JOIN recurring.b r ON r.id = e.u GROUP BY ALL) GROUP BY id) JOIN m USING (id)
  ) c LEFT JOIN (SELECT id, t AS was FROM recurring.b) r USING (id) WHERE was IS NULL OR t < was * (1 - 1e-13))
SELECT z, y, x, round(t, 6) AS t FROM m LEFT JOIN b USING (id)""")
def eikonal_times(spark, sf_dir):
    """When a front from the first two planes arrives at the voxels of 15 or more, at a speed that grows with the value."""
    v, _ = vox(spark, sf_dir)
    cells = v.filter("v >= 15").select(*ZYX, (F.col("v") / 50).alias("speed"), (F.col("z") < 2).alias("source"))
    return relaxation.travel_times(cells).select(*ZYX, F.round("t", 6).alias("t"))


def _flow(spark, sf_dir):
    """The field bundle of the voxels below 49 between the first and the last plane, and the grid's side."""
    v, n = vox(spark, sf_dir)
    area = fields.grid_of(spark, n).join(tables.apart(v.filter("v >= 49").select(*ZYX)), ZYX, "left_anti")
    bundle = builds.field_bundle(area, area.filter("z = 0"), area.filter(F.col("z") == n - 1), n)
    return fields.Workspace(spark, "flow").keep(bundle.withColumn("area", F.lit(1.0))), n


@query()
def streamlines(spark, sf_dir):
    """Lines through the solved field from every voxel of 40 or more in its second plane, with the scores of their steps."""
    field, n = _flow(spark, sf_dir)
    seeds = vox(spark, sf_dir)[0].filter("z = 1 and v >= 40").join(tables.apart(field.select(*ZYX)), ZYX, "left_semi").select((F.col("y") * max(n, 64) + F.col("x")).alias("path_id"), *ZYX)
    return builds.streamline_tracks(seeds, field, n)


@query()
def particles(spark, sf_dir):
    """200 o2 particles of three lives each in the solved field, which may end at the walls."""
    field, n = _flow(spark, sf_dir)
    seeds = fields.seeded(fields.seed_weights(field, "o2"), 600)
    return fields.particles(seeds, field, n, frames=20, lives=3, kill=fields.WALL_KILL["o2"])


@query("WITH e AS (SELECT event_id, event_id % 11 AS z, event_id % 13 AS y, (event_id % 7 + 1)::DOUBLE AS w FROM events), c AS (SELECT *, sum(w) OVER (ORDER BY z, y, event_id ROWS UNBOUNDED PRECEDING) AS c1, sum(w) OVER () AS t FROM e) SELECT k.range AS pid, event_id AS x FROM c, range(50) k WHERE k.range >= ceil((c1 - w) / t * 50 - 0.5) AND k.range <= ceil(c1 / t * 50 - 0.5) - 1")
def seed_sampling(spark, sf_dir):
    e = F.col("event_id")
    df = table(spark, sf_dir, "events").select((e % 11).alias("z"), (e % 13).alias("y"), e.alias("x"), (e % 7 + 1).cast("double").alias("w"))
    return fields.seeded(df, 50).select("pid", "x")


@query(VOX + ", m AS (SELECT z, y, x FROM vox WHERE v >= 30), c9 AS (SELECT z, y + dy AS y, x + dx AS x FROM m, (VALUES (-1), (0), (1)) a(dy), (VALUES (-1), (0), (1)) b(dx) GROUP BY ALL HAVING count(*) = 9) SELECT DISTINCT z, y + dy AS y, x + dx AS x FROM c9, (VALUES (-1), (0), (1)) a(dy), (VALUES (-1), (0), (1)) b(dx), p WHERE y + dy BETWEEN 0 AND n - 1 AND x + dx BETWEEN 0 AND n - 1")
def slice_opening(spark, sf_dir):
    v, n = vox(spark, sf_dir)
    return fields.opened_slices(v.filter("v >= 30"), n, 1)


@query(VOX + ", s(frame, d0, d1) AS (VALUES (0, 5.0, 20.0), (1, 15.0, 40.0), (2, 30.0, 49.5)) SELECT frame::BIGINT AS frame, c AS column_id, count(*) AS n_vox FROM vox, s WHERE (v - d0) * (d1 - v) > 0 GROUP BY ALL")
def shell_membership(spark, sf_dir):
    v, _ = vox(spark, sf_dir)
    shells = v.select(F.col("c").alias("column_id")).distinct().select("column_id", F.inline(F.array(*(F.struct(F.lit(i).cast("bigint").alias("frame"), F.lit(a).alias("d0"), F.lit(b).alias("d1")) for i, (a, b) in enumerate(((5.0, 20.0), (15.0, 40.0), (30.0, 49.5)))))))
    return fields.shell_members(v.select(F.col("c").alias("column_id"), F.col("v").alias("d")), shells).groupBy("frame", "column_id").agg(F.count("*").alias("n_vox"))


@query()
def iso_surface(spark, sf_dir):
    """The surface of the plane-wise means' field, by tetrahedra, with areas and normals, one row a face."""
    v, n = vox(spark, sf_dir)
    return geometry.face_vectors(geometry.iso_faces(v.select(*ZYX, "v"), n, 25.0)).select("fid", "area")


_MESH = ", f AS (SELECT l_orderkey * 8 + l_linenumber AS fid, l_orderkey % 3 AS mesh_id, l_partkey % 40 AS a, (l_partkey * 3 + 1) % 40 AS b, (l_suppkey * 7 + 2) % 40 AS c FROM lineitem), g AS (SELECT * FROM f WHERE a <> b AND b <> c AND a <> c)"


def _mesh(spark, sf_dir):
    k = table(spark, sf_dir, "lineitem")
    f = k.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("fid"), (F.col("l_orderkey") % 3).alias("mesh_id"), (F.col("l_partkey") % 40).alias("a"), ((F.col("l_partkey") * 3 + 1) % 40).alias("b"), ((F.col("l_suppkey") * 7 + 2) % 40).alias("c")).filter("a <> b and b <> c and a <> c")
    verts = spark.range(120).select((F.col("id") / 40).cast("bigint").alias("mesh_id"), (F.col("id") % 40).alias("vid"), (F.col("id") % 7).cast("double").alias("z"), (F.col("id") % 11).cast("double").alias("y"), (F.col("id") % 13).cast("double").alias("x"))
    return verts, f


_V = ", v AS (SELECT range // 40 AS mesh_id, range % 40 AS vid, (range % 7)::DOUBLE AS z, (range % 11)::DOUBLE AS y, (range % 13)::DOUBLE AS x FROM range(120))"
_PLACED = _V + ", q AS (SELECT g.*, p.z AS az, p.y AS ay, p.x AS ax, q.z - p.z AS uz, q.y - p.y AS uy, q.x - p.x AS ux, r.z - p.z AS wz, r.y - p.y AS wy, r.x - p.x AS wx FROM g JOIN v p ON p.mesh_id = g.mesh_id AND p.vid = a JOIN v q ON q.mesh_id = g.mesh_id AND q.vid = b JOIN v r ON r.mesh_id = g.mesh_id AND r.vid = c), nn AS (SELECT *, uy * wx - ux * wy AS nz, ux * wz - uz * wx AS ny, uz * wy - uy * wz AS nx FROM q)"


@query("WITH z0 AS (SELECT 1)" + _MESH + _PLACED + " SELECT mesh_id, round(sum(sqrt(nz * nz + ny * ny + nx * nx) / 2), 5) AS area FROM nn GROUP BY mesh_id")
def mesh_areas(spark, sf_dir):
    verts, faces = _mesh(spark, sf_dir)
    return geometry.face_vectors(geometry.corners(verts, faces)).groupBy("mesh_id").agg(F.round(F.sum("area"), 5).alias("area"))


@query("WITH z0 AS (SELECT 1)" + _MESH + _PLACED + ", e AS (SELECT mesh_id, unnest([a, b, c]) AS vid, nz, ny, nx FROM nn), s AS (SELECT mesh_id, vid, sum(nz) AS nz, sum(ny) AS ny, sum(nx) AS nx FROM e GROUP BY ALL) SELECT mesh_id, vid, round(nz / greatest(sqrt(nz * nz + ny * ny + nx * nx), 1e-12), 5) + 0.0 AS nz FROM s")
def point_normals(spark, sf_dir):
    verts, faces = _mesh(spark, sf_dir)
    return geometry.vertex_normals(verts, faces).select("mesh_id", "vid", (F.round("nz", 5) + 0.0).alias("nz"))


@query("WITH z0 AS (SELECT 1)" + _MESH + _V + ", e AS (SELECT DISTINCT mesh_id, unnest([a, b, b, c, a, c]) AS u, unnest([b, a, c, b, c, a]) AS w FROM g), m AS (SELECT e.mesh_id, e.u AS vid, avg(v.z) AS mz FROM e JOIN v ON v.mesh_id = e.mesh_id AND v.vid = e.w GROUP BY ALL) SELECT v.mesh_id, v.vid, round(v.z + 0.3 * (coalesce(mz, v.z) - v.z), 6) AS z FROM v LEFT JOIN m USING (mesh_id, vid)")
def laplacian_smoothing(spark, sf_dir):
    verts, faces = _mesh(spark, sf_dir)
    return geometry.smoothed(verts, faces, 1).select("mesh_id", "vid", F.round("z", 6).alias("z"))


@query("WITH z0 AS (SELECT 1)" + _MESH + " SELECT fid, 40 * mesh_id + a AS a, 40 * mesh_id + b AS b, 40 * mesh_id + c AS c FROM g")
def mesh_union(spark, sf_dir):
    return geometry.merged(*_mesh(spark, sf_dir))[1].select("fid", "a", "b", "c")


@query("WITH z0 AS (SELECT 1)" + _MESH + _V + ", k AS (SELECT mesh_id, vid, floor(z / 4) * 100 + floor(y / 4) * 10 + floor(x / 4) AS cell FROM v), h AS (SELECT g.mesh_id, fid, list_sort([p.cell, q.cell, r.cell]) AS s FROM g JOIN k p ON p.mesh_id = g.mesh_id AND p.vid = a JOIN k q ON q.mesh_id = g.mesh_id AND q.vid = b JOIN k r ON r.mesh_id = g.mesh_id AND r.vid = c WHERE p.cell <> q.cell AND q.cell <> r.cell AND p.cell <> r.cell) SELECT mesh_id, min(fid) AS fid FROM h GROUP BY mesh_id, s")
def vertex_clustering(spark, sf_dir):
    return geometry.decimated(*_mesh(spark, sf_dir), 4.0)[1].select("mesh_id", "fid")


_LONG = _MESH.replace("l_partkey % 40 AS a, (l_partkey * 3 + 1) % 40 AS b, (l_suppkey * 7 + 2) % 40 AS c", "l_orderkey // 9 * 27 + l_orderkey * 3 % 27 AS a, l_orderkey // 9 * 27 + (l_orderkey * 3 + l_partkey % 5 + 1) % 27 AS b, l_orderkey // 9 * 27 + (l_orderkey * 3 + l_suppkey % 4 + 6) % 27 AS c")


@query("WITH RECURSIVE z0 AS (SELECT 1)" + _LONG + ", e AS (SELECT DISTINCT unnest([a, b, b, c, a, c]) AS u, unnest([b, a, c, b, c, a]) AS w FROM g), cc(id, part) USING KEY (id) AS (SELECT DISTINCT u, u FROM e UNION SELECT e.w, min(cc.part) FROM cc JOIN e ON e.u = cc.id JOIN recurring.cc r ON r.id = e.w WHERE cc.part < r.part GROUP BY e.w) SELECT part, count(*) AS n FROM cc GROUP BY part HAVING count(*) >= 4")
def mesh_parts(spark, sf_dir):
    """Connected parts of a mesh and their vertices, parts under four vertices left out."""
    k, o = table(spark, sf_dir, "lineitem"), F.col("l_orderkey") * 3
    at = lambda more: F.floor(F.col("l_orderkey") / 9) * 27 + (o + more) % 27  # noqa: E731  nine orders make a patch of 27 vertices
    f = k.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("fid"), F.lit(0).cast("bigint").alias("mesh_id"), at(F.lit(0)).alias("a"), at(F.col("l_partkey") % 5 + 1).alias("b"), at(F.col("l_suppkey") % 4 + 6).alias("c")).filter("a <> b and b <> c and a <> c")
    return geometry.parts(f, 4).select("part", F.explode(F.array("a", "b", "c")).alias("v")).distinct().groupBy("part").agg(F.count("*").alias("n"))


@query("WITH f AS (SELECT l_orderkey * 8 + l_linenumber AS fid, l_suppkey % 7 AS column_id, l_quantity::BIGINT AS time_id FROM lineitem), t AS (SELECT column_id, min(time_id) AS t0 FROM f GROUP BY column_id) SELECT fid, column_id, time_id, (column_id * 5 + time_id - t0) % 24 AS step_id FROM f JOIN t USING (column_id)")
def packed_mesh(spark, sf_dir):
    k = table(spark, sf_dir, "lineitem")
    f = k.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("fid"), (F.col("l_suppkey") % 7).alias("column_id"), F.col("l_quantity").cast("bigint").alias("time_id"))
    starts = f.select("column_id").distinct().withColumn("tstart", F.col("column_id") * 5)
    return geometry.packed(f, starts, 24)
