"""Compositions: strategies of grouping, field bundles, arrows, crown tracks, membranes, shells, camera tracks."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattiq.functions.shaping import auto_stride, clip01, column_colour, glow
from lattiq.operators import fields, geometry, graph, meshes, paths, potential, profiles, relaxation, timelines, voxels
from lattiq.operators.profiles import HALF_TURN
from lattiq.operators.tables import Workspace, apart, quantiles
from lattiq.operators.voxels import AXES

#: Fixed value: how much faster than one segment in its frames a camera cruises, to make up for its ramps.
CRUISE = 1.4885


def full_mask(mask: DataFrame, n: int, least: int = 1) -> DataFrame:
    """The whole mask as one group."""
    return mask.select(*AXES).withColumn("cid", F.lit(0).cast("bigint"))


def all_components(mask: DataFrame, n: int, least: int = 1) -> DataFrame:
    """Every component of at least `least` voxels."""
    labels = graph.labelled(mask, n, 26)
    return labels.join(apart(labels.groupBy("cid").count().filter(F.col("count") >= least)), "cid", "left_semi").select(*AXES, "cid")


def interior_components(mask: DataFrame, n: int, least: int = 1) -> DataFrame:
    """Every component that touches no face of the grid."""
    labels = graph.labelled(mask, n, 26)
    inner = graph.component_stats(labels, n).filter(~F.col("on_border") & (F.col("n_vox") >= least))
    return labels.join(apart(inner), "cid", "left_semi").select(*AXES, "cid")


#: How a label's voxels are grouped, by the name a label configuration gives.
STRATEGIES: dict[str, Callable[[DataFrame, int, int], DataFrame]] = {"full_mask": full_mask, "all_cc": all_components, "interior_cc": interior_components}


def grouped(volume: DataFrame, n: int, config: dict[int, dict]) -> DataFrame:
    """label, cid, z, y, x: the voxels of each configured label (column v) by its strategy; labels unknown to it are skipped."""
    out = None
    for label, c in sorted(config.items()):
        part = STRATEGIES[c["processing"]](volume.filter(F.col("v") == label), n, c.get("min_voxels", 1)).withColumn("label", F.lit(label).cast("bigint"))
        out = part if out is None else out.unionByName(part)
    return out.select("label", "cid", *AXES)


def field_bundle(area: DataFrame, source: DataFrame, target: DataFrame, n: int, sigma: float = 0.9, tolerance: float = 1e-3, most: int = 400) -> DataFrame:
    """z, y, x, u, vz, vy, vx, speed, wall: the potential between source (0) and target (1) in the components that join them,
    blurred inside the area and fixed again, its unit gradient and speed, and the distance to the nearest voxel outside."""
    space = Workspace(area.sparkSession, "bundle")
    area = space.keep(graph.traversing(graph.labelled(area, n, 6), source, target).select(*AXES))
    at = lambda s, v: s.join(apart(area), list(AXES), "left_semi").select(*AXES, F.lit(v).alias("f"))
    source, target = space.keep(source.select(*AXES)), space.keep(target.select(*AXES))
    ends = space.keep(at(source, 0.0).unionByName(at(target.join(apart(source), list(AXES), "left_anti"), 1.0)))
    cells = potential.along(area.join(apart(ends), list(AXES), "left"), source.join(apart(area), list(AXES), "left_semi"), target.join(apart(area), list(AXES), "left_semi"))
    u = potential.potential(cells, tolerance, most, joined=True).withColumnRenamed("u", "v")
    smooth = fields.masked_gaussian(u, area, sigma).join(apart(ends), list(AXES), "left").select(*AXES, F.coalesce("f", "v").alias("v"))
    grid = space.keep(voxels.gradient(voxels.dense(smooth, n), n).join(apart(area), list(AXES), "left_semi"))
    size = F.sqrt(sum((F.col(f"g{a}") * F.col(f"g{a}") for a in AXES), F.lit(0.0)))
    wall = fields.squared_distance(fields.grid_of(area.sparkSession, n).join(apart(area), list(AXES), "left_anti"), n)
    out = grid.join(apart(wall), list(AXES)).withColumn("speed", size)
    return out.select(*AXES, F.col("v").alias("u"), *(F.when(F.col("speed") > 1e-9, F.col(f"g{a}") / F.col("speed")).otherwise(0.0).alias(f"v{a}") for a in AXES), "speed", F.sqrt("d2").alias("wall"))


def passage_bundle(area: DataFrame, source: DataFrame, target: DataFrame, n: int, sigma: float = 0.9, tolerance: float = 1e-3) -> DataFrame:
    """The field bundle with t_simple, 1 less the potential, and t_eikonal, the time of a front from the source at the field's speed
    over the 99th percentile of all times (over the greatest, if that is next to 0), both in [0, 1]."""
    space = Workspace(area.sparkSession, "passage")
    bundle = space.keep(field_bundle(area, source, target, n, sigma, tolerance))
    marks = source.select(*AXES, F.lit(True).alias("source")).distinct()
    cells = bundle.join(apart(marks), list(AXES), "left").select(*AXES, "speed", F.coalesce("source", F.lit(False)).alias("source"))
    times = space.keep(relaxation.travel_times(cells).select(*AXES, F.coalesce("t", F.lit(0.0)).alias("t")))
    late, last = quantiles(times, "t", [0.99, 1.0])
    scale = late if late is not None and late >= 1e-9 else last or 1.0
    return bundle.join(apart(times), list(AXES)).withColumn("t_simple", fields.passage_time(F.col("u"))).withColumn("t_eikonal", clip01(F.col("t") / scale)).drop("t")


#: The share of smoothing that comes before a surface's reduction, and its most rounds.
SMOOTH_FIRST, SMOOTH_MOST = 0.2, 15


def component_surfaces(volume: DataFrame, n: int, level: float, budget: int, least: int = 1, sigma: float = 0.0, smooth: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mesh_id, n_vox, target, stride), verts and faces of the surface at `level` of each six-connected component of at least
    `least` voxels, all of them in the same jobs; mesh_id is the component's first voxel.

    A component is taken with its own values and those of the voxels beside it; all else lies below the level (-1), so surfaces are
    closed. Budgets share `budget` faces by size. A component with a far larger surface than its budget is sampled at a stride of its own. Values
    are blurred by sigma where it is not 0, surfaces smoothed `smooth` times, a part of it before they are reduced."""
    space = Workspace(volume.sparkSession, "surfaces")
    volume = space.keep(volume.select(*AXES, F.col("v").cast("double").alias("v")))
    labels = space.keep(graph.labelled(volume.filter(F.col("v") >= level), n, 6, ["v"]))
    stats = profiles.component_budgets(graph.component_stats(labels, n).filter(F.col("n_vox") >= least), budget)
    reach = int(4 * sigma + 0.5)
    pad = reach + 2
    stats = space.keep(stats.select(F.col("cid").alias("mesh_id"), "n_vox", F.col("budget").alias("target"), auto_stride(F.col("n_vox"), F.col("budget")).alias("stride"), *(F.col(f"{a}0").alias(f"{a}0") for a in AXES)))
    own = labels.join(stats.select(F.col("mesh_id").alias("cid")), "cid", "left_semi").select(F.col("cid").alias("mesh_id"), *AXES, "v")
    inside = F.lit(True)
    for a in AXES:
        inside = inside & F.col(a).between(0, n - 1)
    ring = voxels.moved(own, voxels.SIX, ["mesh_id"]).filter(inside).distinct().join(own.select("mesh_id", *AXES), ["mesh_id", *AXES], "left_anti")
    ring = ring.join(volume, list(AXES), "left").select("mesh_id", *AXES, F.coalesce("v", F.lit(0.0)).alias("v"))
    rows = own.unionByName(ring).join(stats.drop("n_vox", "target"), "mesh_id").select("mesh_id", "stride", *((F.col(a) - F.col(f"{a}0") + pad).alias(a) for a in AXES), (F.col("v") + 1).alias("v"))
    if reach:
        weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
        for a in AXES:
            taps = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(w / sum(weights)).alias("w")) for k, w in zip(range(-reach, reach + 1), weights, strict=True))))
            rows = rows.withColumn("_t", taps).withColumn(a, F.col(a) + F.col("_t.k")).groupBy("mesh_id", "stride", *AXES).agg(F.sum(F.col("v") * F.col("_t.w")).alias("v"))
    rows = rows.filter(" and ".join(f"{a} % stride = 0" for a in AXES)).select("mesh_id", *((F.col(a) / F.col("stride")).cast("bigint").alias(a) for a in AXES), (F.col("v") - 1 - level).alias("v"))
    tri = geometry.sparse_iso_triangles(rows, ["mesh_id"], n + 2 * pad, -1.0 - level).join(stats, "mesh_id")
    verts, faces = geometry.welded(tri.select("mesh_id", "cell", "tri", "corner", *((F.col(a) * F.col("stride") + F.col(f"{a}0") - pad).alias(a) for a in AXES)))
    first = min(SMOOTH_MOST, max(1, round(smooth * SMOOTH_FIRST))) if smooth else 0
    if first:
        verts = geometry.smoothed(verts, faces, first)
    verts, faces = meshes.reduced(verts, faces, stats)
    if smooth > first:
        verts = geometry.smoothed(verts, faces, smooth - first)
    return stats.select("mesh_id", "n_vox", "target", "stride"), verts, faces


def basins(area: DataFrame, distance: DataFrame, n: int, seeds: int) -> DataFrame:
    """column_id, z, y, x, d: each component of the area flooded from seeds far apart (of all components, at most `seeds`),
    in the order of distance; parts without a seed get none."""
    space = Workspace(area.sparkSession, "basins")
    labels = space.keep(graph.labelled(area, n, 6).join(apart(distance.select(*AXES, F.col("v").alias("d"))), list(AXES), "left").withColumn("d", F.coalesce("d", F.lit(0.0))))
    first = labels.orderBy(*AXES).first()
    if first is None:
        return labels.select(F.col("cid").alias("column_id"), *AXES, "d")
    chosen = profiles.farthest_seeds(labels, seeds, list(AXES), (first.z, first.y, first.x))
    marks = area.sparkSession.createDataFrame([(*map(int, s), i + 1) for i, s in enumerate(chosen)], "z bigint, y bigint, x bigint, label bigint")  # `seeds` rows at most
    basin = relaxation.flooded(labels.select(*AXES, F.col("d").alias("priority")).join(F.broadcast(marks), list(AXES), "left"))
    return labels.join(apart(basin), list(AXES)).select(F.col("label").alias("column_id"), *AXES, "d")


#: How far above its range an object's background lies, where its first level begins, and the most levels.
ABOVE, FIRST_LEVEL, MOST_LEVELS = 10.0, 1e-3, 300


def membranes(area: DataFrame, distance: DataFrame, n: int, seeds: int, level_step: float, target: int | None = None, least: float = 1.0, phases: int = 2) -> tuple[DataFrame, DataFrame]:
    """Packed triangles (fid, a, b, c, column_id, time_id, step_id, red, green, blue) of the surfaces at even steps of the distance inside an object, and its
    vertices (time_id, vid, z, y, x).

    Columns are basins of far seeds. Each surface is reduced to `target` faces; those nearer than `least` to the outside of the object, or
    with a corner in no column, go, and the others take the column that two of their corners share. A column starts at a step of its own, and
    the steps, `phases` times as many as levels, go round."""
    space = Workspace(area.sparkSession, "membranes")
    cells = space.keep(basins(area, distance, n, seeds))
    low, high = cells.filter("d > 0").agg(F.min("d"), F.max("d")).first()
    if low is None:
        raise ValueError("the distance is positive nowhere inside the object")
    level_step = max(level_step, (high - low) / MOST_LEVELS)
    count = max(0, math.ceil((high - low - FIRST_LEVEL) / level_step))
    if not count:
        raise ValueError(f"no level between {low} and {high}")
    first = low + FIRST_LEVEL

    def surfaces(pdf: pd.DataFrame):
        d = pdf["d"].to_numpy(float)
        for k in range(max(0, math.floor((d.min() - first) / level_step)), count):  # the background lies above all levels
            yield k, d - (first + k * level_step)

    faces = space.keep(geometry.block_faces(cells.select(*AXES, "d"), n, surfaces, lambda k: high + ABOVE - (first + k * level_step)))
    if target:
        verts, faces = meshes.reduced(None, faces, faces.select("mesh_id").distinct().withColumn("target", F.lit(target).cast("bigint")))
    else:
        verts = geometry.corners_of(faces)
    verts, faces = space.keep(verts), space.keep(faces.select("mesh_id", "fid", "a", "b", "c"))
    outside = fields.grid_of(area.sparkSession, n).join(apart(area.select(*AXES)), list(AXES), "left_anti")
    far = fields.squared_distance(outside, n).select(*AXES, F.sqrt("d2").alias("far"))
    labels = space.keep(cells.join(apart(far), list(AXES)).select(*AXES, F.col("column_id").alias("label"), "far"))
    kept = space.keep(geometry.voted(verts, faces, labels, least).withColumnRenamed("mesh_id", "time_id"))
    starts = kept.select("column_id").distinct().withColumn("tstart", F.pmod(F.xxhash64("column_id"), F.lit(phases * count)))
    packed = geometry.packed(kept, starts, phases * count)
    colour = column_colour(F.col("column_id"))
    return packed.withColumns({"red": colour["r"], "green": colour["g"], "blue": colour["b"]}), verts.withColumnRenamed("mesh_id", "time_id")


def periodic_zoom(grid: np.ndarray, factor: int, sigma: float) -> np.ndarray:
    """A small (length, angle) grid drawn larger by bilinear interpolation, then blurred; the angle goes round."""
    rows, cols = grid.shape
    r, c = np.linspace(0, rows - 1, rows * factor), np.arange(cols * factor) / factor
    r0 = np.minimum(r.astype(int), rows - 1)
    c0 = c.astype(int) % cols
    fr, fc = (r - r0)[:, None], (c - c.astype(int))[None, :]
    r1, c1 = np.minimum(r0 + 1, rows - 1), (c0 + 1) % cols
    big = (1 - fr) * ((1 - fc) * grid[np.ix_(r0, c0)] + fc * grid[np.ix_(r0, c1)]) + fr * ((1 - fc) * grid[np.ix_(r1, c0)] + fc * grid[np.ix_(r1, c1)])
    reach = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    w /= w.sum()
    down = np.pad(big, ((reach, reach), (0, 0)), "edge")
    big = sum(k * down[i : i + len(big)] for i, k in enumerate(w))
    return sum(k * np.roll(big, reach - i, axis=1) for i, k in enumerate(w))


def boosted(df: DataFrame, value: str, low: float = 0.7, high: float = 0.99) -> DataFrame:
    """Adds boost: log(1 + value) (0 below 0) between two of its percentiles, cut to [0, 1]; 0 where there is but one row."""
    df = df.withColumn("_log", F.log1p(F.greatest(value, F.lit(0.0))))
    a, b = quantiles(df, "_log", [low, high])
    if a is None or df.limit(2).count() < 2:
        return df.withColumn("boost", F.lit(0.0)).drop("_log")
    return df.withColumn("boost", F.least(F.greatest((F.col("_log") - a) / max(b - a, 1e-6), F.lit(0.0)), F.lit(1.0))).drop("_log")


def inward(axis: str, centre: dict[str, float], at: dict) -> tuple[dict, object]:
    """The way from a place to the central axis (along `axis`), and its length."""
    d = {a: F.lit(0.0) if a == axis else F.lit(centre[a]) - at[a] for a in AXES}
    return d, F.sqrt(sum((d[a] * d[a] for a in AXES), F.lit(0.0)))


def arrow_field(distance: DataFrame, n: int, fine: int = 2, step: int = 1, long_step: int = 2, axis: str = "z") -> DataFrame:
    """z, y, x, vz, vy, vx, score, boost: arrows along the unit gradient of a distance on an n**3 grid.

    The gradient and the convergence (minus the divergence of the unit gradient) are taken on every `fine`-th voxel; arrows
    stand at every `step`-th of those (`long_step`-th along the axis), inside the object (distance above 0.001), where the
    gradient does not vanish. Those that point away from the central axis go. score: the angle to the inward direction over
    a right angle. boost: the convergence's, see boosted()."""
    m = -(-n // fine)
    space = Workspace(distance.sparkSession, "arrows")
    sub = distance.filter(" and ".join(f"{a} % {fine} = 0" for a in AXES)).select(*((F.col(a) / fine).cast("bigint").alias(a) for a in AXES), "v")
    g = voxels.gradient(voxels.dense(sub, m), m)
    size = F.sqrt(sum((F.col(f"g{a}") * F.col(f"g{a}") for a in AXES), F.lit(0.0))) / fine
    unit = g.withColumn("_s", size).select(*AXES, "v", *(F.when(F.col("_s") > 1e-9, F.col(f"g{a}") / fine / F.col("_s")).otherwise(0.0).alias(f"v{a}") for a in AXES))
    field = space.keep(voxels.divergence(space.keep(unit), m, tuple(f"v{a}" for a in AXES)).withColumn("convergence", -F.col("div") / fine).drop("div"))
    steps = {a: long_step if a == axis else step for a in AXES}
    drawn = field.filter(" and ".join(f"{a} % {k} = 0" for a, k in steps.items())).filter((F.col("v") > 1e-3) & (sum((F.col(f"v{a}") * F.col(f"v{a}") for a in AXES), F.lit(0.0)) > 1e-12))
    drawn = drawn.withColumns({a: (F.col(a) * fine).cast("double") for a in AXES})
    centre = {a: 0.5 * (-(-m // steps[a]) - 1) * steps[a] * fine for a in AXES}
    to, far = inward(axis, centre, {a: F.col(a) for a in AXES})
    dot = sum((F.col(f"v{a}") * to[a] for a in AXES), F.lit(0.0)) / far  # divided last: products that cancel give exactly 0
    kept = space.keep(drawn.withColumn("_far", far).filter("_far > 1e-9").withColumn("dot", dot).filter("dot >= 0"))
    score = F.acos(F.least(F.greatest(F.col("dot"), F.lit(0.0)), F.lit(1.0))) / (HALF_TURN / 2)
    return boosted(kept.withColumn("score", score), "convergence").select(*AXES, "vz", "vy", "vx", "score", "boost")


def crown_tracks(domain: DataFrame, source: DataFrame, target: DataFrame, n: int, axis: str = "z") -> DataFrame:
    """path_id, step, z, y, x, cost, score: the cheapest way of every reachable source voxel to a target through the domain.

    Steps go to any of 26 neighbours and cost their length times the mean of both voxels' costs, which fall from 1 at the
    wall to 0.95 in the middle of the domain. step counts from the source. score: the angle of the step that starts here
    to the inward direction over a right angle (null at the end of a way)."""
    space = Workspace(domain.sparkSession, "crown")
    domain = space.keep(domain.select(*AXES).distinct())
    outside = fields.grid_of(domain.sparkSession, n).join(apart(domain), list(AXES), "left_anti")
    depth = fields.squared_distance(outside, n).join(apart(domain), list(AXES), "left_semi").withColumn("d", F.when(F.col("d2") < float("inf"), F.sqrt("d2")).otherwise(0.0))
    most = depth.agg(F.max("d")).first()[0] or 1.0
    cells = space.keep(depth.select(*AXES, graph.linear(n).alias("u"), (1 - 0.05 * F.col("d") / most).alias("c")))
    there = cells.select(*AXES, F.col("u").alias("v"), F.col("c").alias("c2"))
    steps = None
    for squared in (1, 2, 3):
        offsets = [o for o in voxels.TWENTY_SIX if sum(k * k for k in o) == squared]
        part = voxels.moved(cells, offsets, ["u", "c"]).join(apart(there), list(AXES)).select("u", "v", ((F.col("c") + F.col("c2")) / 2 * math.sqrt(squared)).alias("w"))
        steps = part if steps is None else steps.unionByName(part)
    start = target.join(apart(domain), list(AXES), "left_semi").select(graph.linear(n).alias("node"), F.lit(0.0).alias("cost")).distinct()
    ways = graph.cheapest(steps, start, block=lambda c: graph.blocked(c, n))
    ends = source.select(graph.linear(n).alias("node")).distinct().join(apart(ways), "node").filter("via >= 0").select(F.col("node").alias("path_id"), "node")
    way = graph.traced(ways, ends).join(apart(ways.select("node", "cost")), "node")
    place = way.select("path_id", "step", F.floor(F.col("node") / (n * n)).cast("double").alias("z"), (F.floor(F.col("node") / n) % n).cast("double").alias("y"), (F.col("node") % n).cast("double").alias("x"), "cost")
    return inward_scores(place, n, axis).select("path_id", "step", *AXES, "cost", "score")


def inward_scores(points: DataFrame, n: int, axis: str = "z") -> DataFrame:
    """Adds score to the points (path_id, step, z, y, x) of tracks: the angle of the step that starts there to the direction towards the
    grid's central axis over a right angle, 1 where it leads away; null at the end of a track."""
    w = Window.partitionBy("path_id").orderBy("step")
    rows = points.withColumns({f"_{a}": F.lead(a).over(w) - F.col(a) for a in AXES})
    to, far = inward(axis, {a: n / 2 for a in AXES}, {a: F.col(a) + F.col(f"_{a}") / 2 for a in AXES})
    long = F.sqrt(sum((F.col(f"_{a}") * F.col(f"_{a}") for a in AXES), F.lit(0.0)))
    dot = F.when((far > 1e-9) & (long > 0), sum((F.col(f"_{a}") / long * to[a] for a in AXES), F.lit(0.0)) / far).otherwise(0.0)
    score = F.when(F.col("_z").isNotNull(), F.acos(F.least(F.greatest(dot, F.lit(0.0)), F.lit(1.0))) / (HALF_TURN / 2))
    return rows.withColumn("score", score).drop(*(f"_{a}" for a in AXES))


def streamline_tracks(seeds: DataFrame, field: DataFrame, n: int, step: float = 0.5, most: int = 5000) -> DataFrame:
    """path_id, step, z, y, x, score of the streamlines from the seeds through a field (see fields.streamlines), the seeds as step 0."""
    lines = Workspace(field.sparkSession, "lines").keep(fields.streamlines(seeds, field, n, step, most))
    return inward_scores(lines.withColumnRenamed("i", "step"), n)


def shell_surfaces(cells: DataFrame, shells: DataFrame, n: int) -> DataFrame:
    """column_id, time_id, cell, tri, corner, z, y, x: the surface of F = (d - d0) (d1 - d) at 0 for each shell (column_id,
    time_id, d0, d1) of each column (cells: column_id, z, y, x, d); what lies outside a column or a shell's bounds is background."""
    f = (F.col("d") - F.col("d0")) * (F.col("d1") - F.col("d"))
    members = cells.join(shells, "column_id").withColumn("v", f).filter("v > 0").select("column_id", "time_id", *AXES, "v")
    return geometry.sparse_iso_triangles(members, ["column_id", "time_id"], n)


#: Shells of a column are numbered within this many.
SHELLS = 1 << 20


def shell_meshes(cells: DataFrame, shells: DataFrame, n: int, target: int | None = None, smooth: int = 0) -> tuple[DataFrame, DataFrame]:
    """Vertices (mesh_id, vid, z, y, x) and faces (mesh_id, fid, a, b, c, column_id, time_id) of the surfaces of shells (see shell_surfaces), each
    reduced to `target` faces and smoothed `smooth` times; mesh_id is made of column and time."""
    by_column: dict[int, list] = {}
    for r in shells.select("column_id", "time_id", "d0", "d1").collect():  # columns times levels or frames
        by_column.setdefault(r.column_id, []).append((r.column_id * SHELLS + r.time_id, r.d0, r.d1))

    def surfaces(pdf: pd.DataFrame):
        d, column = pdf["d"].to_numpy(float), pdf["column_id"].to_numpy()
        for c in np.unique(column):
            for mesh, d0, d1 in by_column.get(int(c), ()):
                v = (d - d0) * (d1 - d)
                if len(held := np.flatnonzero((column == c) & (v > 0))):
                    value = np.full(len(d), np.nan)
                    value[held] = v[held]
                    yield mesh, value

    space = Workspace(cells.sparkSession, "shells")
    verts, faces = None, geometry.block_faces(cells.select("column_id", *AXES, "d"), n, surfaces, -1.0)
    if target:
        faces = space.keep(faces)
        verts, faces = meshes.reduced(None, faces, faces.select("mesh_id").distinct().withColumn("target", F.lit(target).cast("bigint")))
    else:
        faces = faces if not smooth else space.keep(faces)
        verts = geometry.corners_of(faces)
    if smooth:
        verts = geometry.smoothed(verts, faces, smooth)
    named = faces.select("mesh_id", F.xxhash64("mesh_id", "fid").alias("fid"), "a", "b", "c", F.floor(F.col("mesh_id") / SHELLS).alias("column_id"), (F.col("mesh_id") % SHELLS).alias("time_id"))
    return verts, space.keep(named)


def lames(area: DataFrame, distance: DataFrame, n: int, seeds: int, levels: int, width: float, steps: int, fade: int = 4, target: int | None = None, smooth: int = 0) -> tuple[DataFrame, DataFrame]:
    """Packed triangles (fid, column_id, time_id, step_id, glow) of thick shells that run through the columns of an object, and
    a row of meta a column (t0, tlast, tstart).

    Columns are basins of far seeds. Levels cut the range of distances into equal steps; a shell is as thick as width times
    the level's thickening (see profiles.thickening), its lower bounds rise by half a step at least. A column starts at a step of
    its own, and steps go round."""
    space = Workspace(area.sparkSession, "lames")
    cells = space.keep(basins(area, distance, n, seeds))
    low, high = cells.agg(F.min("d"), F.max("d")).first()
    if low is None:
        empty = cells.select(F.lit(0).cast("bigint").alias("fid"), "column_id", F.lit(0).cast("bigint").alias("time_id"), F.lit(0).cast("bigint").alias("step_id"), F.lit(0.0).alias("glow")).limit(0)
        return empty, empty.select("column_id", F.col("time_id").alias("t0"), F.col("time_id").alias("tlast"), F.col("step_id").alias("tstart"))
    step = max((high - low) / levels, 1e-9)
    alpha = profiles.thickening(profiles.level_histogram(cells, low, high, levels, "d")).select(F.col("bin").alias("time_id"), "alpha")
    ranges = cells.groupBy("column_id").agg(F.min("d").alias("c0"), F.max("d").alias("c1"))
    rows = ranges.join(F.broadcast(alpha))  # a row a level, `levels` in all
    middle, half = F.lit(low) + (F.col("time_id") + 0.5) * step, F.col("alpha") * width * step / 2
    rows = rows.withColumn("lo", middle - half).withColumn("d1", middle + half).filter("d1 > c0 and lo < c1")
    shells = timelines.monotone_bounds(rows, ["column_id"], "time_id", "lo", step / 2).select("column_id", "time_id", F.col("lo").alias("d0"), F.greatest("d1", F.col("lo") + step / 2).alias("d1"))
    _, tri = shell_meshes(cells, shells, n, target, smooth)
    spans = tri.groupBy("column_id").agg(F.min("time_id").alias("t0"), F.max("time_id").alias("tlast"))
    meta = space.keep(spans.withColumn("tstart", F.pmod(F.xxhash64("column_id"), F.lit(steps))))
    local = F.col("time_id") - F.col("t0")
    out = tri.join(meta, "column_id").withColumn("step_id", F.pmod(F.col("tstart") + local, F.lit(steps))).withColumn("glow", glow(local, F.col("tlast") - F.col("t0"), fade))
    return out.select("fid", "column_id", "time_id", "step_id", "glow").repartitionByRange("step_id", "fid").sortWithinPartitions("step_id", "fid"), meta


def phased_lames(area: DataFrame, distance: DataFrame, n: int, seeds: int, growth: float, hold: float, steps: int, fade: int = 4, target: int | None = None, smooth: int = 0) -> DataFrame:
    """Packed triangles (fid, column_id, frame, phase, step_id, glow) of shells: each column fills, rests and empties (see
    fields.shell_schedules); distances count from the column's least; a column starts at a step of its own. Frames with the same shell
    share one surface, which is made once."""
    space = Workspace(area.sparkSession, "phased")
    cells = basins(area, distance, n, seeds)
    least = cells.groupBy("column_id").agg(F.min("d").alias("_least"))
    cells = space.keep(cells.join(least, "column_id").withColumn("d", F.col("d") - F.col("_least")).drop("_least"))
    schedule = space.keep(fields.shell_schedules(cells.groupBy("column_id").agg(F.max("d").alias("most")), growth, hold))
    counts = schedule.groupBy("column_id").agg(*(F.count_if(F.col("phase") == k).alias(f"n{k}") for k in range(3)))
    same = Window.partitionBy("column_id", "d0", "d1")
    frames = space.keep(schedule.withColumn("time_id", F.min("frame").over(same)))
    _, tri = shell_meshes(cells, frames.select("column_id", "time_id", "d0", "d1").distinct(), n, target, smooth)
    rows = tri.select("fid", "column_id", "time_id").join(frames.select("column_id", "time_id", "frame", "phase"), ["column_id", "time_id"]).join(counts, "column_id")
    part = F.col("frame") - F.col("n0") - F.col("n1")
    fading = float(max(1, fade))
    shine = F.when(F.col("phase") == 0, clip01(1 - F.col("frame") / fading)).when(F.col("phase") == 1, 0.0).otherwise(clip01(1 - (F.col("n2") - 1 - part) / fading))
    step = F.pmod(F.xxhash64("column_id"), F.lit(steps)) + F.col("frame")
    out = rows.select("fid", "column_id", "frame", "phase", (step % steps).alias("step_id"), shine.alias("glow"))
    return out.repartitionByRange("step_id", "fid").sortWithinPartitions("step_id", "fid")


def camera_track(keyframes: DataFrame, frames_per_segment: int = 12, ease: int = 2, dense: int = 512) -> DataFrame:
    """track, frame, keyframe, pz, py, px, fz, fy, fx, uz, uy, ux: the camera's way through the keyframes (track, i, position p*,
    focal point f*, view-up u*).

    Splines run over the chord lengths; the speed rises and falls by at most a_max a frame, never exceeds the cruise
    speed, and is bounded in curves; frames are equal steps of time; view-ups are made upright. A track is a group of its own:
    keyframes are saved by hand."""
    names = [f"{k}{a}" for k in "pfu" for a in AXES]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        p, f, u = (pdf[[f"{k}{a}" for a in AXES]].to_numpy(float) for k in "pfu")
        n = len(p)
        chord = np.concatenate([[0.0], np.cumsum(np.linalg.norm(np.diff(p, axis=0), axis=1))])
        if n == 1 or chord[-1] <= 1e-12:
            at, keyframe = np.zeros(frames_per_segment * max(1, n - 1)), np.zeros(frames_per_segment * max(1, n - 1))
            out = [np.repeat(v[:1], len(at), axis=0) for v in (p, f, u)]
        else:
            distinct = np.flatnonzero(np.concatenate([[True], np.diff(chord) > 0]))
            knots = chord[distinct] / chord[-1]
            spline = lambda v, t: paths.cubic(knots, v[distinct], t, "not-a-knot")
            t = np.linspace(0, 1, dense)
            way = np.concatenate([[0.0], np.cumsum(np.linalg.norm(np.diff(spline(p, t), axis=0), axis=1))])
            long, s = way[-1], np.linspace(0, way[-1], dense)
            cruise = long / ((n - 1) * frames_per_segment) * CRUISE
            a_max = cruise / max(1, ease * frames_per_segment)
            line = spline(p, np.interp(s, way, t))
            ds = long / (dense - 1)
            pace = np.linalg.norm(np.diff(line, axis=0), axis=1) / ds
            pace = np.maximum((pace[1:] + pace[:-1]) / 2, 1e-9)
            bend = np.linalg.norm(line[2:] - 2 * line[1:-1] + line[:-2], axis=1) / ds**2 / pace**2
            bend = np.pad(bend, 1, "edge")
            limit = np.minimum(cruise, np.sqrt(2 * a_max / np.maximum(bend, 1e-12)))
            limit[[0, -1]] = 0
            i = np.arange(dense)
            squared = np.minimum.accumulate(limit**2 - 2 * a_max * ds * i) + 2 * a_max * ds * i
            squared = (np.minimum.accumulate((squared + 2 * a_max * ds * i)[::-1])[::-1]) - 2 * a_max * ds * i
            v = np.sqrt(np.maximum(squared, 0))
            times = np.concatenate([[0.0], np.cumsum(ds / np.maximum((v[1:] + v[:-1]) / 2, 1e-15))])
            s_out = np.interp(np.linspace(0, times[-1], max(2, int(np.ceil(times[-1])) + 1)), times, s)
            at = np.interp(s_out, way, t)
            keyframe = np.interp(s_out, np.interp(chord / chord[-1], t, way), np.arange(n))
            out = [spline(v, at) for v in (p, f, u)]
        p, f, u = out
        look = f - p
        look = look / np.maximum(np.linalg.norm(look, axis=1), 1e-12)[:, None]
        u = u - (u * look).sum(1)[:, None] * look
        size = np.linalg.norm(u, axis=1)
        u = np.where(size[:, None] > 1e-9, u / np.maximum(size, 1e-12)[:, None], [0.0, 1.0, 0.0])
        whole = np.hstack([p, f, u])
        return pd.DataFrame({"track": pdf["track"].iloc[0], "frame": np.arange(len(whole)), "keyframe": keyframe, **{c: whole[:, k] for k, c in enumerate(names)}})

    def many(pdf: pd.DataFrame, begins: np.ndarray) -> pd.DataFrame:
        return pd.concat([one(t) for _, t in pdf.groupby("track", sort=False)])

    return paths.by_track(keyframes.select("track", "i", *names), "track", ["i"], many, "track bigint, frame bigint, keyframe double, " + ", ".join(f"{c} double" for c in names))


def ui_track(frames: DataFrame, keyframes: DataFrame, smooth: list[str], sticky: list[str]) -> DataFrame:
    """frames (track, frame, keyframe) with the settings of the keyframes around: those of `smooth` blended by smootherstep,
    those of `sticky` from the nearer one (the later one from the middle on); a setting that a keyframe lacks is the last one before."""
    rows = keyframes.select("track", "i", *smooth, *sticky)
    for c in (*smooth, *sticky):
        rows = timelines.carried(rows, ["track"], ["i"], c, f"_{c}").drop(c).withColumnRenamed(f"_{c}", c)
    near = timelines.bracketed(rows.withColumn("at", F.row_number().over(Window.partitionBy("track").orderBy("i")) - 1), ["track"], "at", [*smooth, *sticky])
    both = frames.withColumn("at", F.floor("keyframe").cast("int")).join(near, ["track", "at"])
    t = F.col("keyframe") - F.col("at")
    e = timelines.smootherstep(t)
    blended = [F.when(F.col(f"next_{c}").isNull(), F.col(c)).otherwise(F.col(c) + e * (F.col(f"next_{c}") - F.col(c))).alias(c) for c in smooth]
    nearer = [F.when((t >= 0.5) & F.col(f"next_{c}").isNotNull(), F.col(f"next_{c}")).otherwise(F.col(c)).alias(c) for c in sticky]
    return both.select("track", "frame", *blended, *nearer)
